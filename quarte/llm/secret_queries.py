"""Query of the secret scan, with its SQL."""

from pyspark.sql import functions as F

from quarte.llm.common import table
from quarte.llm.registry import query
from quarte.llm.ownership import scan

KIND = """
{k} AS (SELECT r, owner, repo, {n} AS k, '{k}' AS kind, value, (sum(gap + len(whole)) OVER (PARTITION BY r ORDER BY place))::BIGINT AS stop, len(whole) AS size
  FROM (SELECT r, owner, repo, unnest(range(len(whole))) AS place, unnest(whole) AS whole, unnest(list_transform(gaps[1:len(whole)], lambda g: len(g))) AS gap, unnest(value) AS value
    FROM (SELECT r, owner, repo, regexp_extract_all(text, '{p}') AS whole, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', {g}) AS value FROM d)))"""
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
FOUND = ",".join(
    KIND.format(k=k, n=n, p=p, g=g)
    for n, (k, p, g) in enumerate(
        [("assign", ASSIGN, 2), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]{24,}", 0), ("value", "[A-Za-z0-9+/_=-]{20,}", 0)]
    )
)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS owner, source || '/' || lang AS repo, coalesce(text, '') AS text FROM documents),{FOUND},
a AS (SELECT *, stop - size AS start FROM (FROM assign UNION ALL FROM access UNION ALL FROM hex UNION ALL FROM value)
  WHERE (kind <> 'assign' OR len(value) >= 6) AND (kind <> 'access' OR size >= 20)),
f AS (SELECT * FROM a WHERE kind <> 'value' OR NOT EXISTS (FROM a b WHERE b.r = a.r AND b.kind <> 'value' AND b.start < a.stop AND a.start < b.stop)),
o AS (SELECT value, count(DISTINCT coalesce(owner, '\\0')) AS owners FROM f GROUP BY ALL),
e AS (SELECT value, sum(-p * log2(p)) AS bits FROM (SELECT value, c, count(*) / len(value)::DOUBLE AS p FROM (SELECT value, unnest(string_split(value, '')) AS c FROM o) GROUP BY value, c) GROUP BY value),
c AS (SELECT value, CASE WHEN owners > 2 THEN 'copied' WHEN round(bits, 6) >= 3.0 AND regexp_matches(value, '[a-z]')::INT + regexp_matches(value, '[A-Z]')::INT + regexp_matches(value, '[0-9]')::INT >= 2
  THEN 'live' ELSE 'dull' END AS class FROM o JOIN e USING (value)),
j AS (SELECT *, kind || ':' || start || ':' || stop AS said FROM f JOIN c USING (value) WHERE kind <> 'value' OR class = 'live')
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'value') AS n_value,
  count(*) FILTER (class = 'copied') AS n_copied, count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'dull') AS n_dull,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, k) FILTER (kind <> 'value'), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN j USING (r) GROUP BY d.r, d.doc_id
"""


@query("op12_secret_ownership", SQL)
def op12_secret_ownership(spark, sf_dir):
    """A source is an owner; its documents of one language are a repository."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, F.col("source"), F.concat(F.col("source"), F.lit("/"), F.col("lang")))
