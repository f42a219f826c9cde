"""Query of the ranked lexical search, with its SQL."""

from quarte.llm.common import table
from quarte.llm.lexical import ranking
from quarte.llm.registry import query

TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS.format("text")} AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, s.n),
m AS (SELECT r, doc_id, 75 + (25 * len(terms) * s.n) // s.l AS m FROM d, s WHERE len(terms) > 0),
found AS (SELECT q.item_id, m.r, m.doc_id, sum(q.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * m.m)))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM found WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op11_block_max_search", SQL)
def op11_block_max_search(spark, sf_dir):
    return ranking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
