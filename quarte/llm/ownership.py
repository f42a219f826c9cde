"""Secret scans with corpus-wide ownership frequency.

Whole texts are scanned for three base kinds (``assign``, ``access``, ``hex``) and for bare values: runs of 20 or more
letters, digits and ``+ / _ = -`` that are no part of a base finding. What a finding protects (the assigned value, the key,
the run) is its credential. Each distinct credential of the corpus is counted over the distinct owners and repositories
that hold it:

* ``copied``  more than ``max_owners`` owners hold it: a widely copied example;
* ``dull``    few owners, but it doesn't look drawn at random: under ``min_kinds`` of lower-case letters, upper-case
              letters and digits, or under ``min_bits`` bits of entropy a character;
* ``live``    the rest: a credential that belongs to few owners and looks live.

Base findings stay whatever their class. Bare values are added as spans of kind ``value`` where they are live.

The scan is one pass of JVM expressions over the texts: a pattern's matches and the pieces between them, of which only
lengths are kept, give positions by running sums per document. Texts never leave the scan: a narrow table of findings is
stored, distinct (credential, owner, repository) rows are counted in two levels, so that a value in a third of all documents
is summed before it is shuffled, and classes go back to the findings in a join whose hot keys adaptive execution splits.

Defined results: a missing or empty text has no findings; a missing owner or repository is one of its own; every row is a
document of its own, so repeated rows give repeated results; findings of a kind never overlap, findings of different
kinds may. Positions are code points, ends are exclusive. Input columns other than the named ones are not read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarte.llm.common import stage

#: The base patterns. Runs of a class are maximal, so the long ones can be asked for at once.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "value": (VALUE, 0)}
BASE = ("assign", "access", "hex")
LEAST = 6  #: characters of an assigned value


@dataclass(frozen=True)
class OwnerRules:
    max_owners: int = 2  #: owners that a credential may have and still be theirs
    min_kinds: int = 2  #: of lower-case letters, upper-case letters and digits
    min_bits: float = 3.0  #: entropy of a character


def matches(text: Column, kind: str) -> Column:
    """Array of (gap before the match, its length, credential) in order; NULL where nothing matches."""
    pattern, group = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(whole.alias("whole"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), value.alias("value"))
    rows = F.transform(zipped, lambda m: F.struct(m["gap"].alias("gap"), F.length(m["whole"]).alias("size"), m["value"].alias("value")))
    return F.when(text.rlike(pattern), rows)


def findings(docs: DataFrame, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """Stored (row, doc_id) of all documents and (row, owner, repo, kind, k, start, end, value) of their findings."""
    text = F.col("text")
    given = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), owner.cast("string").alias("owner"),
        repository.cast("string").alias("repo"), F.col("text").cast("string").alias("text"),
    )
    scanned = stage(given.select("row", "doc_id", "owner", "repo", *(matches(text, k).alias(k) for k in KINDS)))
    some = scanned.filter(" OR ".join(f"{k} IS NOT NULL" for k in KINDS))
    kinds = F.array(*(F.struct(F.lit(n).alias("k"), F.lit(k).alias("kind"), F.col(k).alias("found")) for n, k in enumerate(KINDS)))
    rows = some.select("row", "owner", "repo", F.explode(kinds).alias("of")).select("row", "owner", "repo", "of.k", "of.kind", F.posexplode("of.found").alias("at", "m"))
    order = W.Window.partitionBy("row", "k").orderBy("at").rowsBetween(W.Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(order)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.size"))
    long_enough = (F.col("kind") != "assign") | (F.length("m.value") >= LEAST)
    rows = rows.filter(long_enough).select("row", "owner", "repo", "k", "kind", "start", "end", F.col("m.value").alias("value"))
    return scanned.select("row", "doc_id"), stage(bare(rows))


def bare(rows: DataFrame) -> DataFrame:
    """Leave out values that share a character with a base finding of the same document."""
    before = W.Window.partitionBy("row").orderBy("start", "k").rowsBetween(W.Window.unboundedPreceding, 0)
    after = W.Window.partitionBy("row").orderBy(F.desc("start"), F.desc("k")).rowsBetween(W.Window.unboundedPreceding, 0)
    is_base = F.col("kind") != "value"
    # of equal starts the base finding comes first, so it lies before the value
    rows = rows.withColumn("_end", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("_start", F.min(F.when(is_base, F.col("start"))).over(after))
    clear = (F.coalesce("_end", F.lit(0)) <= F.col("start")) & (F.col("_start").isNull() | (F.col("_start") >= F.col("end")))
    return rows.filter(is_base | clear).drop("_start", "_end")


def bits(value: Column) -> Column:
    """Entropy of a character in bits."""
    n = F.length(value)
    signs = F.array_distinct(F.split(value, ""))
    share = F.transform(F.filter(signs, lambda c: c != ""), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def credentials(found: DataFrame, rules: OwnerRules = OwnerRules()) -> DataFrame:
    """(value, owners, repos, uses, class) of every distinct credential."""
    held = found.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    one = F.struct("owner").alias("owner")  # a missing owner counts as one, too
    counted = held.groupBy("value", one).agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"))
    counted = counted.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses"))
    kinds = sum((F.col("value").rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    live = (kinds >= rules.min_kinds) & (F.round(bits(F.col("value")), 6) >= rules.min_bits)
    return counted.withColumn("class", F.when(F.col("owners") > rules.max_owners, "copied").when(live, "live").otherwise("dull"))


def scan(docs: DataFrame, owner: Column, repository: Column, rules: OwnerRules = OwnerRules()) -> DataFrame:
    """Per document: base counts and their digest, all spans, and findings by class of their credential."""
    rows, found = findings(docs, owner, repository)
    classes = stage(credentials(found, rules).select("value", "class"))
    # a value of very many findings is split by Spark's own rule for skewed joins
    judged = found.join(classes, "value")
    judged = judged.filter((F.col("kind") != "value") | (F.col("class") == "live"))
    span = F.struct("start", "k", "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    is_base = F.col("kind") != "value"
    of_kind = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    of_class = [F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("copied", "live", "dull")]
    said = lambda col: F.array_join(F.transform(F.array_sort(col), lambda s: s["said"]), ",")
    spans = judged.groupBy("row").agg(*of_kind, *of_class, F.collect_list(F.when(is_base, span)).alias("base"), F.collect_list(span).alias("every"))
    spans = spans.select("row", *(f"n_{k}" for k in KINDS), "n_copied", "n_live", "n_dull", said("base").alias("base"), said("every").alias("every"))
    counts = [F.coalesce(f"n_{c}", F.lit(0)).cast("long").alias(f"n_{c}") for c in (*KINDS, "copied", "live", "dull")]
    text = [F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("every", F.lit("")).alias("spans")]
    return rows.join(spans, "row", "left").select("doc_id", *counts, *text)
