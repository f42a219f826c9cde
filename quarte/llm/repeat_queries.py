"""Query of the suffix-array dedup."""

from quarte.llm.common import table
from quarte.llm.registry import query
from quarte.llm.repeats import digests


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
