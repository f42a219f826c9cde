"""Query of the shingle similarity join."""

from quarte.llm.common import table
from quarte.llm.jaccard import near_duplicates
from quarte.llm.registry import query


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
