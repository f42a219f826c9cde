"""Query of the language-model scores."""

from quarte.llm.common import table
from quarte.llm.ppm import scores
from quarte.llm.registry import query


@query("op10_ppm_score")
def op10_ppm_score(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents"))
