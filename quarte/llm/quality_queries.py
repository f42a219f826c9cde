"""Query of the quality rules."""

from quarte.llm.common import table
from quarte.llm.outliers import quality
from quarte.llm.registry import query


@query("op1_quality_outliers")
def op1_quality_outliers(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))
