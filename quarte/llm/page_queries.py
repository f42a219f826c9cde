"""Queries over web pages."""

from quarte.llm.common import stage, table
from quarte.llm.html import main_text
from quarte.llm.registry import query
from quarte.llm.warc import derivatives, read_back, responses


@query("op4_host_paths")
def op4_host_paths(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


@query("op5_warc_derivatives")
def op5_warc_derivatives(spark, sf_dir):
    return read_back(stage(derivatives(responses(table(spark, sf_dir, "pages")))))
