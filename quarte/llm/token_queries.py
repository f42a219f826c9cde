"""Queries of the token stores and of packing."""

from quarte.llm.common import stage, table
from quarte.llm.grammar import read_back, shards
from quarte.llm.packing import pack
from quarte.llm.pieces import digests
from quarte.llm.registry import query


@query("op3_token_repair")
def op3_token_repair(spark, sf_dir):
    return read_back(stage(shards(table(spark, sf_dir, "documents"))))


@query("op9_kk_packing")
def op9_kk_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
