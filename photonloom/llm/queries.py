"""Queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from photonloom.llm.clusters import OP13_SQL, op13_clusters
from photonloom.llm.divergence import OP11_SQL, op11_divergence
from photonloom.llm.grammar import op12_grammar
from photonloom.llm.langid import op5_langid
from photonloom.llm.media import op2_media
from photonloom.llm.mixing import OP4_SQL, op4_mixing
from photonloom.llm.packing import op7_packing
from photonloom.llm.pii import op1_pii
from photonloom.llm.quality import op10_quality
from photonloom.llm.simhash import op9_simhash
from photonloom.llm.substring import op6_substring
from photonloom.llm.urls import op3_urls
from photonloom.llm.warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_pii, op2_media, op3_urls, op4_mixing, op5_langid, op6_substring, op7_packing, op8_warc, op9_simhash, op10_quality, op11_divergence, op12_grammar, op13_clusters)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op8_warc": OP8_SQL, "op11_divergence": OP11_SQL, "op13_clusters": OP13_SQL}
