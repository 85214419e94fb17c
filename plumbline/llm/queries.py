"""Queries op1 to op13, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.audio import op8
from plumbline.llm.centroids import op12
from plumbline.llm.chat import op9
from plumbline.llm.common import table
from plumbline.llm.decontam import op10
from plumbline.llm.divergence import op11
from plumbline.llm.hilbert import op7
from plumbline.llm.html_text import op1
from plumbline.llm.langid import op6
from plumbline.llm.licenses import op13
from plumbline.llm.mixing import op4
from plumbline.llm.oracles import OP4, OP5, OP9, OP10, OP11, OP12
from plumbline.llm.simhash import op3
from plumbline.llm.substrings import op5
from plumbline.llm.toxicity import op2

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_html_main_text": lambda spark, sf_dir: op1(table(spark, sf_dir, "pages")),
    "op2_toxicity_neighbours": lambda spark, sf_dir: op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_simhash_components": _over_documents(op3),
    "op4_pareto_mix": _over_documents(op4),
    "op5_substring_dedup": _over_documents(op5),
    "op6_language_id": _over_documents(op6),
    "op7_hilbert_shards": _over_documents(op7),
    "op8_audio_features": _over_documents(op8),
    "op9_chat_format": lambda spark, sf_dir: op9(table(spark, sf_dir, "conversations")),
    "op10_decontaminate": op10,
    "op11_source_divergence": _over_documents(op11),
    "op13_license_scan": _over_documents(op13),
    "op12_centroid_clusters": lambda spark, sf_dir: op12(table(spark, sf_dir, "embeddings")),
}

ORACLES: dict[str, str] = {"op4_pareto_mix": OP4, "op5_substring_dedup": OP5, "op9_chat_format": OP9, "op10_decontaminate": OP10, "op11_source_divergence": OP11, "op12_centroid_clusters": OP12}
