"""All queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.fusion import decided
from plumbline.plans import fits, frames, fusion, metrics, models, readouts, relational, rules, rulings, studies
from plumbline.sources.tables import evaluation

FAMILIES = [fusion, metrics, relational, frames, models, readouts, rules, fits, studies, rulings]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in FAMILIES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in FAMILIES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, policy and verdict of every document."""
    return decided(evaluation(spark, sf_dir)).select("path", "split", "y", "base", "fused", "p_fused", "probability", "verdict")
