"""Filtered nearest-neighbour search by cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import SCORE_DIGITS, cosine_to


def nearest(
    rows: DataFrame,
    query: list[float],
    k: int,
    tie_break: list[str],
    vector: str = "embedding",
    where: Column | None = None,
) -> DataFrame:
    """The `k` rows most similar to `query`, with a `score` column.

    Filters apply before the ranking, so `k` rows come back whenever that many qualify. Only
    the vector reaches Python; each task keeps its best `k` rows before they are merged.
    """
    scope = rows if where is None else rows.where(where)
    scored = scope.withColumn("score", cosine_to(F.col(vector), query)).drop(vector)
    best = scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), *tie_break).limit(k)
    return best.withColumn("score", F.round("score", SCORE_DIGITS))


def check_k(k: int, most: int) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"k must be between 1 and {most}")
    return k
