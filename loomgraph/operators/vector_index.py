"""An exact search index: vectors in cells around pivots, one partition of a table per cell.

A cell knows its pivot and the least and greatest angle of its vectors to it. No vector of a cell
can be closer to a query than the difference between these angles and the query's own angle to the
pivot allows, so cells are read in order of the best score they can hold, until the k-th score found
is better than that of all cells left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.vectors import SCORE_DIGITS, as_matrix, cosine_to, unit_rows
from loomgraph.session import ensure_checkpoint_dir

#: Cells of an index at most; the driver holds a pivot and three numbers of each.
CELLS = 256
MOST_CELLS = 4096
#: Angles are compared with this much to spare, as arc cosines lose half of the digits near 1.
SLACK = 1e-6


@dataclass
class Cell:
    number: int
    pivot: np.ndarray
    nearest: float
    farthest: float
    rows: int

    def best_score(self, query: np.ndarray) -> float:
        """The highest cosine that a vector of the cell can have to the query, a unit vector."""
        angle = float(np.arccos(np.clip(self.pivot @ query, -1, 1)))
        apart = max(angle - self.farthest, self.nearest - angle, 0.0)
        return float(np.cos(max(apart - SLACK, 0.0)))


def choose_pivots(rows: DataFrame, vector: str, cells: int) -> np.ndarray:
    """Up to `cells` distinct vectors, scaled to length 1: the least by hash of each of as many groups of hashes.

    The choice covers all rows and does not depend on their order; copies fall in one group.
    """
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = rows.where(F.exists(vector, lambda x: x != 0) & ~odd)
    name = F.xxhash64(vector, F.reverse(vector))
    least = fine.groupBy(F.pmod(name, F.lit(cells)).alias("_group")).agg(F.min_by(vector, name).alias("_v"))
    found = [r["_v"] for r in least.orderBy("_group").collect()]
    size = max((len(v) for v in found), key=[len(v) for v in found].count, default=0)
    chosen = [v for v in found if len(v) == size]
    return unit_rows(np.array(chosen, "float64").reshape(len(chosen), size))


def build_index(rows: DataFrame, path: str, vector: str = "embedding", cells: int = CELLS) -> None:
    """Write the rows to `path`/vectors, by cell, and what is known of the cells to `path`/cells.

    Vectors that are null, zero, of another size, or hold no numbers never rank, and are left out.
    A cell that holds very many rows is written by several tasks.
    """
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"cells must be between 1 and {MOST_CELLS}")
    spark = rows.sparkSession
    pivots = choose_pivots(rows, vector, cells)
    width = pivots.shape[1]

    @F.arrow_udf("struct<cell int, angle double>")
    def placed(column: pa.Array) -> pa.Array:
        cell, angle = np.full(len(column), -1), np.full(len(column), np.nan)
        likeness = unit_rows(as_matrix(column, width)) @ pivots.T if width else np.full((len(column), 1), np.nan)
        fine = np.isfinite(likeness).all(axis=1)
        cell[fine] = likeness[fine].argmax(axis=1)
        angle[fine] = np.arccos(np.clip(likeness[fine, cell[fine]], -1, 1))
        parts = [pa.array(cell, pa.int32()), pa.array(angle, pa.float64())]
        return pa.StructArray.from_arrays(parts, ["cell", "angle"])

    found = rows.withColumn("_p", placed.asNondeterministic()(vector))
    found = found.select(*rows.columns, "_p.cell", F.col("_p.angle").alias("_angle")).where("cell >= 0")
    # The columns are known also where no vector is.
    spark.createDataFrame([], found.schema).write.mode("overwrite").parquet(f"{path}/schema")
    found.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    known = (
        _vectors(spark, path)
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("_angle").alias("nearest"), F.max("_angle").alias("farthest"))
    )
    numbered = spark.createDataFrame(
        [(k, p.tolist()) for k, p in enumerate(pivots)], "cell int, pivot array<double>"
    )
    known.join(numbered, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/vectors")


class VectorIndex:
    """A written index. `columns` of its rows come back from a search."""

    def __init__(self, spark: SparkSession, path: str, vector: str = "embedding"):
        self.spark, self.path, self.vector = spark, path, vector
        rows = spark.read.parquet(f"{path}/cells").collect()
        self.cells = [
            Cell(r["cell"], np.array(r["pivot"]), r["nearest"], r["farthest"], r["rows"]) for r in rows
        ]
        #: Cells that the last search read.
        self.read: list[int] = []

    def search(self, query: list[float], k: int, tie_break: list[str], where=None) -> DataFrame:
        """The `k` rows most similar to `query`, with `score`: what a scan of all rows gives.

        Cells are read in rounds, each about twice as many rows as the last, beginning with enough
        for `k`. A round is one job over the partitions of its cells; the best rows so far are
        written to the shared folder. With a filter, rounds go on until k rows pass it.
        """
        ensure_checkpoint_dir(self.spark)
        table = _vectors(self.spark, self.path)
        kept = [c for c in table.columns if c not in (self.vector, "_angle", "cell")]
        target = unit_rows(np.asarray([query], "float64"))[0]
        todo = sorted(self.cells, key=lambda c: (-c.best_score(target), c.number))
        best, count, least, self.read = None, 0, -2.0, []
        wanted = 2 * k
        while todo and (count < k or todo[0].best_score(target) >= least):
            now, rows = [], 0
            while todo and rows < wanted and (count < k or todo[0].best_score(target) >= least):
                rows += todo[0].rows
                now.append(todo.pop(0).number)
            wanted *= 2
            self.read += now
            part = table.where(F.col("cell").isin(now))
            part = part if where is None else part.where(where)
            scored = part.select(*kept, cosine_to(F.col(self.vector), query).alias("score"))
            scored = scored.where(F.col("score").isNotNull())
            both = scored if best is None else best.unionByName(scored)
            best = both.orderBy(F.desc("score"), *tie_break).limit(k).checkpoint()
            count, least = best.agg(F.count(F.lit(1)), F.min("score")).first()
        if best is None:
            best = table.select(*kept, F.lit(None).cast("double").alias("score")).limit(0)
        return best.withColumn("score", F.round("score", SCORE_DIGITS))
