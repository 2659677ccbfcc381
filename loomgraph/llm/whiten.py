"""Whitening of embeddings by exact eigenvalues of their integer scatter matrix.

Entries become whole numbers, so sums and products over any number of rows are exact and do not
depend on the order of tasks. The characteristic polynomial of the scatter matrix is then an exact
one (`charpoly`): tasks find it modulo primes and solve for the vectors of its largest roots. Only
numbers whose count the width of the vectors fixes reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import charpoly
from loomgraph.llm.common import written

#: Steps of the grid per unit, and the number that is added to make entries positive.
GRID = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Tasks that small work is dealt to at most.
TASKS = 64
_SUMS = "i int, j int, value decimal(38,0)"


def usable(vector: Column) -> Column:
    """Not null, and without null, infinite or undefined entries."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Entries on the grid, less the offset, one row per vector."""
    steps = np.floor(np.asarray(column.flatten(), np.float64).reshape(-1, width) * GRID)
    if len(steps) and np.abs(steps).max() >= 2.0**62:
        raise ValueError("an entry is too large for a whole number of 64 bits on the grid")
    return steps.astype(np.int64)


def gram(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers, exact; in floating point where every sum is a whole number below 2 ** 53."""
    most = int(np.abs(y).max()) ** 2 * len(y) if y.size else 0
    if most < 1 << 53:
        real = y.astype(np.float64)
        return (real.T @ real).astype(np.int64).astype(object)
    return y.astype(object).T @ y.astype(object)


def _fit_list(rows: DataFrame, width: int) -> DataFrame:
    """Each distinct grid vector once, as 64-bit integers in a row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in y], pa.binary())], names=["y"])

    return written(rows.select("__v").mapInArrow(run, "y binary").distinct(), "fit")


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in batch.column(0)), np.int64).reshape(-1, width)


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sum per dimension and the sums of products over the fit list: one row of each per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # With a one in front, products hold the sums and the count as well.
        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            y = _unpacked(batch, width)
            total += gram(np.column_stack((np.ones(len(y), np.int64), y)))
        i, j = np.triu_indices(width + 1)
        values = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], names=["i", "j", "value"]
        )

    sums = fit.mapInArrow(run, _SUMS).groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    full = [[0] * (width + 1) for _ in range(width + 1)]
    for r in sums:
        full[r["i"]][r["j"]] = full[r["j"]][r["i"]] = int(r["value"])
    return full[0][0], full[0][1:], [row[1:] for row in full[1:]]


def scatter(n: int, sums: list[int], products: list[list[int]]) -> list[list[int]]:
    """n * n times the covariance with divisor n: whole numbers."""
    return [[n * p - a * b for p, b in zip(row, sums, strict=True)] for row, a in zip(products, sums, strict=True)]


def _dealt(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(0, count, 1, min(max(count, 1), TASKS))


def spark_charpoly(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The characteristic polynomial; its residues modulo primes are found in tasks."""
    primes = charpoly.primes_for(charpoly.coefficient_bits(matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, charpoly.charpoly_mod(matrix, primes[k]).tolist()) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.int64()))],
                names=["k", "c"],
            )

    rows = _dealt(spark, len(primes)).mapInArrow(run, "k long, c array<long>").collect()
    residues = {r["k"]: np.array(r["c"], np.int64) for r in rows}
    return charpoly.combined(primes, [residues[k] for k in range(len(primes))])


def spark_vectors(spark: SparkSession, matrix: list[list[int]], roots: list[tuple[int, int]]) -> np.ndarray:
    """A unit vector for each root, as rows, in their order; a task solves for each different root."""
    distinct = sorted(set(roots), key=roots.index)
    counts = [roots.count(r) for r in distinct]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = charpoly.null_vectors(matrix, distinct[k], counts[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()),
                     pa.array(found.tolist(), pa.list_(pa.float64()))],
                    names=["k", "nth", "v"],
                )

    rows = _dealt(spark, len(distinct)).mapInArrow(run, "k long, nth int, v array<double>").collect()
    found = sorted((r["k"], r["nth"], r["v"]) for r in rows)
    return np.array([v for _, _, v in found]).reshape(len(roots), len(matrix))


def _identity_error(fit: DataFrame, width: int, n: int, sums: np.ndarray, turn: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance less the identity, measured on it."""
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = _centred(_unpacked(batch, width), n, sums) @ turn
            w = np.column_stack((np.ones(len(w)), w))
            total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"]
        )

    rows = fit.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    full = np.zeros((k + 1, k + 1))
    for r in rows.collect():
        full[r["i"], r["j"]] = r["value"]
    mean = full[0, 1:] / n
    return float(np.abs(full[1:, 1:] / n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - sums: whole numbers, exact where they fit in 64 bits and as Python integers beyond."""
    most = n * int(np.abs(y).max()) if y.size else 0
    if most + int(max(map(abs, sums), default=0)) < 1 << 62:
        return y * n - sums.astype(np.int64)
    return y.astype(object) * n - sums


def _deviations(centred: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row."""
    most = int(np.abs(centred).max()) if centred.size else 0
    if centred.dtype != object and most**2 * centred.shape[1] >= 1 << 62:
        centred = centred.astype(object)
    total = (centred * centred).sum(axis=1)
    if centred.dtype == object:
        return pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
    return pa.array(total, pa.int64()).cast(pa.decimal128(38, 0))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    Left out are null vectors, those with null or non-finite entries, and those of another length
    than most have (of lengths as frequent, the longest counts). Entries go on a grid of 1 / GRID;
    means and covariance are those of the distinct grid vectors, with their number n as divisor.
    Components are unit eigenvectors by falling eigenvalue; a repeated eigenvalue has some
    orthonormal ones. One with eigenvalue zero cannot be whitened and is left out, so fewer vectors
    than dimensions, or copies of one vector, give fewer components, down to none. `deviation` is a
    decimal of 38 digits, exact. Repeated rows give repeated rows. Other columns stay, but those of
    the added names are replaced; an empty table gives an empty result.

    The table is read three times: for lengths, for the fit list, which is written, and for the
    result. Copies are folded before the one shuffle, so a vector with very many copies is no skew.
    """
    spark = rows.sparkSession
    added = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    others = [c for c in rows.columns if c not in (*added, vector)]
    given = rows.select(*others, F.col(vector).cast("array<double>").alias("__v")).where(usable(F.col("__v")))
    lengths = given.groupBy(F.size("__v").alias("width")).agg(F.count("*").alias("c"))
    first = lengths.orderBy(F.desc("c"), F.desc("width")).first()
    width = first["width"] if first else 0
    given = given.where(F.size("__v") == width)
    fit = _fit_list(given, width)
    n, sums, products = exact_sums(fit, width) if width else (0, [], [])
    matrix = scatter(n, sums, products)
    trace = sum(matrix[k][k] for k in range(width))
    roots = charpoly.largest_roots(spark_charpoly(spark, matrix), components) if trace else []
    values = [charpoly.decimal_root(r) for r in roots]
    vectors = spark_vectors(spark, matrix, roots) if roots else np.zeros((0, width))
    # The centred grid vector times n has n * n times the variance, so n drops out.
    turn = (vectors / np.array([[float(v.sqrt())] for v in values]).reshape(-1, 1)).T
    total = np.array(sums, object)
    error = _identity_error(fit, width, n, total, turn) if roots else 0.0
    kept = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = _centred(_matrix(batch.column(kept), width), n, total)
            white = (centred.astype(np.float64) @ turn).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], _deviations(centred), pa.array(white, pa.list_(pa.float64()))],
                names=[*batch.schema.names[:kept], "deviation", "__white"],
            )

    schema = given.drop("__v").schema.add("deviation", T.DecimalType(38, 0)).add("__white", T.ArrayType(T.DoubleType()))
    shares = F.array(*(F.lit(float(v / trace)) for v in values)).cast("array<double>")
    made = given.mapInArrow(run, schema).select(*others, "deviation", F.posexplode("__white").alias("__k", "whitened"))
    return made.select(
        *others,
        (F.col("__k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("__k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
