"""Vector expressions, run as Arrow batches in numpy.

They are marked non-deterministic only to keep the optimizer from evaluating them twice, once
in a pushed filter and once for the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 6
#: Digits by which scores are ranked; the rest is rounding noise.
EXACT_DIGITS = 12


def as_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a float64 matrix of `width` columns, by default as its first row.

    A row that is null or has another length is NaN throughout, and so is all computed from it.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    known = lengths[lengths >= 0]
    width = width if width is not None else int(known[0]) if len(known) else 0
    fits = lengths == width
    out = np.full((len(column), width), np.nan)
    flat = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    out[fits] = flat.astype("float64").reshape(int(fits.sum()), width)
    return out


def list_array(matrix: np.ndarray) -> pa.Array:
    """A list column with one row per row of `matrix`."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype="int32") * width)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row becomes NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def leading_axes(*sides: np.ndarray) -> np.ndarray:
    """An orthogonal matrix that turns the rows so that their first axes hold most of their length."""
    scatter = sum(np.nan_to_num(rows).T @ np.nan_to_num(rows) for rows in sides)
    return np.linalg.eigh(scatter)[1][:, ::-1]


def with_rest(rows: np.ndarray) -> np.ndarray:
    """Single precision rows, of the first axes of unit rows, with the length that the other axes hold behind.

    The product of two such rows is at least that of the unit rows, but for rounding.
    """
    rest = np.sqrt(np.maximum(0.0, 1.0 - (rows * rows).sum(axis=1, keepdims=True)))
    return np.concatenate([rows, rest], axis=1).astype(np.float32)


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, type=pa.float64(), from_pandas=True)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to one fixed vector; NULL for zero, null and other-sized vectors.

    Scores are exact to about the last digits, so that equal vectors score alike.
    """
    target = unit_rows(np.asarray([query], dtype="float64"))[0]

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return _nullable(np.round(unit_rows(as_matrix(rows, len(target))) @ target, EXACT_DIGITS))

    return score.asNondeterministic()(vector)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of two vector columns; NULL when either is zero or null, or sizes differ."""

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.full(len(a), np.nan)
        sizes = pc.list_value_length(a)
        for size in filter(None, pc.unique(sizes).to_pylist()):
            dots = (unit_rows(as_matrix(a, size)) * unit_rows(as_matrix(b, size))).sum(axis=1)
            at = pc.fill_null(pc.equal(sizes, size), False).to_numpy(zero_copy_only=False)
            out[at] = dots[at]
        return _nullable(np.round(out, SCORE_DIGITS))

    return score.asNondeterministic()(left, right)


def vector_key(vector: Column) -> Column:
    """128-bit digest that is equal for equal vectors; NULL for zero and null vectors."""
    backwards = F.xxhash64(F.reverse(vector), F.size(vector))
    key = F.concat_ws("-", F.hex(F.xxhash64(vector)), F.hex(backwards))
    return F.when(F.exists(vector, lambda x: x != 0), key)
