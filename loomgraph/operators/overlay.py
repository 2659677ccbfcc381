"""Similarity overlay: the closest vectors from other files, above a threshold.

Exact at any size. Copies of a vector are folded first; then vectors are grouped into cells
around pivot vectors, and a vector is compared only with cells that can hold a match. Cells
are cut into slices of bounded size, so a cell that holds most of the rows is many tasks.
Within two slices products are taken in single precision; a pair whose product, or a bound of it
from a quarter of the axes, cannot reach the threshold or the best matches found so far is given
up, and what is left is multiplied exactly.

A vector is sent once to each slice that it is compared with. So slices grow with the vectors, as
far as a task's memory allows, and tiles are dealt to as many tasks as there are tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.dealing import settled
from loomgraph.functions.vectors import (
    EXACT_DIGITS, SCORE_DIGITS, as_matrix, leading_axes, unit_rows, vector_key, with_rest,
)

DEFAULT_MIN_SCORE = 0.78
DEFAULT_TOP_K = 5
#: Vectors of a slice: of few vectors, and at most, by their number and by their numbers in all. In
#: between, SLICES of all vectors, or as many as give each core two tiles.
TILE_ROWS = 2048
MOST_TILE_ROWS = 65536
MOST_TILE_VALUES = 2**23
SLICES = 8
#: Tasks among which the tiles are dealt, at most; a tile of TILE_ROWS or more is one of them.
TILE_TASKS = 4096
MAX_PIVOTS = 256
#: Rows of a tile that are multiplied at a time, with ever more columns up to about as many pairs.
BLOCK_ROWS = 512
FIRST_STEP = 256
STEP_PAIRS = BLOCK_ROWS * 4096
#: Columns that tell first what a row will find at least.
SAMPLE = 1024
#: Axes that a bound is worth its product from, and numbers gathered at a time for exact products.
LEAST_AXES = 8
PART_VALUES = 2**21



def overlay(
    rows: DataFrame,
    min_score: float = DEFAULT_MIN_SCORE,
    top_k: int = DEFAULT_TOP_K,
    scope: str | None = None,
    tile_rows: int | None = None,
    unique_ids: bool = True,
) -> DataFrame:
    """(src, dst, score) for the `top_k` best other-file matches of every id of `rows`.

    `rows` has `id`, `file` and `embedding`, and a `scope` column when several repositories
    share the frame: matches never cross scopes. Equal scores are ordered by `dst`. With
    `unique_ids` off an id may have several vectors; its best score with another id counts.
    """
    base, entries, _, left, right, tile = _tiles(rows, min_score, top_k, scope, tile_rows, unique_ids)
    id_type = rows.schema["id"].dataType.simpleString()
    matched = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        _tile_matches(min_score, top_k), f"_entry long, dst {id_type}, score double"
    )
    if not unique_ids:
        matched = matched.groupBy("_entry", "dst").agg(F.max("score").alias("score"))
    best = _best(matched, ["_entry"], top_k).join(
        entries.select("_entry", "_scope", "_key", "file"), "_entry"
    )
    edges = base.join(best, ["_scope", "_key", "file"]).select(
        "_scope", F.col("id").alias("src"), "dst", "score"
    )
    if not unique_ids:
        edges = edges.groupBy("_scope", "src", "dst").agg(F.max("score").alias("score"))
        edges = _best(edges, ["_scope", "src"], top_k)
    shown = [] if scope is None else [F.col("_scope").alias(scope)]
    return edges.select(*shown, "src", "dst", F.round("score", SCORE_DIGITS).alias("score"))


def overlay_work(
    rows: DataFrame,
    min_score: float = DEFAULT_MIN_SCORE,
    top_k: int = DEFAULT_TOP_K,
    scope: str | None = None,
    tile_rows: int | None = None,
    unique_ids: bool = True,
) -> DataFrame:
    """One row (possible, compared, full): what `overlay` would do with its pairs of vectors.

    `possible` counts the pairs of all vectors of a scope, `compared` those in cells that can hold
    a match, `full` those of other files whose product was taken to the end.
    """
    _, entries, candidates, left, right, tile = _tiles(rows, min_score, top_k, scope, tile_rows, unique_ids)
    done = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        _tile_work(min_score, top_k), "compared long, full long"
    )
    counts = entries.groupBy("_scope").agg(F.count(F.lit(1)).alias("_entries")).join(
        candidates.groupBy("_scope").agg(F.count(F.lit(1)).alias("_candidates")), "_scope"
    )
    none = F.lit(0).cast("long")
    parts = counts.select((F.col("_entries") * F.col("_candidates")).alias("possible"), none.alias("compared"), none.alias("full"))
    names = ["possible", "compared", "full"]
    return parts.unionByName(done.withColumn("possible", none)).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in names])


def _tiles(rows: DataFrame, min_score: float, top_k: int, scope: str | None, tile_rows: int | None, unique_ids: bool):
    """The vectors, folded, and both sides of the tiles in which they are compared."""
    base = rows.select(
        (F.lit("") if scope is None else F.col(scope)).alias("_scope"),
        "id",
        "file",
        "embedding",
        vector_key(F.col("embedding")).alias("_key"),
    ).where(F.col("_key").isNotNull())
    if not unique_ids:
        base = base.dropDuplicates(["_scope", "_key", "file", "id"])

    # Of each vector's copies only these can rank: `top_k` per file, in `top_k` + 1 files.
    in_file = Window.partitionBy("_scope", "_key", "file").orderBy("id")
    per_file = base.withColumn("_n", F.row_number().over(in_file)).where(F.col("_n") <= top_k)
    entries = per_file.groupBy("_scope", "_key", "file").agg(
        F.min("id").alias("_first"),
        F.collect_list("id").alias("_ids"),
        F.first("embedding").alias("embedding"),
    ).withColumn("_entry", F.monotonically_increasing_id())
    entries = settled(entries)
    if tile_rows is None:
        count, width = entries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        slices = max(SLICES, math.ceil(math.sqrt(2 * rows.sparkSession.sparkContext.defaultParallelism)))
        most = max(TILE_ROWS, min(MOST_TILE_ROWS, MOST_TILE_VALUES // (width or 1)))
        tile_rows = min(most, max(TILE_ROWS, -(-count // slices)))
    else:
        count = entries.count()
    by_vector = Window.partitionBy("_scope", "_key").orderBy("_first")
    candidates = (
        entries.withColumn("_n", F.row_number().over(by_vector))
        .where(F.col("_n") <= top_k + 1)
        .select("_scope", "file", "embedding", "_ids", F.col("_first" if unique_ids else "_entry").alias("_deal"))
    )

    pivots = _pivots(entries, count, tile_rows)
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * min_score)) + 1e-6
    home, reachable = F.lit(0), F.array(F.lit(0))
    if len(pivots) > 1:
        home = _home_cell(pivots)("embedding")
        reachable = _reachable_cells(pivots, radius)("embedding")
    homes = candidates.withColumn("_cell", home)
    probes = entries.select(
        "_scope", "_entry", "file", "embedding", F.explode(reachable).alias("_cell")
    )
    home_size = homes.groupBy("_scope", "_cell").agg(_slices(tile_rows).alias("_c_slices"))
    probe_size = probes.groupBy("_scope", "_cell").agg(_slices(tile_rows).alias("_p_slices"))
    tile = ["_scope", "_cell", "_p", "_c"]
    sizes = settled(home_size.join(probe_size, ["_scope", "_cell"]))
    tiles = sizes.agg(F.sum(F.col("_c_slices") * F.col("_p_slices"))).first()[0] or 1
    whole = min(tiles, tiles * tile_rows**2 // TILE_ROWS**2)  # several small tiles make a task
    tasks = min(TILE_TASKS, max(whole, rows.sparkSession.sparkContext.defaultParallelism))
    if scope is None:
        sizes = F.broadcast(sizes)  # at most MAX_PIVOTS rows
    left = (
        probes.join(sizes, ["_scope", "_cell"])
        .withColumn("_p", F.pmod(F.xxhash64("_entry"), F.col("_p_slices")))
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c_slices") - 1)))
        .select(*tile, "_entry", "file", "embedding")
    )
    right = (
        homes.join(sizes, ["_scope", "_cell"])
        .withColumn("_c", F.pmod(F.xxhash64("_deal"), F.col("_c_slices")))
        .withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p_slices") - 1)))
        .select(*[F.col(c).alias(c) for c in (*tile, "_ids", "file", "embedding")])
    )
    # Tasks of Spark's own number would each sort, and spill, a share that grows with the copies.
    return base, entries, candidates, left.repartition(tasks, *tile), right.repartition(tasks, *tile), tile


def _best(edges: DataFrame, key: list[str], top_k: int) -> DataFrame:
    ranked = Window.partitionBy(*key).orderBy(F.desc("score"), "dst")
    return edges.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= top_k).drop("_n")


def _slices(tile_rows: int):
    return F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("long")


def _pivots(entries: DataFrame, count: int, tile_rows: int) -> np.ndarray:
    """At most MAX_PIVOTS vectors picked by hash order; more rows, more pivots."""
    wanted = min(MAX_PIVOTS, math.ceil(count / tile_rows))
    if wanted <= 1:
        return np.zeros((0, 0))
    picked = entries.orderBy(F.xxhash64("_scope", "_key", "file"), "_entry").limit(wanted).select("embedding")
    return unit_rows(np.asarray([r[0] for r in picked.collect()], dtype="float64"))


def _squared_distances(rows: pa.Array, pivots: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 2.0 - 2.0 * (unit_rows(as_matrix(rows)) @ pivots.T))


def _home_cell(pivots: np.ndarray):
    @F.arrow_udf("int")
    def cell(rows: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], type=pa.int32())
        return pa.array(_squared_distances(rows, pivots).argmin(axis=1), type=pa.int32())

    return cell.asNondeterministic()


def _reachable_cells(pivots: np.ndarray, radius: float):
    """Cells that may hold a vector within `radius`.

    A vector of cell j lies on j's side of the plane halfway between j and any other pivot,
    so a cell is out of reach when that plane is further away than `radius`.
    """

    @F.arrow_udf("array<int>")
    def cells(rows: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], type=pa.list_(pa.int32()))
        squared = _squared_distances(rows, pivots)
        home = squared.argmin(axis=1)
        between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots @ pivots.T)))[home]
        margin = squared - squared[np.arange(len(home)), home][:, None]
        near = margin <= 2.0 * between * radius + 1e-9
        return pa.array([np.flatnonzero(r).tolist() for r in near], type=pa.list_(pa.int32()))

    return cells.asNondeterministic()


def _best_of_tile(left: pa.Table, right: pa.Table, min_score: float, top_k: int):
    """(row of `left`, place in the ids of `right`, score) of the best `top_k` ids of each row, and the exact products.

    Both sides are put in the order of their files, so that pairs of one file are few blocks. A block
    of pairs is multiplied in single precision, whose error has a bound; only pairs that can still
    reach what their row has found are multiplied exactly. Where the leading axes alone tell that
    hardly any pair can, the others are not looked at. A vector that many ids share is one column.
    """
    probes = unit_rows(as_matrix(left["embedding"]))
    width = probes.shape[1]
    found = unit_rows(as_matrix(right["embedding"], width))
    codes = pa.concat_arrays([*left["file"].chunks, *right["file"].chunks])
    codes = np.asarray(codes.dictionary_encode(null_encoding="encode").indices)
    lists = right["_ids"].combine_chunks()
    ids, lengths = lists.flatten(), np.asarray(pc.list_value_length(lists))
    rank = np.asarray(pc.rank(ids, tiebreaker="dense")).astype(np.int64) - 1
    places = np.zeros(rank.max(initial=-1) + 1, np.int64)
    places[rank[::-1]] = np.arange(len(rank))[::-1]

    rows = np.flatnonzero(np.isfinite(probes).all(axis=1))
    rows = rows[np.argsort(codes[rows], kind="stable")]
    cols = np.flatnonzero(np.isfinite(found).all(axis=1) & (lengths > 0))
    cols = cols[np.argsort(codes[len(left) + cols], kind="stable")]
    begins, lengths = (np.cumsum(lengths) - lengths)[cols], lengths[cols]
    row_codes, col_codes = codes[rows], codes[len(left) + cols]
    probes, found = probes[rows], found[cols]
    short, short_found = probes.astype(np.float32), found.astype(np.float32)
    slack = (width + 8) * 2.0**-23
    bounding = width >= 4 * LEAST_AXES and len(rows) > 0 and len(cols) > 0
    bound = bound_found = None
    if bounding:
        axes = leading_axes(probes, found)[:, : width // 4]
        bound, bound_found = with_rest(probes @ axes), with_rest(found @ axes)
    # Columns with an id each that none of the others stands for: `top_k` of them are as many ids.
    sample = np.sort(np.unique(rank[begins], return_index=True)[1])
    sample = sample[:: max(1, -(-len(sample) // SAMPLE))]

    scores = np.full((len(rows), top_k), -np.inf)
    ranks = np.full((len(rows), top_k), len(places), np.int64)
    full, block = 0, max(1, min(BLOCK_ROWS, len(rows)))
    most = max(FIRST_STEP, STEP_PAIRS // block)
    held, marks = np.empty(block * most, np.float32), np.empty(block * most, bool)
    repeats = len(places) < len(rank)
    for begin in range(0, len(rows), block):
        here = slice(begin, min(begin + block, len(rows)))
        n = here.stop - begin
        own = row_codes[here]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = np.r_[heads[1:], n]
        floor = np.full(n, min_score)
        if len(sample) >= top_k:
            some = short[here] @ short_found[sample].T
            _leave_out(some, heads, ends, own, col_codes[sample])
            reached = np.partition(some, -top_k, axis=1)[:, -top_k].astype(np.float64)
            floor = np.maximum(floor, reached - slack)
        best, best_ranks = scores[here], ranks[here]
        at, step = 0, FIRST_STEP
        while at < len(cols):
            stop, step = min(at + step, len(cols)), min(2 * step, most)
            there, at = slice(at, stop), stop
            block_codes = col_codes[there]
            if len(heads) == 1 and block_codes[0] == block_codes[-1] == own[0]:
                continue
            least = (floor - slack).astype(np.float32)[:, None]
            shape = (n, len(block_codes))
            part, near = held[: n * shape[1]].reshape(shape), marks[: n * shape[1]].reshape(shape)
            for a, b in [(bound, bound_found)] * bounding + [(short, short_found)]:
                np.matmul(a[here], b[there].T, out=part)
                _leave_out(part, heads, ends, own, block_codes)
                np.greater_equal(part, least, out=near)
                if a is bound and np.count_nonzero(near) * 32 <= near.size:
                    break
                # If most steps behind are like this one, their products are taken as they come.
                bounding = bounding and a is bound and step < most
            hits = np.flatnonzero(near)
            if not len(hits):
                continue
            full += len(hits)
            row, col = np.divmod(hits, near.shape[1])
            if len(hits) * 8 > near.size:
                exact = (probes[here] @ found[there].T).ravel()[hits]
            else:
                exact = _products(probes[here], found[there], row, col)
            exact = np.round(exact, EXACT_DIGITS)
            last = best[row, -1]
            keep = (exact >= floor[row]) & (exact >= last)
            row, col, exact = row[keep], col[keep] + there.start, exact[keep]
            # From columns to their ids.
            many = lengths[col]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            id_ranks = rank[np.repeat(begins[col], many) + nth]
            row, exact = np.repeat(row, many), np.repeat(exact, many)
            # Equal scores are in the order of their ids.
            keep = (exact > best[row, -1]) | (id_ranks < best_ranks[row, -1])
            _put(best, best_ranks, row[keep], exact[keep], id_ranks[keep], len(places), repeats)
            floor = np.maximum(floor, best[:, -1])
    row, col = np.nonzero(np.isfinite(scores))
    return rows[row], places[ranks[row, col]], scores[row, col], full


def _leave_out(part: np.ndarray, heads: np.ndarray, ends: np.ndarray, own: np.ndarray, codes: np.ndarray) -> None:
    """Make pairs of one file -inf; rows are in stretches `heads` to `ends` of a file, columns in its order."""
    files = own[heads]
    first, last = np.searchsorted(codes, files, "left"), np.searchsorted(codes, files, "right")
    for k in np.flatnonzero(first < last):
        part[heads[k] : ends[k], first[k] : last[k]] = -np.inf


def _products(left: np.ndarray, right: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    out = np.empty(len(row))
    step = max(1, PART_VALUES // left.shape[1])
    for at in range(0, len(row), step):
        part = slice(at, at + step)
        out[part] = np.einsum("ij,ij->i", left[row[part]], right[col[part]])
    return out


def _put(
    best: np.ndarray, ranks: np.ndarray, row: np.ndarray, score: np.ndarray, rank: np.ndarray, none: int, repeats: bool
) -> None:
    """Put (row, score, rank of an id) among the best of their rows, given in the order of these.

    An id that has `repeats` counts once, with its best score.
    """
    if not len(row):
        return
    touched, width = row[np.r_[True, row[1:] != row[:-1]]], best.shape[1]
    row = np.concatenate([np.repeat(touched, width), row])
    score = np.concatenate([best[touched].ravel(), score])
    rank = np.concatenate([ranks[touched].ravel(), rank])
    found = np.isfinite(score)
    row, score, rank = row[found], score[found], rank[found]
    if repeats:
        order = np.lexsort((-score, rank, row))
        row, score, rank = row[order], score[order], rank[order]
        once = np.r_[True, (row[1:] != row[:-1]) | (rank[1:] != rank[:-1])]
        row, score, rank = row[once], score[once], rank[once]
    order = np.lexsort((rank, -score, row))
    row, score, rank = row[order], score[order], rank[order]
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    nth = np.arange(len(row)) - np.repeat(heads, np.diff(np.r_[heads, len(row)]))
    kept = nth < width
    best[touched], ranks[touched] = -np.inf, none
    best[row[kept], nth[kept]], ranks[row[kept], nth[kept]] = score[kept], rank[kept]


def _tile_work(min_score: float, top_k: int):
    schema = pa.schema([("compared", pa.int64()), ("full", pa.int64())])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        full = _best_of_tile(left, right, min_score, top_k)[3]
        return pa.table({"compared": [len(left) * len(right)], "full": [int(full)]}, schema=schema)

    return count


def _tile_matches(min_score: float, top_k: int):
    """Best `top_k` candidates of each probe within one tile of bounded size."""

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        names = pa.schema(
            [("_entry", pa.int64()), ("dst", right.schema.field("_ids").type.value_type), ("score", pa.float64())]
        )
        if not len(left) or not len(right):
            return names.empty_table()
        row, place, score, _ = _best_of_tile(left, right, min_score, top_k)
        ids = right["_ids"].combine_chunks().flatten()
        return pa.table(
            {"_entry": left["_entry"].take(pa.array(row)), "dst": ids.take(pa.array(place)), "score": pa.array(score)},
            schema=names,
        )

    return match
