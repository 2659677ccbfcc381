"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from loomgraph.llm.common import SALTS, components, join_counted, same, settled, small_batches, text_key
from loomgraph.llm.shingles import WordHashes, ascii_words, shingle_set

#: Bins of the one permutation, as bands of rows: of pairs at 0.85, less than one in 10 ** 10
#: shares no band; of pairs at 0.8, one in 2 * 10 ** 7.
BINS, BANDS = 128, 32
#: Shares of the union that make a link, in hundredths: of `near_groups`, as its contract has it,
#: and of stages that keep one of each group.
CONTRACT, ALIKE = 85, 80
#: Cells into which a set's shingles are counted, by hash: two sets share no more than their
#: cells have in common. FULL stands for as many or more.
CELLS, FULL = 256, 255
#: Members of a bucket that one task compares with its centres.
SLICE_MEMBERS = 4096
#: Members of a bucket from which on shingles that only one of them has are counted.
CROWD = 16
#: Centres of a bucket in each round after the first, which has one.
CENTRES = 512

_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_SALTS = np.random.default_rng(3).integers(1, 1 << 62, (BANDS, BINS // BANDS), dtype=np.uint64) | np.uint64(1)
#: For an empty bin, the order in which it asks the others: the first with a value gives it.
_DONORS = np.stack([np.random.default_rng(i).permutation(BINS) for i in range(BINS)])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least shingle hash in each bin of a sorted set, empty bins filled by donors."""
    at = np.searchsorted(shingles, _EDGES)
    filled = np.append(at[1:], len(shingles)) > at
    bins = shingles[np.minimum(at, len(shingles) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _DONORS[empty]
        bins[empty] = bins[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """A bucket key for each band; the salts differ by band, so keys of two bands do not meet."""
    keys = (bins.reshape(BANDS, -1) * _SALTS).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


def cell_counts(shingles: np.ndarray) -> bytes:
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def most_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles two sets share at most, from rows of cell counts."""
    least = np.minimum(a, b)
    return np.where((least == FULL).any(axis=1), 1 << 40, least.sum(axis=1, dtype=np.int64))


SKETCH = "doc_id {}, tkey long, n_shingles long, name binary, bands array<long>, cells binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: size and name (128-bit hash) of its shingle set, bucket keys, cell counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, names, bands, cells = [], [], [], []
                for text in part.column(2).to_pylist():
                    own = shingle_set(hashes.of(ascii_words(text or "")))
                    n.append(len(own))
                    if not len(own):
                        names.append(None), bands.append(None), cells.append(None)
                        continue
                    names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(signature(own)))
                    cells.append(cell_counts(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(names, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())), pa.array(cells, pa.binary()),
                    ],
                    ["doc_id", "tkey", "n_shingles", "name", "bands", "cells"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "text")
    return rows.mapInArrow(run, SKETCH.format(kind))


@arrow_udf(ArrayType(LongType()))
def shingles_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = WordHashes()
    for batch in texts:
        own = [shingle_set(hashes.of(ascii_words(t.as_py() or ""))).view(np.int64) for t in batch]
        ends = np.cumsum([0, *(len(s) for s in own)], dtype=np.int32)
        yield pa.ListArray.from_arrays(ends, np.concatenate([*own, np.zeros(0, np.int64)]))


def _rows_of(cells: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(-1, CELLS)


@arrow_udf(LongType())
def shared_at_most(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(most_common(_rows_of(left), _rows_of(right)))


def _may_link(n_a: Column, core_a: Column, n_b: Column, core_b: Column, threshold: int) -> Column:
    """Whether two sets can be linked, by their sizes and what each shares with anyone at most."""
    most = F.least(core_a, core_b, n_a, n_b)
    return (100 + threshold) * most >= threshold * (n_a + n_b)


def _sizes(members: DataFrame) -> DataFrame:
    """(key, sizes): the set sizes in each bucket, with their numbers."""
    per_size = members.groupBy("key", "n_shingles").agg(F.count("*").alias("n"))
    return per_size.groupBy("key").agg(F.collect_list(F.struct("n_shingles", "n")).alias("sizes"))


def _partner_sizes(threshold: int) -> Column:
    """Of the sizes of a member's bucket, those that a partner of it can have."""
    n, core = F.col("n_shingles"), F.col("core")
    return F.filter(
        "sizes",
        lambda s: _may_link(n, core, s["n_shingles"], s["n_shingles"], threshold)
        & ((s["n_shingles"] != n) | (s["n"] > 1)),
    )


def _with_core(placed: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Members (key, name, n_shingles, core, degree) of the buckets, without those that can have no link.

    core is the size less the shingles that no other set in a crowded bucket has: no set of such
    a bucket shares more with it. degree is the sum of the sizes of a set's buckets, which is
    largest for a text that others have been made from.
    """
    per_set = placed.groupBy("name").agg(F.sum("n").alias("degree"), F.max("n").alias("widest"))
    per_set = settled(per_set)
    crowd = per_set.where(F.col("widest") >= CROWD).select("name")
    private = (
        sets.join(crowd, "name", "left_semi")
        .select("name", F.explode("shingles").alias("s"))
        .groupBy("s")
        .agg(F.count("*").alias("n"), F.min("name").alias("name"))
        .where(F.col("n") == 1)
        .groupBy("name")
        .agg(F.count("*").alias("private"))
    )
    own = F.when(F.col("n") >= CROWD, F.coalesce("private", F.lit(0))).otherwise(0)
    members = (
        placed.join(per_set.select("name", "degree"), "name")
        .join(private, "name", "left")
        .select("key", "name", "n_shingles", (F.col("n_shingles") - own).alias("core"), "degree")
    )
    members = settled(members)
    viable = members.join(_sizes(members), "key").where(F.size(_partner_sizes(threshold)) > 0)
    return settled(viable.select(members.columns))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b, label_a, label_b), a before b, of pairs (name, label, c_name, c_label)."""
    ahead = F.col("name") < F.col("c_name")

    def either(left: str, right: str, name: str) -> Column:
        return F.when(ahead, F.col(left)).otherwise(F.col(right)).alias(name)

    return pairs.select(
        either("name", "c_name", "a"), either("c_name", "name", "b"),
        either("label", "c_label", "label_a"), either("c_label", "label", "label_b"),
    ).distinct()


def _star_pairs(members: DataFrame, centres: DataFrame, cells: DataFrame, threshold: int) -> DataFrame:
    """Pairs of each bucket's first centre and its other members that may be linked."""
    cols = ["name", "n_shingles", "core", "label"]
    stars = centres.select("key", *(F.col(c).alias(f"c_{c}") for c in cols))
    met = members.join(stars, "key").where(
        (F.col("label") != F.col("c_label"))
        & _may_link(F.col("n_shingles"), F.col("core"), F.col("c_n_shingles"), F.col("c_core"), threshold)
    )
    left = cells.select(F.col("name").alias("a"), F.col("n_shingles").alias("n_a"), F.col("cells").alias("cells_a"))
    right = cells.select(F.col("name").alias("b"), F.col("n_shingles").alias("n_b"), F.col("cells").alias("cells_b"))
    pairs = _ordered(met)
    both = pairs.join(left, "a").join(right, "b").withColumn("most", shared_at_most("cells_a", "cells_b"))
    return both.where((100 + threshold) * F.col("most") >= threshold * (F.col("n_a") + F.col("n_b"))).select(pairs.columns)


def _crowd_pairs(members: DataFrame, centres: DataFrame, cells: DataFrame, threshold: int) -> DataFrame:
    """The same for many centres in a bucket.

    Its members come in slices of about SLICE_MEMBERS, each with all the centres, and only pairs
    that sizes and cell counts allow leave a task.
    """
    slices = F.ceil(F.col("bucket") / SLICE_MEMBERS)
    left = members.where("open").withColumn("slice", F.pmod(F.xxhash64("name"), slices))
    right = centres.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    # Aliases, as both sides come from the same rows.
    cols = [F.col(c).alias(c) for c in ("key", "slice", "name", "label", "n_shingles", "cells")]
    left, right = (x.join(cells.select("name", "cells"), "name").select(cols) for x in (left, right))

    def tile(members: pa.Table, centres: pa.Table) -> pa.Table:
        return _tile_pairs(members, centres, threshold)

    pairs = (
        left.groupBy("key", "slice").cogroup(right.groupBy("key", "slice"))
        .applyInArrow(tile, "name binary, label binary, c_name binary, c_label binary")
    )
    return _ordered(pairs)


def _tile_pairs(members: pa.Table, centres: pa.Table, threshold: int) -> pa.Table:
    if not members.num_rows or not centres.num_rows:
        members, centres = members.slice(0, 0), centres.slice(0, 0)
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cells, n = _rows_of(members["cells"]), members["n_shingles"].to_numpy()
    labels = np.array(members["label"].to_pylist(), object)
    other_labels = centres["label"].to_pylist()
    for k, (own, size) in enumerate(zip(_rows_of(centres["cells"]), centres["n_shingles"].to_pylist(), strict=True)):
        may = (100 + threshold) * most_common(cells, own[None, :]) >= threshold * (n + size)
        at = np.flatnonzero(may & (labels != other_labels[k]))
        rows.append(at)
        columns.append(np.full(len(at), k))
    at, of = pa.array(np.concatenate(rows)), pa.array(np.concatenate(columns))
    return pa.table(
        {
            "name": members["name"].take(at), "label": members["label"].take(at),
            "c_name": centres["name"].take(of), "c_label": centres["label"].take(of),
        }
    )


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets meet the threshold."""
    left = sets.select(F.col("name").alias("a"), F.col("shingles").alias("own"))
    right = sets.select(F.col("name").alias("b"), F.col("shingles").alias("other"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("own", "other"))
    union = F.size("own") + F.size("other") - common
    return both.where(100 * common >= threshold * union).select("label_a", "label_b")


def _with_centres(members: DataFrame, most: int, first: bool) -> DataFrame:
    """Members with `centre`, `open` (their bucket has a centre), `bucket` (its size) and `spent`.

    Centres are up to `most` members of a bucket from outside its largest component that have not
    been one; `first` takes any. Those of the largest degree come first. All windows run on one
    shuffle by bucket, of slim rows.
    """
    by_key = Window.partitionBy("key")
    sized = (
        members.repartition("key")
        .withColumn("__n", F.count("*").over(Window.partitionBy("key", "label")))
        .withColumn("__main", F.max(F.struct("__n", "label")).over(by_key))
        .withColumn("bucket", F.count("*").over(by_key))
    )
    outside = F.lit(True) if first else F.col("label") != F.col("__main.label")
    waiting = outside & ~F.col("spent") & (F.col("bucket") > 1)
    order = by_key.orderBy(F.desc("__waiting"), F.desc("degree"), "name")
    ranked = sized.withColumn("__waiting", waiting).withColumn("__nth", F.row_number().over(order))
    chosen = ranked.withColumn("centre", F.col("__waiting") & (F.col("__nth") <= most))
    return chosen.withColumns(
        {"open": F.max("centre").over(by_key), "spent": F.col("spent") | F.col("centre")}
    ).drop("__n", "__main", "__waiting", "__nth")


def link_sets(members: DataFrame, cells: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(name, label) of the distinct sets in buckets: equal labels for those that links connect.

    Each bucket compares all its members with a few centres, never with each other. Members that
    a link has joined need no further test; what lies outside a bucket's largest component
    becomes a centre in its turn, CENTRES per round, until nothing outside is left that has not
    been one. So every two sets of a bucket are linked, connected or compared, while a
    bucket of near copies costs a few comparisons each. Links join labels, so each round's
    components are those of a graph that has shrunk by the links before.
    """
    tested = None
    labelled = members.withColumn("label", F.col("name")).withColumn("spent", F.lit(False))
    while True:
        first = tested is None
        state = settled(_with_centres(labelled, 1 if first else CENTRES, first))
        centres = state.where("centre")
        if centres.isEmpty():
            return state.select("name", "label").distinct()
        pairs = (_star_pairs if first else _crowd_pairs)(state, centres, cells, threshold)
        pairs = settled(pairs if first else pairs.join(tested, ["a", "b"], "left_anti"))
        links = settled(_linked(pairs, sets, threshold).distinct())
        pairs = pairs.select("a", "b")
        tested = pairs if first else tested.union(pairs)
        labelled = state.select(*members.columns, "label", "spent")
        if not links.isEmpty():
            joined = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
            labelled = labelled.join(joined, labelled["label"] == joined["node"], "left").select(
                *members.columns, F.coalesce("component", "label").alias("label"), "spent"
            )


def _grouped(docs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, chosen) of each row; see near_groups.

    chosen are the rows of one (doc_id, tkey) of each group, the smallest with nulls last, and
    all that have no shingle. Two groups can share a component_id, so it does not name a group.
    """
    small_batches(docs.sparkSession)
    rows = settled(sketches(docs))
    classes = settled(
        rows.where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(
            F.count("*").alias("n"),
            F.min("doc_id").alias("least"),
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tkey")).alias("sample"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("cells").alias("cells"),
        )
    )
    banded = classes.select("name", F.explode(F.array_distinct("bands")).alias("key"))
    buckets = settled(banded.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    placed = join_counted(banded, buckets, ["key"], "n").select("key", "name", "n")
    shared = classes.select("name", "n_shingles", "sample")
    placed = settled(placed.join(shared, "name"))
    wanted = placed.select("name", "sample.*").distinct().select("name", F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey"))
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "text")
    texts = keyed.join(
        wanted, same(keyed["doc_id"], wanted["__id"]) & (keyed["tkey"] == wanted["__tkey"])
    ).select("name", shingles_of("text").alias("shingles"))
    sets = settled(texts.dropDuplicates(["name"]))
    members = _with_core(placed.drop("sample"), sets, threshold)
    labels = link_sets(members, classes.select("name", "n_shingles", "cells"), sets, threshold)
    ids = classes.select("name", "n", "least", "sample").join(labels, "name", "left").withColumn(
        "label", F.coalesce("label", "name")
    )
    grouped = ids.groupBy("label").agg(F.min("least").alias("component_id"), F.min("sample").alias("first"))
    known = ids.join(grouped, "label").select("name", "n", "component_id", "first")
    named = rows.select("doc_id", "tkey", "n_shingles", "name")
    joined = join_counted(named.where(F.col("name").isNotNull()), settled(known), ["name"], "n")
    alone = named.where(F.col("name").isNull())
    chosen = same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("tkey") == F.col("first.tkey"))
    own = ["doc_id", "tkey", "n_shingles"]
    return joined.select(*own, "component_id", chosen.alias("chosen")).unionByName(
        alone.select(*own, F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen"))
    )


def near_groups(docs: DataFrame, threshold: int = CONTRACT) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, kept) for each row of `docs(doc_id, text)`.

    Words are runs of other than blanks and characters 9 to 13, with A-Z in lower case. A set
    has the distinct shingles of five words; fewer words are one shingle; a null, empty or blank
    text has none and is linked with nothing. Rows are linked when 100 * intersection >=
    threshold * union, confirmed on whole sets. component_id is the smallest non-null doc_id that can be
    reached, the row's own included; kept is doc_id = component_id, null equal to null, so
    repeated rows of a kept document are all kept. Extra columns are ignored.

    Equal sets are first folded into one, with map-side aggregation; a group of copies with many
    rows is joined back over several tasks. Whole texts are shuffled once, for the sets that
    share a bucket.
    """
    out = _grouped(docs, threshold).drop("chosen")
    return out.withColumn("kept", same(F.col("doc_id"), F.col("component_id")))


def drop_near_copies(docs: DataFrame, threshold: int = ALIKE, repeats: bool = True) -> DataFrame:
    """The documents without those that another document of their group stands for.

    Of each group the smallest (doc_id, text key) stays, nulls last: one text, also where several
    share an id or no row has one. Without `repeats`, rows of that id and text are reduced to one,
    any of them if they differ in further columns. Rows without a shingle are in no group.
    """
    marks = (
        _grouped(docs, threshold)
        .groupBy(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey"))
        .agg(F.count("*").alias("__n"), F.first("chosen").alias("__chosen"), F.max("n_shingles").alias("__size"))
        .where(~F.col("__chosen") | (F.col("__n") > 1) & (F.col("__size") > 0))
    )
    keyed = docs.withColumn("__own", text_key(F.col("text")))

    def among(marked: DataFrame) -> Column:
        return same(keyed["doc_id"], marked["__id"]) & (keyed["__own"] == marked["__tkey"])

    if repeats:
        dropped = marks.where(~F.col("__chosen"))
        return keyed.join(dropped, among(dropped), "left_anti").select(*docs.columns)
    marks = settled(marks)
    rest = keyed.join(marks, among(marks), "left_anti").select(*docs.columns)
    repeated = marks.where("__chosen").select("__id", "__tkey")
    if repeated.isEmpty():
        return rest
    # A repeated row is one key: its rows are dealt by place, and each task hands on one of them.
    keyed = keyed.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = repeated.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = keyed.join(copies, among(copies) & (keyed["__salt"] == copies["__part"]), "left_semi")
    return rest.unionByName(found.dropDuplicates(["doc_id", "__own"]).select(*docs.columns))
