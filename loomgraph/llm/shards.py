"""Shards of near equal bytes by histogram sort: probe, count, refine, then exchange once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import settled

#: Bits of the key that a round refines: a splitter's range is cut into 2 to this power.
STEP = 6
#: How far the bytes below a splitter may be from their share, as a part of one shard.
TOLERANCE = 0.001
#: Rows that are numbered together within a shard, and bytes of text that one task numbers, about.
CELL_ROWS = 250_000
TASK_BYTES = 64_000_000
#: Cuts by the id within a cell, so that a large group of equal texts is many cells.
ID_CUTS = 16

LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Splitter:
    """A boundary (text hash, id hash) being looked for: keys below it go to lower shards.

    It lies in the 2 ** `bits` keys from `low` on: text hashes, or id hashes once `text` is set.
    """

    target: float
    low: int = LOW
    bits: int = 64
    below: int = 0
    text: int | None = None
    done: tuple[int, int] | None = None

    @property
    def width(self) -> int:
        return 1 << max(self.bits - STEP, 0)

    def part(self) -> Column:
        """The number of the sub-range that a row's key is in; null for keys out of range."""
        key = F.col("h1") if self.text is None else F.col("h2")
        shift = max(self.bits - STEP, 0)
        if self.bits == 64:
            part = F.shiftright(key, shift) - (LOW >> shift)
        else:
            part = F.shiftright(key - F.lit(self.low), shift)
        inside = key.between(F.lit(self.low), F.lit(self.low + (1 << self.bits) - 1))
        if self.text is not None:
            inside = inside & (F.col("h1") == F.lit(self.text))
        return F.when(inside, part.cast("int"))


def _counts(sizes: DataFrame, open_ones: list[tuple[int, Splitter]]) -> dict[tuple[int, int], int]:
    """Bytes in each sub-range of each open splitter: one aggregation over all rows."""
    columns = [F.struct(F.lit(i).alias("i"), s.part().alias("part")) for i, s in open_ones]
    rows = (
        sizes.select("size", F.explode(F.array(*columns)).alias("x"))
        .where(F.col("x.part").isNotNull())
        .groupBy("x.i", "x.part")
        .agg(F.sum("size").alias("bytes"))
    )
    return {(r["i"], r["part"]): r["bytes"] for r in rows.collect()}


def find_splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The `shards` - 1 boundaries over `sizes(h1, h2, size)`, each (text hash, id hash).

    Each round counts, exactly and over all rows, the bytes in the sub-ranges around every
    splitter that is still open, and keeps the sub-range that holds its share: at most 2 ** STEP
    numbers per splitter reach the driver, and at most 22 rounds are needed. A range of one text hash is refined by the hash of
    the id. Rows equal in both cannot be told apart and stay together.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    found = [Splitter(total * (k + 1) / shards) for k in range(shards - 1)]
    while open_ones := [(i, s) for i, s in enumerate(found) if s.done is None]:
        counts = _counts(sizes, open_ones)
        for i, s in open_ones:
            _refine(s, {part: n for (at, part), n in counts.items() if at == i}, slack)
    return [s.done for s in found]


def _refine(s: Splitter, counts: dict[int, int], slack: float) -> None:
    below, part, last = s.below, 0, (1 << min(STEP, s.bits)) - 1
    while part < last and below + counts.get(part, 0) < s.target:
        below += counts.get(part, 0)
        part += 1
    low, above = s.low + part * s.width, below + counts.get(part, 0)
    near, bound = min((abs(s.target - below), low), (abs(above - s.target), low + s.width))
    if near <= slack or (s.width == 1 and s.text is not None):
        s.done = (bound, LOW) if s.text is None else (s.text, bound)
    elif s.width == 1:
        s.text, s.low, s.bits, s.below = low, LOW, 64, below
    else:
        s.low, s.bits, s.below = low, s.bits - STEP, below


def _at_least(bound: tuple[int, int]) -> Column:
    text, own = bound
    if text > HIGH:
        return F.lit(False)
    first, second = F.col("h1"), F.col("h2")
    if own > HIGH:
        return first > F.lit(text)
    return (first > F.lit(text)) | ((first == F.lit(text)) & (second >= F.lit(own)))


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents with `shard`, 0 to `shards` - 1, and `slot`, gapless from 0 in each shard.

    A document weighs the UTF-8 bytes of its text plus 1 (`size`); the shards' weights differ by
    no more than the tolerance and one document. Documents are ordered by the hash of their text,
    then of their id, so equal texts are neighbours and lie in one shard unless a boundary has to
    cut their group. Null texts weigh 1 and are a group; null ids are an id. Rows equal in id and
    text stay in one shard, each with a slot. Columns named size, shard or slot are replaced.
    An empty table gives an empty result.

    Hashes and weights are written once and read by each round; whole rows are exchanged once,
    cut by hash ranges into cells of bounded rows. Slots are a cell's offset, from the counts of
    cells, plus the row's number in its cell.
    """
    docs = docs.drop("size", "shard", "slot")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    keyed = docs.withColumns(
        {"size": size, "h1": F.xxhash64("text", F.col("text").isNull()), "h2": F.xxhash64("doc_id", F.col("doc_id").isNull())}
    )
    sizes = settled(keyed.select("h1", "h2", "size"))
    bounds = find_splitters(sizes, shards, tolerance)
    shard = sum((_at_least(b).cast("int") for b in bounds), F.lit(0))
    # Cells by the leading bits of both hashes: about CELL_ROWS rows, also in a hot group.
    rows, size_of_all = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts = 1
    while cuts * ID_CUTS * min(CELL_ROWS, TASK_BYTES * max(rows, 1) // max(size_of_all, 1)) < rows:
        cuts *= 2
    cell = F.pmod(F.shiftright("h1", 20), F.lit(cuts)) * ID_CUTS + F.pmod(F.shiftright("h2", 20), F.lit(ID_CUTS))
    per_cell = sizes.groupBy(shard.alias("shard"), cell.alias("cell")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "cell").orderBy("h1", "h2", "doc_id")
    # The one exchange of whole rows: as many tasks as the texts need, and no fewer than is usual.
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, -(-size_of_all // TASK_BYTES))
    dealt = keyed.withColumns({"shard": shard, "cell": cell}).repartition(tasks, "shard", "cell")
    placed = dealt.withColumn("row", F.row_number().over(within))
    # Offsets grow with the rows, so whether they are small enough to be sent round is left to Spark;
    # beyond that they are joined where the rows are, which are dealt by these keys already.
    joined = placed.join(offsets, ["shard", "cell"])
    return joined.select(
        *docs.columns, "size", "shard", (F.col("offset") + F.col("row") - 1).cast("long").alias("slot")
    )
