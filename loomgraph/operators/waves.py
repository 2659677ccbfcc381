"""Work planning: which issues touch shared files, and in which wave each can run.

Touch sets are one row per file: the batch columns, `issue` and `file`. Issues are ordered
within their batch by `issue`, numerically when it is a number and as text otherwise.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.functions.text import trim
from loomgraph.operators.dealing import dealt
from loomgraph.session import ensure_checkpoint_dir

WARNING_MIN_COUNT = 3
SLICE_ISSUES = 1000
#: Rows of a batch, or of a part of one, that one task plans in a pass; and rows of a block beyond that.
PASS_ROWS = 100_000
BLOCK_ROWS = 50_000
USED_TYPE = T.ArrayType(T.ArrayType(T.IntegerType()))


def touch_rows(sets: DataFrame, batch: list[str] = ()) -> DataFrame:
    """Explode (issue, files) rows into trimmed, distinct (issue, file) rows."""
    return sets.select(
        *batch, "issue", F.explode_outer("files").alias("file")
    ).withColumn("file", trim(F.col("file"))).distinct()


def local_touch_sets(spark, sets: list[dict]) -> DataFrame:
    """(issue, files) frame of the caller's list; ids must be all numbers or all strings."""
    ids = [s["issue"] for s in sets]
    numeric = all(isinstance(i, (int, float)) and not isinstance(i, bool) for i in ids)
    if not numeric and not all(isinstance(i, str) for i in ids):
        raise ValueError("issue ids must be all numbers or all strings")
    if len(set(ids)) != len(ids):
        raise ValueError("issue ids must be unique")
    whole = numeric and all(float(i).is_integer() for i in ids)
    kind = T.LongType() if whole else T.DoubleType() if numeric else T.StringType()
    convert = int if whole else float if numeric else str
    schema = T.StructType(
        [T.StructField("issue", kind), T.StructField("files", T.ArrayType(T.StringType()))]
    )
    return spark.createDataFrame([(convert(s["issue"]), list(s["files"])) for s in sets], schema)


def shared_files(touches: DataFrame, batch: list[str] = ()) -> DataFrame:
    """(a, b, n_shared, first_shared) of each pair of issues with a common file, a before b."""
    rows = touches.where(F.col("file").isNotNull()).select(*batch, "issue", "file").distinct()
    left = rows.withColumnRenamed("issue", "a")
    right = rows.withColumnRenamed("issue", "b")
    return (
        left.join(right, [*batch, "file"])
        .where(F.col("a") < F.col("b"))
        .groupBy(*batch, "a", "b")
        .agg(F.count(F.lit(1)).alias("n_shared"), F.min("file").alias("first_shared"))
    )


def conflicts(touches: DataFrame, batch: list[str] = ()) -> DataFrame:
    """(a, b, reason): two issues conflict when they touch a common file."""
    return shared_files(touches, batch).select(
        *batch, "a", "b", F.concat(F.lit("both touch "), F.col("first_shared")).alias("reason")
    )


def file_issues(
    touches: DataFrame, batch: list[str] = (), slice_issues: int = SLICE_ISSUES
) -> DataFrame:
    """(file, slice, issues) of each file that several issues touch: conflicts without pairs.

    All issues of a file conflict with each other. They come in order, in slices of at most
    `slice_issues`, so a file that very many issues touch is many bounded rows.
    """
    rows = _settled(touches.where(F.col("file").isNotNull()).select(*batch, "issue", "file").distinct())
    on_file, count = [*batch, "file"], rows.count()
    placed = dealt(rows, count, *on_file)
    several = placed.groupBy(*on_file).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    nth = F.row_number().over(Window.partitionBy(*on_file).orderBy("issue")) - 1
    numbered = placed.join(several.hint("merge"), on_file, "left_semi").withColumn("_at", nth)
    return numbered.groupBy(*on_file, F.floor(F.col("_at") / slice_issues).cast("int").alias("slice")).agg(
        F.array_sort(F.collect_list("issue")).alias("issues")
    )


def conflicts_of(touches: DataFrame, issues: list, batch: list[str] = ()) -> DataFrame:
    """(issue, other, reason) of the conflicts of a few asked issues."""
    rows = _settled(touches.where(F.col("file").isNotNull()).select(*batch, "issue", "file").distinct())
    on_file, count = [*batch, "file"], rows.count()
    asked = dealt(rows.where(F.col("issue").isin(issues)), count, *on_file)
    others = dealt(rows.withColumnRenamed("issue", "other"), count, *on_file)
    shared = others.join(asked.hint("merge"), on_file).where(F.col("issue") != F.col("other"))
    return shared.groupBy(*batch, "issue", "other").agg(
        F.concat(F.lit("both touch "), F.min("file")).alias("reason")
    )


def waves(
    touches: DataFrame, batch: list[str] = (), most_rows: int = PASS_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(issue, wave): each issue gets the lowest wave free of the earlier issues it conflicts with.

    Batches of at most `most_rows` rows are shuffled by batch, sorted and planned in one pass each.
    Larger ones are first split into what their files connect; the parts are planned alike. A part
    that is still larger is planned in blocks of about `block_rows` rows in order of its issues: a
    block needs from earlier ones only which waves are in use on its files, as intervals. So no
    task holds more than a bounded number of rows, and no state grows with the number of waves:
    files on which all issues meet have one interval. Blocks of one part follow each other, as each
    wave depends on all earlier ones; those of different parts and batches go side by side.
    """
    keys = list(batch)
    # Read for sizes and again for the plan, and costly to make as a rule.
    rows = _settled(touches.select(*keys, "issue", "file").distinct())
    count = rows.count()
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > most_rows).drop("_n")
    if not keys:
        whole = large.isEmpty()
        small, rest = (rows, None) if whole else (None, rows)
    else:
        large = _settled(large)
        small = rows if large.isEmpty() else rows.join(large, _same(rows, large, keys), "left_anti")
        rest = None if small is rows else rows.join(large, _same(rows, large, keys), "left_semi")
    if rest is None:
        return _planned(small, keys, count)
    parts = _settled(_connected(_settled(rest), keys))
    of_part = [*keys, "_part"]
    giant = parts.groupBy(*of_part).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_rows)
    giant = _settled(giant.drop("_n"))
    done = _planned(parts.join(giant, _same(parts, giant, of_part), "left_anti"), of_part, count).drop("_part")
    if small is not None:
        done = done.unionByName(_planned(small, keys, count))
    blocks = _in_blocks(parts.join(giant, _same(parts, giant, of_part), "left_semi"), of_part, block_rows)
    return done.unionByName(blocks.drop("_part"))


def _settled(rows: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    """Batches are equal also where their columns are null."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def _connected(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with `_part`, the smallest issue that their issue is connected with through files.

    Every issue takes the smallest part of its files, then the part of that part, until nothing
    changes; chains of parts halve in each round.
    """
    parts = rows.select(*keys, "issue").distinct().withColumn("_part", F.col("issue"))
    changed = 1
    while changed:
        placed = _looked_up(rows, parts, [*keys, "issue"], "_part")
        on_file = placed.where(F.col("file").isNotNull()).groupBy(*keys, "file").agg(F.min("_part").alias("_least"))
        near = _looked_up(placed, on_file, [*keys, "file"], "_least")
        least = near.groupBy(*keys, "issue").agg(
            F.min("_part").alias("_was"), F.min(F.coalesce("_least", "_part")).alias("_issue")
        )
        next_ = parts.select(*keys, F.col("issue").alias("_issue"), F.col("_part").alias("_next"))
        jumped = _looked_up(least, next_, [*keys, "_issue"], "_next")
        parts = _settled(jumped.select(*keys, "issue", "_was", F.least("_issue", "_next").alias("_part")))
        changed = parts.where(F.col("_was") != F.col("_part")).limit(1).count()
        parts = parts.drop("_was")
    return _looked_up(rows, parts, [*keys, "issue"], "_part")


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows with the value that `table` has for their keys; null keys are keys."""
    named = table.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), value)
    on = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)))
    return rows.join(named, on, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def _in_blocks(rows: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Waves of large parts, block after block, each with what earlier ones left in use."""
    spark = rows.sparkSession
    count = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-count // block_rows)), *keys, "issue")
    ranged = _settled(ranged.withColumn("_at", F.spark_partition_id()))
    # One row per block and part: a part's blocks are numbered in order.
    order = Window.partitionBy(*keys).orderBy("_at")
    numbers = ranged.select(*keys, "_at").distinct().withColumn("_block", F.row_number().over(order))
    blocks = _settled(_looked_up(ranged, numbers, [*keys, "_at"], "_block").drop("_at"))
    last = blocks.agg(F.max("_block")).first()[0] or 0
    used = spark.createDataFrame([], blocks.select(*keys, "file").schema.add("used", USED_TYPE))
    done = []
    for block in range(1, last + 1):
        own = blocks.where(F.col("_block") == block).drop("_block")
        used_on = _looked_up(own, used, [*keys, "file"], "used")
        made = _settled(_planned(used_on, keys, own.count(), keep_used=True))
        done.append(made.where("file IS NULL").select(*keys, "issue", "wave"))
        touched = made.where("file IS NOT NULL").select(*keys, "file", "used")
        used = _settled(used.join(touched, _same(used, touched, [*keys, "file"]), "left_anti").unionByName(touched))
    if not done:
        return rows.select(*keys, "issue", F.lit(0).alias("wave")).limit(0)
    return reduce(DataFrame.unionByName, done)


def _planned(rows: DataFrame, keys: list[str], count: int, keep_used: bool = False) -> DataFrame:
    """Waves of groups of bounded size, each read in order of its issues; `count` rows at most.

    With `keep_used`, rows have the intervals of waves in `used` on their file before, and the
    result has a row per file, with `file` and `used`, besides those per issue.
    """
    columns = [*keys, "issue", "file", *(["used"] if keep_used else [])]
    placed = dealt(rows, count, *keys) if keys else rows.repartition(1)
    ordered = placed.sortWithinPartitions(*keys, "issue").select(*columns)
    kept = [T.StructField(f.name, f.dataType) for f in ordered.schema if f.name not in ("file", "used")]
    schema = T.StructType(kept).add("wave", T.IntegerType())
    if keep_used:
        schema = schema.add("file", T.StringType()).add("used", USED_TYPE)
    arrow = to_arrow_schema(schema)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for row in _first_free_waves(_rows(batches), len(keys), keep_used):
            done.append(row)
            if len(done) == 10_000:
                yield _record(done, arrow)
                done = []
        yield _record(done, arrow)

    return ordered.mapInArrow(plan, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _first_free_waves(rows: Iterator[tuple], n_keys: int, keep_used: bool) -> Iterator[tuple]:
    """(*keys, issue, wave) of (*keys, issue, file) rows sorted by keys and issue, group by group."""
    for group, own in groupby(rows, lambda r: r[:n_keys]):
        used: dict[str, Waves] = {}
        for issue, touching in groupby(own, lambda r: r[n_keys]):
            files = []
            for row in touching:
                file = row[n_keys + 1]
                if file is None:
                    continue
                if file not in used:
                    used[file] = Waves((row[n_keys + 2] if keep_used else None) or ())
                files.append(used[file])
            free = lowest_free(files)
            for waves_of_file in files:
                waves_of_file.add(free)
            yield (*group, issue, free, None, None) if keep_used else (*group, issue, free)
        if keep_used:
            for file, taken in used.items():
                yield (*group, None, None, file, taken.intervals())


class Waves:
    """A set of waves as intervals in order: `low[i]` to `high[i]`, with gaps between them."""

    def __init__(self, intervals=()):
        self.low = [i[0] for i in intervals]
        self.high = [i[1] for i in intervals]

    def after(self, wave: int) -> int:
        """The first wave from `wave` on that is not in the set."""
        i = bisect_right(self.low, wave) - 1
        return self.high[i] + 1 if i >= 0 and self.high[i] >= wave else wave

    def add(self, wave: int) -> None:
        """Put in a wave that is not in the set."""
        i = bisect_right(self.low, wave)
        joins_left, joins_right = i > 0 and self.high[i - 1] == wave - 1, i < len(self.low) and self.low[i] == wave + 1
        if joins_left and joins_right:
            self.high[i - 1] = self.high.pop(i)
            self.low.pop(i)
        elif joins_left:
            self.high[i - 1] = wave
        elif joins_right:
            self.low[i] = wave
        else:
            self.low.insert(i, wave)
            self.high.insert(i, wave)

    def intervals(self) -> list[list[int]]:
        return [[a, b] for a, b in zip(self.low, self.high, strict=True)]


def lowest_free(sets: list[Waves]) -> int:
    """The lowest wave that is in none of the sets."""
    wave, before = 0, -1
    while wave != before:
        before = wave
        for taken in sets:
            wave = taken.after(wave)
    return wave


def independent_set(wave_rows: DataFrame) -> DataFrame:
    """Issues of the first wave."""
    return wave_rows.where(F.col("wave") == 0).drop("wave")


def coupling_warnings(
    touches: DataFrame,
    co_changes: DataFrame,
    batch: list[str] = (),
    min_count: int = WARNING_MIN_COUNT,
) -> DataFrame:
    """(issue, file, coupled_to, count): another issue of the batch touches a coupled file.

    Whether a different issue touches a file needs only its first and last issue, so the
    owners of a file are never joined with each other.
    """
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    rows = touches.where(F.col("file").isNotNull()).select(*batch, "issue", "file").distinct()
    strong = co_changes.where(F.col("count") >= min_count)
    coupled = strong.select(
        F.col("file_a").alias("file"), F.col("file_b").alias("coupled_to"), "count"
    ).unionByName(
        strong.select(F.col("file_b").alias("file"), F.col("file_a").alias("coupled_to"), "count")
    )
    owners = rows.groupBy(*batch, F.col("file").alias("_owned")).agg(
        F.min("issue").alias("_low"), F.max("issue").alias("_high")
    )
    return (
        rows.join(coupled, "file")
        .withColumn("_owned", trim(F.col("coupled_to")))
        .join(owners, [*batch, "_owned"])
        .where((F.col("_low") != F.col("issue")) | (F.col("_high") != F.col("issue")))
        .select(*batch, "issue", "file", "coupled_to", "count")
        .distinct()
    )


def plan(
    touches: DataFrame, co_changes: DataFrame, batch: list[str] = (), min_count: int = WARNING_MIN_COUNT
) -> DataFrame:
    """(issue, wave, independent, n_files, n_shared_files, n_warnings), one row for each issue.

    What the whole plan says of an issue: its wave, whether that is the first, how many files it
    touches, how many of those another issue of the batch touches too, and its coupling warnings.
    Files are counted once per batch; issues of a file are never paired. Issues without a file and
    batches that are null are kept.
    """
    of_issue, on_file = [*batch, "issue"], [*batch, "file"]
    rows = _settled(touches.select(*of_issue, "file").distinct())
    touched = rows.where(F.col("file").isNotNull())
    users = touched.groupBy(*on_file).agg(F.count(F.lit(1)).alias("_users")).where(F.col("_users") > 1)
    files = _looked_up(touched, users, on_file, "_users").groupBy(*of_issue).agg(
        F.count(F.lit(1)).alias("n_files"), F.count("_users").alias("n_shared_files")
    )
    warned = coupling_warnings(touched, co_changes, batch, min_count).groupBy(*of_issue).agg(
        F.count(F.lit(1)).alias("n_warnings")
    )
    planned = waves(rows, batch).withColumn("independent", F.col("wave") == 0)
    for counts, names in ((files, ["n_files", "n_shared_files"]), (warned, ["n_warnings"])):
        found = counts.select(*of_issue, F.struct(*names).alias("_found"))
        planned = _looked_up(planned, found, of_issue, "_found").withColumns(
            {name: F.coalesce(F.col("_found")[name], F.lit(0)) for name in names}
        ).drop("_found")
    return planned
