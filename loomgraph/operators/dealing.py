"""Rows dealt to tasks by their number, and joins on keys that very many rows share.

Spark sizes joins and shuffles by compressed bytes. Paths and ids compress so well, and their
estimates behind a parse are so small, that millions of rows would be broadcast or joined by one
task. What is dealt here by number stays dealt.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.session import ensure_checkpoint_dir

#: Rows of one task, about.
TASK_ROWS = 100_000
#: Rows with one key that one task joins, about.
KEY_ROWS = 50_000
#: Tasks among which the rows of one key are counted.
SALTS = 64
#: Rows of a side whose keys are looked for by value in the other one.
FEW_ROWS = 100
#: Groups of keys whose rows are counted to tell which may hold a key of very many, and named at most.
KEY_GROUPS = 2**16
MOST_GROUPS = 1000


def settled(rows: DataFrame) -> DataFrame:
    """The rows written out once, for those that read them more than once."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """As `settled`, in columns and compressed: names and paths take a fraction of the disk.

    For frames that are joined by `matched` or with hints only: Spark would take them for small.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stored-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, count: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows by key, in as many tasks as `count` rows need."""
    return rows.repartition(max(1, -(-count // task_rows)), *keys)


def key_counts(rows: DataFrame, count: int, keys: list[str]) -> DataFrame:
    """(keys, _n): the rows of each key that has no null; a key of very many rows goes to many tasks."""
    if count <= KEY_ROWS:
        return dealt(rows.select(*keys).dropna(), count, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    salted = rows.select(*keys, (F.spark_partition_id() % SALTS).alias("_salt")).dropna()
    parts = dealt(salted, count, *keys, "_salt").groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    return dealt(parts.drop("_salt"), count, *keys).groupBy(*keys).agg(F.sum("_n").alias("_n"))


def matched(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", key_rows: int = KEY_ROWS
) -> DataFrame:
    """`rows.join(table, keys, how)`, how being inner, left_semi or left_anti.

    `rows` may have very many rows of one key: these are cut into slices, and the table's rows of
    that key go to each. Only the keys of more than `key_rows` rows are broadcast. A side of few rows
    is not joined with all of the other one, only with the rows that have its key. Both frames are
    read more than once, and `rows` must have the same order each time: settle what is costly to make.
    """
    unknown = reduce(or_, (F.col(k).isNull() for k in keys))
    found = _matched(rows.dropna(subset=keys), table, keys, how, key_rows)
    return found.unionByName(rows.where(unknown)) if how == "left_anti" else found


def _matched(known: DataFrame, table: DataFrame, keys: list[str], how: str, key_rows: int) -> DataFrame:
    count = known.count()
    if count <= FEW_ROWS and _by_value(known, table, keys):
        table = table.where(F.col(keys[0]).isin(_values(known, keys[0])))
    in_table = table.count()
    if in_table <= FEW_ROWS < count and _by_value(known, table, keys):
        has_key = F.col(keys[0]).isin(_values(table, keys[0]))
        if how == "left_anti":
            return known.where(~has_key)
        known = known.where(has_key)
        if how == "left_semi":
            return known
        count = known.count()
    both = count + in_table
    hot = _hot(known, count, keys, key_rows) if count > key_rows else None
    if hot is None or hot.isEmpty():
        return dealt(known, both, *keys).join(dealt(table, both, *keys).hint("merge"), keys, how)
    few, slices, on = F.broadcast(hot), F.coalesce("_slices", F.lit(1)), [*keys, "_slice"]
    slice_ = F.pmod(F.xxhash64(F.monotonically_increasing_id()), slices).cast("int")
    left = known.join(few, keys, "left").withColumn("_slice", slice_).drop("_slices")
    every = F.explode(F.sequence(F.lit(0), slices - 1))
    right = table.join(few, keys, "left").withColumn("_slice", every).drop("_slices")
    return dealt(left, both, *on).join(dealt(right, both, *on).hint("merge"), on, how).drop("_slice")


def _hot(known: DataFrame, count: int, keys: list[str], key_rows: int) -> DataFrame | None:
    """(keys, _slices) of the keys of more than `key_rows` rows, None where no group of keys has as many.

    Groups are counted first, as rows of a group need no shuffle; keys only within the crowded ones.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS))
    groups = known.groupBy(group.alias("_group")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > key_rows)
    crowded = groups.limit(MOST_GROUPS + 1).collect()
    if not crowded:
        return None
    if len(crowded) <= MOST_GROUPS:
        known, count = known.where(group.isin([r["_group"] for r in crowded])), sum(r["_n"] for r in crowded)
    hot = key_counts(known, count, keys).where(F.col("_n") > key_rows)
    return settled(hot.select(*keys, F.ceil(F.col("_n") / key_rows).cast("int").alias("_slices")))


def _by_value(rows: DataFrame, table: DataFrame, keys: list[str]) -> bool:
    """Whether the key is one of plain text, whose values can be named."""
    return len(keys) == 1 and all(f.schema[keys[0]].dataType == StringType() for f in (rows, table))


def _values(rows: DataFrame, key: str) -> list[str]:
    return [r[0] for r in rows.select(key).dropna().distinct().collect()]
