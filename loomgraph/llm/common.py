"""What several operators share: row identity, cut lineage, joins with hot keys, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import ensure_checkpoint_dir

#: Keys that hold more than one HEAVY_SHARE-th of the counted rows are fewer than HEAVY_SHARE.
HEAVY_SHARE = 10_000
LEAST_HEAVY = 1_000
#: Tasks over which the rows of one heavy key are spread.
SALTS = 32


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python task gets at a time, by rows and by bytes: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def settled(rows: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with their lineage cut."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of its own in the shared checkpoint folder, read again.

    As `settled`, but compressed by column, and open to other jobs by its path.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not their text; null and empty differ."""
    return F.xxhash64(text, text.isNull())


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of `rows` with `counted`, which has each key once and, in `n`, its rows.

    Rows of heavy keys are spread over SALTS tasks. The heavy keys are found from the counts,
    and their list is broadcast: by the threshold they are fewer than HEAVY_SHARE, whatever the
    input. `counted` must be settled, as it is read three times.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    heavy = F.col(n) > max(total // HEAVY_SHARE, LEAST_HEAVY)
    hot = counted.where(heavy).select(*keys, F.lit(True).alias("__hot"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    copies = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    side = counted.withColumn("__salt", F.explode(copies))
    return salted.drop("__hot").join(side, [*keys, "__salt"]).drop("__salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each end of `edges(a, b)`: the smallest node that it reaches.

    Alternates two steps until nothing changes. Every node hands its larger neighbours to the
    smallest node it knows, then every node hands its smaller neighbours to it. Both keep what
    is connected, and end with a star around the smallest node of each component.
    """
    now = settled(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        handed = _to_smallest(large)
        small = (
            handed.where(F.col("b") != F.col("least"))
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(handed.select("a", F.col("least").alias("b")))
        )
        now = settled(small.where(F.col("a") != F.col("b")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct()
            )
        seen = state
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def _to_smallest(edges: DataFrame) -> DataFrame:
    """The edges (a, b) with `least`, the smallest of a and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    return edges.join(least, "a")
