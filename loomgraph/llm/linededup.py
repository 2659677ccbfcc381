"""Removal of repeated lines by overlapping windows of three. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import join_counted, same, settled, text_key

WINDOW = 3


def line_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, pos, k1, k2): a 128-bit name for each three lines in a row.

    Lines are compared without the spaces around them. Three blank lines are no window.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.trim(line))
    named = F.transform(lines, lambda line: F.struct(F.xxhash64(line).alias("h"), F.md5(line).alias("m"), (line == "").alias("blank")))
    shifted = F.arrays_zip(
        named.alias("a"), F.slice(named, 2, F.size(named)).alias("b"), F.slice(named, 3, F.size(named)).alias("c")
    )

    def window(z):
        a, b, c = z["a"], z["b"], z["c"]
        return F.when(
            c.isNotNull() & ~(a["blank"] & b["blank"] & c["blank"]),
            F.struct(
                F.xxhash64(a["h"], b["h"], c["h"]).alias("k1"), F.xxhash64(c["m"], a["m"], b["m"]).alias("k2")
            ),
        )

    rows = docs.where(F.col("text").isNotNull()).select(
        "doc_id", text_key(F.col("text")).alias("tkey"), F.posexplode(F.transform(shifted, window)).alias("pos", "w")
    )
    return rows.where(F.col("w").isNotNull()).select("doc_id", "tkey", "pos", "w.k1", "w.k2")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with `text` less the lines of every later occurrence of a window.

    Adds n_lines and n_removed. The first occurrence, by doc_id (null first), then position,
    stays; lines that any later occurrence covers go. Documents of under three lines have no
    window and stay whole; a null text stays null with no lines, an empty one is one line. Rows
    equal in doc_id and text count as one document and are treated alike. Columns named n_lines
    or n_removed are replaced; other extra columns stay.

    Windows are counted with map-side aggregation. A window that very many documents share is
    joined back over several tasks.
    """
    docs = docs.drop("n_lines", "n_removed")
    windows = line_windows(docs)
    place = F.struct("doc_id", "tkey", "pos")
    repeated = settled(
        windows.groupBy("k1", "k2")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where(F.col("n") > 1)
    )
    later = join_counted(windows, repeated, ["k1", "k2"], "n").where(~same(place, F.col("first")))
    covered = (
        later.groupBy(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey"))
        .agg(F.collect_set("pos").alias("__at"))
    )
    own = docs.withColumn("__own", text_key(F.col("text")))
    joined = own.join(covered, same(own["doc_id"], covered["__id"]) & (own["__own"] == covered["__tkey"]), "left")
    # Each of these arrays is read twice below, which keeps Spark from evaluating it per element.
    split = joined.withColumn("__lines", F.split("text", "\n", -1))
    gone = F.flatten(F.transform("__at", lambda p: F.sequence(p, p + WINDOW - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)
    marked = split.withColumn("n_lines", F.coalesce(F.size("__lines"), F.lit(0))).withColumn(
        "__kept", F.when(F.col("__at").isNotNull(), kept)
    )
    removed = F.coalesce(F.col("n_lines") - F.size("__kept"), F.lit(0))
    rest = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")
    out = marked.select(
        *(c for c in docs.columns if c != "text"),
        F.coalesce(rest, F.col("text")).alias("text"),
        "n_lines",
        removed.alias("n_removed"),
    )
    return out.select(*docs.columns, "n_lines", "n_removed")
