"""Documents to tokens: language, repeated lines, near copies, benchmark leaks, byte-level BPE."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontam, langid, linededup, minhash
from loomgraph.session import ensure_checkpoint_dir, ship_package

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Letters from which on an ambiguous language is no matter of a short text.
JUDGED_LETTERS = 50


def _same_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text has it now."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no language: a null text, one without a letter, or a long ambiguous one.

    Where no row has a language to learn from, all that have a letter stay.
    """
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    unclear = F.col("ambiguous") & (letters >= JUDGED_LETTERS)
    unnamed = F.col("lang_pred") == langid.UNKNOWN
    keeps = F.when(unnamed, F.col("text").rlike(r"\p{L}")).otherwise(~unclear)
    return langid.identify(docs).where(keeps).select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat; a document of which nothing is left goes."""
    rows = linededup.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return _same_columns(rows, docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, repeated rows among them, one document."""
    return minhash.drop_near_copies(docs, repeats=False)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, intact): ids as little-endian 32-bit integers, and whether they decode to the text."""
    path = public_tokenizers.path(RANKS)
    decoded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, keep_text=True, decode=True)
    intact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return decoded.select("doc_id", "n_tokens", "ids", intact.alias("intact"))


STAGES = [
    ("language", known_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", one_of_each),
    ("decontaminate", without_benchmark),
    ("bpe", tokens),
]

#: Codewords, sketches, tiles and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
