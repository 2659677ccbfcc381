DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, texts, extra="n_lines string, size string, shard string, kept string, bucket string"):
    """Rows of (doc_id, text), with further columns whose names operators use themselves."""
    rows = [(k, t, "en", "s", *["x"] * len(extra.split(","))) for k, t in (texts if isinstance(texts, list) else texts.items())]
    return spark.createDataFrame(rows, f"{DOCS}, {extra}")
