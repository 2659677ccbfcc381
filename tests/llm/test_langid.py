from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import langid
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = langid.identify(spark.read.parquet(f"{SF}/documents.parquet"))
    held = rows.where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert held[0] > 250 and held[1] >= 0.99


def test_labels_of_the_held_out_do_not_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = langid.remainder(F.col("doc_id"))
    spoilt = docs.withColumn("lang", F.when(fold == 1, "none").otherwise(F.col("lang")))
    plain, other = (langid.identify(d).orderBy("doc_id").select("doc_id", "lang_pred", "score").collect() for d in (docs, spoilt))
    assert plain == other


def test_odd_rows(spark):
    docs = documents(
        spark, [(k, t) for k in range(40) for t in (f"the word {k} and of", None, "", "12 !?", "x" * 300_000)][:150]
    ).withColumn("lang", F.when(F.col("doc_id") % 7 > 0, "en"))
    rows = langid.identify(docs.withColumnRenamed("kept", "score")).collect()
    assert all((r.lang_pred == "und") == (not langid.has_letter(r.text)) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_codewords_are_apart():
    for classes in (2, 3, 4, 6, 7, 9, 20):
        code = langid.codewords(classes)
        apart = min(int((a != b).sum()) for a, b in combinations(code, 2))
        assert apart >= max(1, code.shape[1] // 4)


def test_features_do_not_depend_on_the_batch():
    texts = ["Some words here", "", "x" * 10, "Éa ß"]
    long = "ab cd " * (langid.CHUNK // 2)
    one = np.concatenate([langid.features([t]) for t in texts])
    assert np.allclose(one, langid.features(texts))
    assert np.allclose(langid.features([long])[0], langid.features(["ab cd " * 5000])[0], atol=1e-2)
