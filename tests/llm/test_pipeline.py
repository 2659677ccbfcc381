import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

import corpus_pipeline
from loomgraph.llm import bpe
from tests.llm.test_linededup import plainly as lines_plainly
from tests.llm.test_minhash import plainly as near_plainly

SF = "/root/testdata/sf0.001"


def plain_result():
    """The stages by plain code: languages, lines, near copies, and items contained word by word."""
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    texts = {k: t for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    lined = lines_plainly(texts)
    texts = {k: t for k, (_, gone, t) in lined.items() if not gone or t.strip(" ")}
    near = near_plainly(texts, 80)
    texts = {k: t for k, t in texts.items() if near[k][2]}
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    return {k: t for k, t in texts.items() if not any(item in t for item in items)}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    want = plain_result()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    with open(public_tokenizers.path(corpus_pipeline.RANKS), "rb") as file:
        codec = bpe.Codec(file.read(), public_tokenizers.PATTERN)
    for r in rows:
        assert r.intact and r.n_tokens == len(np.frombuffer(r.ids, "<u4"))
        assert codec.decode(bytes(r.ids)).decode() == want[r.doc_id]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
