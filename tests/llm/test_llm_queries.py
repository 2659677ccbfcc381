"""Registered queries of the numbered operators, on the sample tables, against SQL or plain code."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import __spark_entry__ as spark_entry
from loomgraph.llm import decontam, substrings
from loomgraph.llm.queries import ORACLE, QUERIES
from loomgraph.llm.shingles import WordHashes
from tests.llm.test_decontam import greedy_plainly
from tests.llm.test_htmltext import article
from tests.llm.test_minhash import plainly as near_plainly
from tests.llm.test_phrases import plainly as edits_plainly
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return spark_entry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, name):
    same, note = compare(spark, connect(SF), name, SF)
    assert same, note


def test_each_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert "pipeline" in spark_entry.queries()


def test_op1(spark, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for k, text in texts.items():
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want[k] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op1_bpe")} == want


def test_op2(spark, texts):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    within = {(k, i) for k, text in texts.items() for i, item in items.items() if item in (text or "")}
    found = {(r.doc_id, r.item_id) for r in run(spark, "op2_decontam")}
    assert within and within <= found
    # Both ways: tiles by plain code over every document and item with a window in common.
    hashes = WordHashes()
    docs = {k: decontam.tokens(t or "", hashes).tolist() for k, t in texts.items()}
    windows = {k: {tuple(w[i : i + decontam.LEAST_TILE]) for i in range(len(w))} for k, w in docs.items()}
    want = set()
    for item_id, text in items.items():
        item = decontam.tokens(text, hashes).tolist()
        own = {tuple(item[i : i + decontam.LEAST_TILE]) for i in range(len(item) - decontam.LEAST_TILE + 1)}
        for k in docs:
            if own & windows[k]:
                made = greedy_plainly(np.array(item, np.uint64), np.array(docs[k], np.uint64), decontam.LEAST_TILE)
                if sum(n for _, _, n in made) >= decontam.COVERAGE * len(item):
                    want.add((k, item_id))
    assert found == want


def test_op3(spark, texts):
    rows = run(spark, "op3_minhash")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == near_plainly(texts)


def test_op4(spark, texts):
    rows, sizes = run(spark, "op4_shards"), Counter()
    for r in rows:
        sizes[r.shard] += r.size
        assert (r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, zlib.crc32((texts[r.doc_id] or "").encode()))
    assert len(rows) == len(texts) and len(sizes) == 8
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_op5(spark, texts):
    rows = run(spark, "op5_langid")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(rows) == len(texts)


def test_op6(spark):
    want = {r["page_id"]: article(r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    assert {r.page_id: r.text for r in run(spark, "op6_html")} == want


def test_op8(spark, texts):
    want = dict(zip(texts, substrings.cut_repeats_plainly(list(texts.values())), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op8_substrings")} == want


def test_op10(spark, texts):
    rows = run(spark, "op10_phrases")
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == {k: v[:2] for k, v in edits_plainly(texts).items()}
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
