import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe
from tests.llm.helpers import documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return bpe.Codec(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_long_pieces_are_joined_from_halves(codec, library):
    draw = random.Random(4)
    for letters in ("ab", "aab", "the", "éa", "日", "0123456789", "ing "):
        for n in (33, 64, 500, 3000):
            text = "".join(draw.choice(letters) for _ in range(n))
            assert ids(codec, text) == library.encode_ordinary(text)


def test_texts_beyond_a_leaf(codec, library):
    for text in (" ab\n" * 40_000, "y" * 70_000, "x " + "y" * 70_000, " " * 70_000 + "a", "one two  three\n\n" * 9000):
        assert ids(codec, text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_joining_encodings_encodes_the_whole(codec):
    draw = random.Random(9)
    words = codec.vocabulary
    for _ in range(300):
        data = bytes(draw.choice(b"aeinst ") for _ in range(draw.randint(2, 60)))
        cut = draw.randint(1, len(data) - 1)
        assert words.join(words.merge(data[:cut]), words.merge(data[cut:])) == words.merge(data)


def test_documents(spark, library):
    texts = [(1, "one two"), (2, None), (3, ""), (1, "one two"), (None, "É <|endoftext|>\x00")]
    docs = documents(spark, texts).withColumnRenamed("kept", "ids")
    rows = bpe.decode_documents(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in rows) == sorted(
        (k or 0, len(library.encode_ordinary(t or "")), (t or "").encode()) for k, t in texts
    )
    both = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, keep_text=True, decode=True).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both) and len(both) == len(texts)
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
