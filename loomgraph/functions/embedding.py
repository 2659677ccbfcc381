"""Embedding: task prefixes, length limits, provider calls and an offline embedder."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.config import EmbeddingConfig
from loomgraph.functions.text import cut
from loomgraph.functions.vectors import list_array

MAX_TEXT_CHARS = 4000
#: Calls made for a text before its task fails; Spark then tries the task again.
ATTEMPTS = 3
FALLBACK_DIMENSION = 768

# Vector size by model, then by provider.
MODEL_DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
    "text-embedding-004": 768,
    "nomic-embed-text": 768,
    "nomic-embed-code": 3584,
    "mxbai-embed-large": 1024,
    "all-minilm": 384,
    "mistral-embed": 1024,
    "Qwen3-Embedding-0.6B": 1024,
    "Qwen3-Embedding-0.6B-8bit": 1024,
}
PROVIDER_DIMENSIONS = {
    "openai": 1536,
    "google": 768,
    "ollama": 768,
    "mistral": 1024,
    "lmstudio": 768,
    "tei": 3584,
    "omlx": 1024,
}
# Texts per request by provider.
BATCH_SIZES = {
    "ollama": 1,
    "lmstudio": 10,
    "openai": 50,
    "google": 20,
    "mistral": 50,
    "tei": 32,
    "omlx": 32,
}
OTHER_BATCH_SIZE = 10

# Instruction texts of the models that need them.
CODE_QUERY_PREFIX = "Represent this query for searching relevant code: "
TEXT_QUERY_PREFIX = "search_query: "
TEXT_DOCUMENT_PREFIX = "search_document: "
QWEN_QUERY_PREFIX = (
    "Instruct: Given a search query, retrieve relevant code or documentation\nQuery: "
)

# Default endpoints.
DEFAULT_ROOTS = {
    "openai": "https://api.openai.com",
    "google": "https://generativelanguage.googleapis.com",
    "ollama": "http://localhost:11434",
    "lmstudio": "http://localhost:1234",
    "mistral": "https://api.mistral.ai",
    "tei": "http://localhost:8080",
    "omlx": "http://localhost:11444",
}


def dimension(config: EmbeddingConfig) -> int:
    by_provider = PROVIDER_DIMENSIONS.get(config.type, FALLBACK_DIMENSION)
    return MODEL_DIMENSIONS.get(config.model, by_provider)


def dimension_of(provider: Column, model: Column) -> Column:
    """Vector size by model, then provider, then 768."""

    def lookup(table: dict[str, int], key: Column) -> Column:
        pairs = [F.lit(x) for item in table.items() for x in item]
        return F.try_element_at(F.create_map(*pairs), key)

    return F.coalesce(
        lookup(MODEL_DIMENSIONS, model),
        lookup(PROVIDER_DIMENSIONS, provider),
        F.lit(FALLBACK_DIMENSION),
    )


def with_prefix(text: Column, model: Column, mode: Column) -> Column:
    """Prepend the instruction that `model` expects for a `query` or a `document`."""
    is_query = mode == "query"
    is_text_model = (model == "nomic-embed-text") | model.startswith("nomic-embed-text:")
    prefix = (
        F.when(model.contains("nomic-embed-code"), F.when(is_query, CODE_QUERY_PREFIX))
        .when(is_text_model, F.when(is_query, TEXT_QUERY_PREFIX).otherwise(TEXT_DOCUMENT_PREFIX))
        .when(model.contains("Qwen3-Embedding"), F.when(is_query, QWEN_QUERY_PREFIX))
    )
    return F.concat(F.coalesce(prefix, F.lit("")), text)


def model_input(text: Column, model: Column, mode: Column) -> Column:
    """What is sent to the model: prefixed first, then cut."""
    return cut(with_prefix(text, model, mode), MAX_TEXT_CHARS)


def char_bins(text: str, size: int = FALLBACK_DIMENSION) -> np.ndarray:
    """Offline embedder: unit vector of UTF-16 unit counts by value modulo `size`."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    bins = np.bincount(units % size, minlength=size).astype("float64")
    bins[0] += 1.0
    return bins / np.sqrt((bins * bins).sum())


def _post(url: str, headers: dict[str, str], body: dict) -> dict:
    request = urllib.request.Request(
        url,
        data=json.dumps(body).encode("utf-8"),
        headers={"Content-Type": "application/json", **headers},
    )
    with urllib.request.urlopen(request, timeout=120) as reply:
        return json.loads(reply.read())


def request_vectors(
    texts: list[str], config: EmbeddingConfig, post: Callable[[str, dict, dict], dict] = _post
) -> list[list[float]]:
    """One provider call. `post(url, headers, body)` returns the decoded reply."""
    kind = config.type
    if kind == "offline":
        return [char_bins(t, dimension(config)) for t in texts]
    if kind not in DEFAULT_ROOTS:
        raise ValueError(f"unknown embedding provider: {kind}")
    fixed_root = kind in ("google", "mistral")
    root = DEFAULT_ROOTS[kind] if fixed_root else (config.base_url or DEFAULT_ROOTS[kind])
    key = config.api_key or ""
    if kind == "google":
        url = f"{root}/v1beta/models/{config.model}:embedContent"
        headers = {"x-goog-api-key": key}
        replies = [post(url, headers, {"content": {"parts": [{"text": t}]}}) for t in texts]
        return [r["embedding"]["values"] for r in replies]
    body = {"model": config.model, "input": texts}
    if kind == "ollama":
        return post(f"{root}/api/embed", {}, body)["embeddings"]
    if kind in ("lmstudio", "tei", "omlx"):
        root = root.rstrip("/").removesuffix("/v1")
    sends_key = kind in ("openai", "mistral") or (kind in ("tei", "omlx") and key)
    headers = {"Authorization": f"Bearer {key}"} if sends_key else {}
    data = post(f"{root}/v1/embeddings", headers, body)["data"]
    return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]


def embed_texts(
    texts: list[str], config: EmbeddingConfig, call: Callable | None = None
) -> list[list[float]]:
    """Vectors of prepared texts; every text is sent whole.

    A call that fails is made again. What fails still ends the task, so that no text gets a
    vector that is not its own and the index run can be repeated.
    """
    call = call or request_vectors
    size = dimension(config)
    step = BATCH_SIZES.get(config.type, OTHER_BATCH_SIZE)
    if config.type != "offline" and config.type not in DEFAULT_ROOTS:
        raise ValueError(f"unknown embedding provider: {config.type}")

    def checked(batch: list[str]) -> list[list[float]]:
        vectors = call(batch, config)
        if len(vectors) != len(batch) or any(len(v) != size for v in vectors):
            raise ValueError("provider reply has the wrong shape")
        return vectors

    found: list[list[float]] = []
    for start in range(0, len(texts), step):
        batch = texts[start : start + step]
        found.extend(_again(checked, batch))
    return found


def _again(checked: Callable, batch: list[str]) -> list[list[float]]:
    """The vectors of a batch, asked for up to ATTEMPTS times with growing pauses."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return checked(batch)
        except Exception:  # noqa: BLE001 - the last failure is raised
            if attempt == ATTEMPTS:
                raise
            time.sleep(0.1 * 4**attempt)
    raise AssertionError


def embed(
    text: Column, config: EmbeddingConfig, mode: str = "document", call: Callable | None = None
) -> Column:
    """`array<float>` embedding of a text column, computed on the executors batch by batch.

    Texts that the model would cut are an error; chunkers make none.
    """
    sent = with_prefix(text, F.lit(config.model), F.lit(mode))
    too_long = F.length(F.encode(sent, "UTF-16BE")) > 2 * MAX_TEXT_CHARS
    whole = F.when(F.length(sent) <= MAX_TEXT_CHARS // 2, sent).when(
        too_long, F.raise_error(F.lit(f"a text is longer than {MAX_TEXT_CHARS}: chunk it first"))
    ).otherwise(sent)

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        found = embed_texts(texts.to_pylist(), config, call)
        return list_array(np.asarray(found, dtype="float32").reshape(len(found), -1))

    # Marked so that no plan calls the provider twice for a text.
    return vectors.asNondeterministic()(whole)


def embed_query(text: str, config: EmbeddingConfig, call: Callable | None = None) -> list[float]:
    """Embedding of one query text, on the driver."""
    model = config.model
    prefix = ""
    if "nomic-embed-code" in model:
        prefix = CODE_QUERY_PREFIX
    elif model == "nomic-embed-text" or model.startswith("nomic-embed-text:"):
        prefix = TEXT_QUERY_PREFIX
    elif "Qwen3-Embedding" in model:
        prefix = QWEN_QUERY_PREFIX
    if len((prefix + text).encode("utf-16-le")) > 2 * MAX_TEXT_CHARS:
        raise ValueError(f"a query has at most {MAX_TEXT_CHARS} characters")
    vector = embed_texts([prefix + text], config, call)[0]
    return [float(x) for x in vector]
