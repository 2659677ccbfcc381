"""Language of a text: classifiers of character n-grams for the bits of error-correcting codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from loomgraph.llm.common import small_batches

UNKNOWN = "und"
#: Labelled rows per language that a model is fitted on, at most.
SAMPLE = 400
#: Buckets of hashed n-grams of one to three characters.
BUCKETS = 4096
#: Margin between the two nearest codewords below which a prediction is ambiguous.
AMBIGUOUS = 0.05
#: Characters, and rows, that are counted at a time.
CHUNK, ROWS = 1 << 20, 256

_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_SHIFT = np.uint32(32 - 12)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, everything but letters as 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return codes * _letters()[codes]


def _add(counts: np.ndarray, codes: np.ndarray, rows: np.ndarray, starts: int) -> None:
    """Count the n-grams that begin at the first `starts` places of a row; `codes` has two more."""
    base = rows * BUCKETS
    one = codes[:starts]
    counted = rows >= 0
    some = (one != 0) & counted
    h = one * _FACTORS[0]
    flat = counts.reshape(-1)
    for n in range(3):
        if n:
            more = codes[n : n + starts]
            h = h + more * _FACTORS[n] + np.uint32(n)
            some = some | (more != 0) & counted
        mixed = h ^ (h >> np.uint32(15))
        bucket = (mixed * _FACTORS[1]) >> _SHIFT
        flat += np.bincount((base + bucket)[some], minlength=flat.size).astype(np.float32)


def features(texts: list[str]) -> np.ndarray:
    """Square roots of n-gram frequencies, a row for each text; whole texts are counted."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < ROWS and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end])
            end += 1
        codes = [_codes(t) for t in texts[at:end]]
        lengths = np.array([len(c) + 3 for c in codes])
        gap = np.zeros(2, np.uint32)
        flat = np.concatenate([x for c in codes for x in (gap[:1], c, gap)])
        rows = np.repeat(np.arange(end - at, dtype=np.int64), lengths)
        # No n-gram begins behind a text's last letter, so none has letters of two texts.
        rows[np.cumsum(lengths) - 1] = rows[np.cumsum(lengths) - 2] = -1
        padded = np.concatenate((flat, gap))
        for begin in range(0, len(flat), 2 * CHUNK):
            n = min(2 * CHUNK, len(flat) - begin)
            _add(out[at:end], padded[begin : begin + n + 2], rows[begin : begin + n], n)
        at = end
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 for each class; columns are different splits of the classes.

    Up to seven classes get every split. More get, of many drawn splits in halves, those that
    best part the two classes that lie closest, ten for each doubling of the classes.
    """
    if classes < 2:
        return np.ones((classes, 0))
    if classes <= 7:
        return np.array([s for s in product((1, -1), repeat=classes) if s[0] == 1 and -1 in s]).T
    rng = np.random.default_rng(11)
    half = np.where(np.arange(classes) % 2, 1, -1)
    drawn = [rng.permutation(half) for _ in range(400)]
    code = np.zeros((classes, 0))
    pairs = np.array(list(combinations(range(classes), 2)))
    apart = np.zeros(len(pairs))
    for _ in range(10 * int(np.ceil(np.log2(classes)))):
        parts = [(c[pairs[:, 0]] != c[pairs[:, 1]]).astype(float) for c in drawn]
        weight = np.exp(-apart)
        best = max(range(len(drawn)), key=lambda i: float((parts[i] * weight).sum()))
        apart += parts[best]
        code = np.column_stack((code, drawn.pop(best)))
    return code


@dataclass
class Model:
    """`names` of the languages, their codewords, and for each bit a linear rule and a weight."""

    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest codeword, and the margin to the next one, 0 to 1.

        Distance is the logistic loss of the bits' outputs against a codeword, each bit weighted
        by its trust.
        """
        if len(self.names) < 2:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        outputs = x @ self.weights + self.bias
        for_one, for_other = np.logaddexp(0, -outputs), np.logaddexp(0, outputs)
        plus = (self.code > 0).astype(np.float32)
        loss = (for_one * self.trust) @ plus.T + (for_other * self.trust) @ (1 - plus).T
        order = np.sort(loss, axis=1)
        return loss.argmin(axis=1), (order[:, 1] - order[:, 0]) / (order[:, 1] + order[:, 0] + 1e-12)


def fit(x: np.ndarray, labels: list[str], rounds: int = 300) -> Model:
    """Logistic rules for all bits at once, by gradient descent with momentum."""
    names = sorted(set(labels))
    code = codewords(len(names)).astype(np.float32)
    bits = code.shape[1]
    weights, bias = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return Model(names, code, weights, bias, np.ones(0))
    y = np.array([names.index(v) for v in labels])
    target = code[y]
    share = np.bincount(y, minlength=len(names))
    balance = (1 / share[y] / len(names))[:, None].astype(np.float32)
    speed, speed_bias = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(rounds):
        wrong = -target / (1 + np.exp(target * (x @ weights + bias))) * balance
        speed = 0.9 * speed - 4 * (x.T @ wrong + 1e-5 * weights)
        speed_bias = 0.9 * speed_bias - 4 * wrong.sum(axis=0)
        weights, bias = weights + speed, bias + speed_bias
    right = ((target * (x @ weights + bias) > 0) * balance).sum(axis=0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(names, code, weights, bias, trust / trust.sum() * bits)


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


@arrow_udf(BinaryType())
def _features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        x = features([t.as_py() or "" for t in batch]).astype(np.float16)
        yield pa.array([row.tobytes() for row in x], pa.binary())


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on about `sample` rows of each language in `labelled(doc_id, text, lang)`.

    Rows are chosen by the hash of their id, evenly over the table: languages are counted over
    all rows, and of each the rows with the smallest hashes are turned into n-gram frequencies,
    so the driver gets 8 kB for each of 1.3 * `sample` rows per language.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model([], codewords(0), np.zeros((BUCKETS, 0)), np.zeros(0), np.ones(0))
    million = 1_000_000
    bounds = F.create_map(
        *(F.lit(v) for name, n in counts.items() for v in (name, int(million * min(1.0, 1.3 * sample / n)) + 1))
    )
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(million))
    chosen = known.where(draw < F.try_element_at(bounds, F.col("lang"))).select(
        "lang", draw.alias("draw"), _features("text").alias("x")
    )
    rows = sorted(chosen.collect(), key=lambda r: (r["lang"], r["draw"], bytes(r["x"])))
    taken, per = [], {}
    for r in rows:
        per[r["lang"]] = per.get(r["lang"], 0) + 1
        if per[r["lang"]] <= sample:
            taken.append(r)
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in taken]).astype(np.float32)
    return fit(x, [r["lang"] for r in taken])


def predict(text: Column, model: Model, ambiguous: float = AMBIGUOUS) -> Column:
    """struct(lang, score, ambiguous) of a whole text.

    `und` with score 0 for a null text, one without a letter, or where no language was learned.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    @arrow_udf("struct<lang string, score double, ambiguous boolean>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = batch.to_pylist()
            out = [{"lang": UNKNOWN, "score": 0.0, "ambiguous": True}] * len(rows)
            for begin in range(0, len(rows), ROWS):
                at = [i for i in range(begin, min(begin + ROWS, len(rows))) if model.names and has_letter(rows[i])]
                if not at:
                    continue
                best, margin = model.predict(features([rows[i] for i in at]))
                for i, k, m in zip(at, best.tolist(), margin.tolist(), strict=True):
                    out[i] = {"lang": model.names[k], "score": min(max(m, 0.0), 1.0), "ambiguous": m < ambiguous}
            yield pa.array(out, kind)

    return run(text)


def remainder(doc_id: Column, folds: int = 3) -> Column:
    """The fold of a document, from the crc32 of its id as text; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def identify(docs: DataFrame, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """The documents with `held_out`, `lang_pred`, `score` and `ambiguous`.

    Learns from text and non-null lang of the rows outside fold `held_out`; a prediction sees the
    text alone. Repeated rows get equal predictions; columns of the added names are replaced;
    an empty table, or one without labels, predicts `und` throughout. No shuffle but the counts
    of languages.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("held_out", "lang_pred", "score", "ambiguous")
    fold = remainder(F.col("doc_id"))
    model = learn(docs.where(fold != held_out), sample)
    named = docs.withColumn("held_out", fold == held_out).withColumn("__p", predict(F.col("text"), model))
    return named.select(
        *docs.columns,
        "held_out",
        F.col("__p.lang").alias("lang_pred"),
        F.col("__p.score").alias("score"),
        F.col("__p.ambiguous").alias("ambiguous"),
    )
