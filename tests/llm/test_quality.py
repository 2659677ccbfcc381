import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import xxhash

from loomgraph.llm import quality
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.001"
LETTERS = "abcdefghij"


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)),
        "n_repeat_words": len(covered),
    }


def plain_cells(s):
    def share(part, whole):
        return min(s[part] / max(s[whole], 1), 1.0)

    made = {
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "letter_share": share("n_letters", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "repeated_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "lines_per_word": share("n_lines", "n_words"),
        "short_words": 1 / max(s["word_chars"] / max(s["n_words"], 1), 1.0),
    }
    return {k: min(math.floor(v * 256), 255) for k, v in made.items()}


def plain_learn(rows):
    """[(conditions, bad, good)] by sequential covering over (doc_id, bad, cells) in plain loops."""

    def takes(conditions, cells):
        return all((cells[f] >= cut) == up for f, up, cut in conditions)

    def count(group):
        return sum(r[1] for r in group), sum(not r[1] for r in group)

    left, rules = list(rows), []
    while len(rules) < 12:
        folds = [xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), 42) for k, _, _ in left]
        folds = [(h - (1 << 64) if h >> 63 else h) % 3 == 0 for h in folds]
        grow = [r for r, f in zip(left, folds, strict=True) if not f]
        prune = [r for r, f in zip(left, folds, strict=True) if f]
        conditions, live = [], grow
        while len(conditions) < 4:
            bad0, good0 = count(live)
            best, most = [], 0.0
            for name in plain_cells(Counter()):
                for cut in range(1, 256):
                    for up in (True, False):
                        bad, good = count([r for r in live if (r[2][name] >= cut) == up])
                        if bad < 3 or bad + good == bad0 + good0:
                            continue
                        gain = bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))
                        if gain > most + 1e-9:
                            best, most = [(name, up, cut, bad, good)], gain
                        elif best and best[0][:2] == (name, up) and best[0][3:] == (bad, good):
                            best.append((name, up, cut, bad, good))
            if not best:
                break
            conditions.append((*best[0][:2], (best[0][2] + best[-1][2] + 1) // 2))
            live = [r for r in live if takes(conditions, r[2])]
            if not count(live)[1]:
                break
        if not conditions:
            break
        worth = []
        for k in range(1, len(conditions) + 1):
            bad, good = count([r for r in prune if takes(conditions[:k], r[2])])
            worth.append((bad + 1) / (bad + good + 2))
        conditions = conditions[: worth.index(max(worth)) + 1]
        bad, good = count([r for r in left if takes(conditions, r[2])])
        if (bad + 1) / (bad + good + 2) < 0.8:
            break
        rules.append((conditions, bad, good))
        left = [r for r in left if not takes(conditions, r[2])]
    return rules


def as_tuples(learned):
    return [([(c.feature, c.at_least, c.cut) for c in r.conditions], r.bad, r.good) for r in learned.rules]


def failed(s):
    return s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]


def drawn_texts(n):
    """Clean texts, texts shouted with marks, texts of symbols, and shouted ones that are no worse for it."""
    draw = random.Random(3)
    out = {}
    for k in range(n):
        words = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(55, 90))]
        kind = k % 5
        if kind in (1, 2):
            words = [w.upper() for w in words]
        if kind in (1, 3):
            words = [w + "!" for w in words]
        if kind == 4:
            words = [w + draw.choice("#*$%") for w in words]
        out[k] = (" ".join(words), int(kind in (0, 2, 3)))
    return out


def test_statistics(spark):
    draw = random.Random(1)
    texts = {k: "".join(draw.choice(["a", "b", "é𝄞", " ", "  ", "\n", "\t", "\x0b", "\x85", " ", "#", "|"])
                        for _ in range(draw.randrange(120))) for k in range(400)}
    texts |= {900: None, 901: "", 902: " \n\t", 903: "a b c a b c", 904: "x " * 30_000, 905: "one\none \n one\none", 906: "a a a a"}
    rows = quality.with_statistics(documents(spark, texts, extra="n_words string, n_lines string")).collect()
    for r in rows:
        assert {k: r[k] for k in plain_statistics("")} == plain_statistics(texts[r.doc_id]), texts[r.doc_id]


def test_learns_a_conjunction(spark):
    """Neither shouting nor marks are bad, but both together are."""
    texts = drawn_texts(400)
    labels = spark.createDataFrame([(k, q) for k, (_, q) in texts.items()], "doc_id long, quality int")
    docs = documents(spark, {k: t for k, (t, _) in texts.items()})
    stats = quality.with_statistics(docs)
    known = stats.join(labels, "doc_id").withColumn("bad", labels["quality"] == 0)
    learned = quality.learn(known)
    assert as_tuples(learned) == plain_learn([(r.doc_id, r.bad, plain_cells(r.asDict())) for r in known.collect()])
    assert any(len(r.conditions) > 1 for r in learned.rules)
    rows = quality.judge_documents(docs, labels.where("doc_id < 200")).where("doc_id >= 200").collect()
    assert sum(r.kept == bool(texts[r.doc_id][1]) for r in rows) >= 0.95 * len(rows)


def test_odd_rows(spark):
    texts = [(None, "word " * 60), (1, None), (2, ""), (3, "same " * 3), (3, "same " * 3), (4, "w" * 5 + " x" * 80)]
    docs = documents(spark, texts, extra="kept string, rule string, base_failed string, n_words string, bad string")
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (3, None), (None, 0), (4, 0), (4, 0)], "doc_id long, quality int"
    )
    rows = quality.judge_documents(docs, labels).collect()
    assert len(rows) == 6 and not any(r.kept for r in rows if r.base_failed)
    assert {r.doc_id: r.n_words for r in rows} == {None: 60, 1: 0, 2: 0, 3: 3, 4: 81}
    assert quality.judge_documents(docs.limit(0), labels).count() == 0
    clean = documents(spark, {k: t for k, (t, _) in drawn_texts(10).items()})
    assert quality.judge_documents(clean, labels.limit(0)).where("kept").count() == 10


def test_native(spark):
    texts = drawn_texts(40)
    labels = spark.createDataFrame([(k, q) for k, (_, q) in texts.items()], "doc_id long, quality int")
    rows = quality.with_statistics(documents(spark, {k: t for k, (t, _) in texts.items()})).join(labels, "doc_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_plain_code(spark):
    import __spark_entry__ as spark_entry

    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    quality_of = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = {r.doc_id: r for r in spark_entry.queries()["op12_quality"](spark, SF).collect()}
    stats = {r.doc_id: r.asDict() for r in quality.with_statistics(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    rules = plain_learn([
        (k, quality_of[k] == 0, plain_cells(s)) for k, s in stats.items() if quality_of.get(k) is not None and not failed(s)
    ])
    assert rules and len(rows) == len(docs)
    for d in docs:
        r, s = rows[d["doc_id"]], plain_statistics(d["text"])
        assert {k: r[k] for k in s} == s and r.base_failed == failed(s)
        cells = plain_cells(stats[d["doc_id"]])
        taken = any(all((cells[f] >= cut) == up for f, up, cut in conditions) for conditions, _, _ in rules)
        assert r.kept == (not failed(s) and not taken)


def test_held_out_labels(spark):
    """Learned from one half of the labels of the sample, right on the other."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge_documents(docs, labels.where("doc_id % 2 = 0")).where("not base_failed and doc_id % 2 = 1")
    judged = rows.join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in judged) >= 0.95 * len(judged) > 50
