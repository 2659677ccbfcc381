"""Quality rules: decision lists learned by sequential covering, as conditional expressions. Native.

Statistics of each text come from built-in expressions. Learning works on counts: each statistic is
cut into cells on a fixed grid, and each step of the search asks Spark for one histogram of the
labelled rows that are still to be covered, by statistic, cell and label. The driver sees these
histograms, whose size is fixed by the grid, and never a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import settled

# What parts words, what counts as a symbol, and how long a repeated window is.
BLANK = r"[\x20\x09-\x0D]"
NO_BLANK = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
WINDOW_WORDS = 3
#: Base rules: fewest words, and the share of words, in percent, that repeated windows may cover.
LEAST_WORDS = 50
MOST_REPEATED = 50

#: Columns that `with_statistics` makes.
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "n_upper", "n_letters", "n_digits", "n_marks",
)

#: Cells of the grid of each statistic.
CELLS = 256
#: A list has at most so many rules, a rule so many conditions.
MOST_RULES = 12
MOST_CONDITIONS = 4
#: Of the labelled documents, by hash of their id, every PRUNE_FOLDS-th prunes rules and does not grow them.
PRUNE_FOLDS = 3
#: A rule stands if this share of what it takes in both folds is bad, with one bad and one good row added.
LEAST_PRECISION = 0.8
#: A rule covers so many bad rows of the growing fold at least.
LEAST_COVER = 3


def _let(value: Column, use) -> Column:
    """`use(value)`, with the value computed once, however often `use` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more.

    Windows are named by 64-bit hashes. Only where two names are equal are they sorted with their
    places, and the covered words counted from the gaps between places.
    """

    def names(w: Column) -> Column:
        places = F.when(F.size(w) >= WINDOW_WORDS, F.sequence(F.lit(0), F.size(w) - WINDOW_WORDS)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW_WORDS))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def repeats(s: Column) -> Column:
            twice = F.filter(
                s, lambda p, i: (F.get(s, i - 1)["h"] == p["h"]) | (F.get(s, i + 1)["h"] == p["h"])
            )
            return F.sort_array(F.transform(twice, lambda p: p["at"]))

        def reach(at: Column) -> Column:
            gaps = F.transform(
                at, lambda p, i: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW_WORDS)))
            )
            return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

        return _let(_let(pairs, repeats), reach)

    return _let(
        _let(words, names),
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """The counts that rules look at in place of `text`; a null text has none of anything.

    Arrays are columns of their own first: each is read more than once, so Spark makes it once.
    """
    others = [c for c in docs.columns if c not in (*STATISTICS, "text")]
    text = F.col("__text")
    split = docs.select(*others, F.coalesce("text", F.lit("")).alias("__text")).withColumns(
        {"__pieces": F.split(text, BLANK), "__lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(NO_BLANK))}
    )
    worded = split.withColumn("__words", F.array_remove("__pieces", ""))
    made = {
        "n_words": F.size("__words"),
        # Every piece but the first has one blank before it.
        "word_chars": F.length(text) - F.size("__pieces") + 1,
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _repeated_words(F.col("__words")),
        "n_lines": F.size("__lines"),
        "n_distinct_words": F.size(F.array_distinct("__words")),
        "n_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "n_letters": F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", "")),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")),
        "n_marks": F.regexp_count(text, F.lit("[!?]")),
    }
    return worded.select(*others, *(made[name].cast("long").alias(name) for name in STATISTICS))


def features() -> dict[str, Column]:
    """Statistics that rules look at, from 0 to 1 each, of counts that do not depend on the length."""

    def share(part: str, whole: str) -> Column:
        return F.least(F.col(part) / F.greatest(F.col(whole), F.lit(1)), F.lit(1.0))

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "letter_share": share("n_letters", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "repeated_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "lines_per_word": share("n_lines", "n_words"),
        "short_words": 1 / F.greatest(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(1.0)),
    }


def cells() -> dict[str, Column]:
    """The cell of each feature on the grid, 0 to CELLS - 1."""
    return {
        name: F.least(F.floor(value * CELLS), F.lit(CELLS - 1)).cast("int") for name, value in features().items()
    }


@dataclass(frozen=True)
class Condition:
    """A feature's cell is at least (or below) `cut`."""

    feature: str
    at_least: bool
    cut: int

    def column(self) -> Column:
        cell = cells()[self.feature]
        return cell >= self.cut if self.at_least else cell < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut / CELLS:g}"


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are bad, by the labelled rows: `bad` of `bad` + `good`."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return _all(self.conditions)

    def __str__(self) -> str:
        return f"{' and '.join(map(str, self.conditions))} -> bad ({self.bad}:{self.good})"


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in conditions), F.lit(True))


@dataclass
class DecisionList:
    """Rules in order; a document that none takes is good."""

    rules: list[Rule] = field(default_factory=list)

    def fired(self) -> Column:
        """The number of the first rule that takes the row, from 1; 0 if none does."""
        number = F.lit(0)
        for k in range(len(self.rules), 0, -1):
            number = F.when(self.rules[k - 1].column(), k).otherwise(number)
        return number

    def good(self) -> Column:
        """One ordered conditional expression over the statistics' columns."""
        chain = None
        for rule in self.rules:
            chain = F.when(rule.column(), False) if chain is None else chain.when(rule.column(), False)
        return F.lit(True) if chain is None else chain.otherwise(True)


def _histogram(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(bad, good) rows of each feature and cell: at most features x CELLS entries."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("f"), F.col(n).alias("c")) for n in cells())))
    counts = rows.select("bad", each.alias("x")).groupBy("x.f", "x.c").agg(
        F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n")
    )
    return {(r["f"], r["c"]): (r["bad"], r["n"] - r["bad"]) for r in counts.collect()}


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """Information gained by a condition that leaves (bad, good) of (bad0, good0) rows, for all bad rows."""
    return bad * (log2(bad / (bad + good)) - log2(bad0 / (bad0 + good0))) if bad else 0.0


def best_condition(counts: dict[tuple[str, int], tuple[int, int]]) -> tuple[Condition, int, int] | None:
    """The condition with most gain on a histogram, and what it leaves.

    Ties go to the first by name, side and cut. Cuts that part the rows alike differ by empty cells
    only; the one in their middle is taken, as far from the good rows as from the bad.
    """
    found, most, last = None, 0.0, 0
    for name in cells():
        row = [counts.get((name, c), (0, 0)) for c in range(CELLS)]
        bad0, good0 = sum(b for b, _ in row), sum(g for _, g in row)
        below_bad = below_good = 0
        for cut in range(1, CELLS):
            below_bad, below_good = below_bad + row[cut - 1][0], below_good + row[cut - 1][1]
            for at_least in (True, False):
                bad = bad0 - below_bad if at_least else below_bad
                good = good0 - below_good if at_least else below_good
                if bad < LEAST_COVER or bad0 + good0 == bad + good:
                    continue
                gain = _gain(bad, good, bad0, good0)
                if gain > most + 1e-9:
                    found, most, last = (Condition(name, at_least, cut), bad, good), gain, cut
                elif found and found[1:] == (bad, good) and (found[0].feature, found[0].at_least) == (name, at_least):
                    last = cut
    if found is None:
        return None
    first, *left = found
    return Condition(first.feature, first.at_least, (first.cut + last + 1) // 2), *left


def _pruned(conditions: list[Condition], rows: DataFrame) -> tuple[int, list[tuple[int, int]]]:
    """How many leading conditions to keep, and the (bad, good) pruning rows each prefix takes."""
    sums = []
    for k in range(1, len(conditions) + 1):
        taken = _taken(conditions[:k])
        sums += [F.sum((taken & F.col("bad")).cast("long")), F.sum((taken & ~F.col("bad")).cast("long"))]
    row = rows.agg(*sums).first()
    taken = [(row[2 * k] or 0, row[2 * k + 1] or 0) for k in range(len(conditions))]
    worth = [(b + 1) / (b + g + 2) for b, g in taken]
    return worth.index(max(worth)) + 1, taken


def _taken(conditions) -> Column:
    """The conditions on rows whose features are cells already."""
    tests = [F.col(c.feature) >= c.cut if c.at_least else F.col(c.feature) < c.cut for c in conditions]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def learn(labelled: DataFrame, most_rules: int = MOST_RULES) -> DecisionList:
    """A decision list from `labelled`: statistics' columns, doc_id, and `bad` boolean.

    Sequential covering. A rule grows on two thirds of the rows left by the condition of the most
    information gain, until it takes no good row or has MOST_CONDITIONS; it loses its last
    conditions again where the other third does without them; and it stands if it is precise
    enough on both. Rows it takes are taken out, and the next rule grows on the rest. All labelled
    rows count; the thirds go by the hash of the id. Without labelled rows the list is empty.
    """
    in_cells = labelled.select("doc_id", "bad", *(value.alias(name) for name, value in cells().items()))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(PRUNE_FOLDS))
    left = settled(in_cells.withColumn("prune", fold == 0))
    rules: list[Rule] = []
    while len(rules) < most_rules:
        growing = left.where(~F.col("prune"))
        conditions, kept = [], None
        while len(conditions) < MOST_CONDITIONS:
            grown = best_condition(_histogram(growing.where(_taken(conditions))))
            if grown is None:
                break
            conditions.append(grown[0])
            kept = grown[1:]
            if kept[1] == 0:
                break
        if not conditions:
            break
        size, _ = _pruned(conditions, left.where("prune"))
        conditions = conditions[:size]
        bad, good = _pruned(conditions, left)[1][-1]
        if (bad + 1) / (bad + good + 2) < LEAST_PRECISION:
            break
        rules.append(Rule(tuple(conditions), bad, good))
        left = left.where(~_taken(conditions))
    return DecisionList(rules)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents' statistics with `base_failed`, `rule` and `kept`.

    `labels` has doc_id and quality, 0 for bad. A document fails the base rules with fewer than
    LEAST_WORDS words, or when repeated windows cover more than MOST_REPEATED percent of its words;
    of the others, those are kept that no learned rule takes (`rule` is its number, else 0).

    A null text has no words. Labels with a null quality or doc_id, and ids with labels of both
    kinds, teach nothing; ids that occur in several documents teach with each. Without labels
    only base rules reject. Columns named like the added ones are replaced; an empty table gives
    an empty result. Each text is read once: statistics are written, and learning and verdicts
    read them. Labels are joined by doc_id.
    """
    stats = settled(with_statistics(docs.drop("base_failed", "rule", "kept")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("__low"), F.max("quality").alias("__high"))
        .where(F.col("__low") == F.col("__high"))
        .select("doc_id", (F.col("__low") == 0).alias("bad"))
    )
    learned = learn(stats.where(~F.col("base_failed")).select("doc_id", *STATISTICS).join(known, "doc_id"))
    rule = F.when(F.col("base_failed"), 0).otherwise(learned.fired())
    return stats.withColumn("rule", rule).withColumn(
        "kept", F.when(F.col("base_failed"), False).otherwise(learned.good())
    )
