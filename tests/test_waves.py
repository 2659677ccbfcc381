import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import waves


def greedy(sets):
    placed = {}
    for issue in sorted(sets):
        used = {w for other, w in placed.items() if sets[other] & sets[issue]}
        placed[issue] = next(w for w in range(len(used) + 1) if w not in used)
    return placed


def paired(sets):
    found = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b]:
                found[a, b] = f"both touch {min(sets[a] & sets[b])}"
    return found


def touches_of(spark, sets):
    return waves.touch_rows(
        waves.local_touch_sets(spark, [{"issue": i, "files": list(f)} for i, f in sets.items()])
    )


@pytest.mark.parametrize("numbered", [True, False])
def test_random_plans_against_plain_code(spark, numbered):
    rng = random.Random(7)
    for size, files in ((0, 1), (1, 1), (9, 4), (30, 12), (25, 200)):
        ids = rng.sample(range(1, 500), size)
        sets = {
            (i if numbered else f"job-{i}"): {f"dir/{rng.randrange(files)}.py" for _ in range(rng.randint(0, 3))}
            for i in ids
        }
        touches = touches_of(spark, sets)
        assert {r["issue"]: r["wave"] for r in waves.waves(touches).collect()} == greedy(sets)
        pairs = paired(sets)
        assert {(r["a"], r["b"]): r["reason"] for r in waves.conflicts(touches).collect()} == pairs
        asked = list(sets)[:2]
        got = {(r["issue"], r["other"]): r["reason"] for r in waves.conflicts_of(touches, asked).collect()} if asked else {}
        assert got == {(x, y): pairs[min(x, y), max(x, y)] for x in asked for y in sets if (min(x, y), max(x, y)) in pairs}


def test_paths_are_trimmed_and_first_wave(spark):
    rows = waves.waves(touches_of(spark, {5: ["\tlib/core.py "], 3: ["lib/core.py\n"], 8: []}))
    assert sorted(r["issue"] for r in waves.independent_set(rows).collect()) == [3, 8]


def test_one_file_that_all_issues_touch(spark):
    """Ten thousand issues, one job: a wave each, and conflicts in bounded slices."""
    touches = spark.range(10_000).select(F.col("id").alias("issue"), F.lit("hot").alias("file"))
    planned = waves.waves(touches)
    assert planned.where("issue = wave").count() == 10_000
    slices = waves.file_issues(touches, slice_issues=1500).collect()
    assert sorted(len(r["issues"]) for r in slices) == [1000] + [1500] * 6
    assert sorted(i for r in slices for i in r["issues"]) == list(range(10_000))


def test_warnings(spark):
    pairs = spark.createDataFrame([("m", "n", 4), ("m", "o", 1), ("p", "q", 7)], "file_a string, file_b string, count long")
    sets = {1: ["m"], 2: ["n", "o"], 3: ["p", "q"], 4: ["n"]}
    touches = touches_of(spark, sets)

    def warned(least):
        rows = waves.coupling_warnings(touches, pairs, (), least).collect()
        return sorted((r["issue"], r["file"], r["coupled_to"], r["count"]) for r in rows)

    strong = [(1, "m", "n", 4), (2, "n", "m", 4), (4, "n", "m", 4)]
    assert warned(2) == strong
    assert warned(1) == sorted([*strong, (1, "m", "o", 1), (2, "o", "m", 1)])
    assert warned(8) == []
    with pytest.raises(ValueError):
        warned(0)


def test_mixed_or_repeated_ids_are_rejected(spark):
    for ids in ([1, "2"], [1, 1]):
        with pytest.raises(ValueError):
            waves.local_touch_sets(spark, [{"issue": i, "files": []} for i in ids])


def test_batches_equal_one_by_one_planning(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for batch in range(6):
        n = rng.randint(3, 12)
        sets = {
            i: {f"f{rng.randint(0, 9)}" for _ in range(rng.randint(1, 3))} for i in range(n)
        }
        if batch == 0:
            sets = {i: s | {"hot"} for i, s in sets.items()}
        want.update({(batch, i): w for i, w in greedy(sets).items()})
        rows += [(batch, i, f) for i, s in sets.items() for f in s]
    touches = spark.createDataFrame(rows, "batch int, issue int, file string")
    got = waves.waves(touches, ["batch"]).collect()
    assert {(r["batch"], r["issue"]): r["wave"] for r in got} == want


def batch_greedy(rows):
    """{(batch, issue): wave} by a plain pass over all issues in order."""
    files, out = {}, {}
    for batch, issue, file in rows:
        files.setdefault((batch, issue), set()).add(file)
    used = {}
    for (batch, issue), own in sorted(files.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        own.discard(None)
        taken = set().union(*(used.setdefault((batch, f), set()) for f in own))
        wave = next(w for w in range(len(taken) + 1) if w not in taken)
        for f in own:
            used[batch, f].add(wave)
        out[batch, issue] = wave
    return out


def test_large_batches_are_split(spark):
    """One batch holds most rows: a hot file, chains, and parts that nothing connects; also without a batch."""
    draw = random.Random(4)
    rows = [("big", i, "hot") for i in range(0, 300, 2)]
    rows += [("big", i, f"f{draw.randrange(200)}") for i in range(300) for _ in range(draw.randrange(3))]
    rows += [("big", 1000 + i, f"g{i // 3}") for i in range(90)] + [("big", 2000 + i, f"c{i + k}") for i in range(60) for k in (0, 1)]
    rows += [(b, i, f"f{draw.randrange(4)}") for b in ("x", "y", None) for i in range(12)] + [("x", 99, None), ("big", 5000, None)]
    frame = spark.createDataFrame(rows, "batch string, issue long, file string")
    for most, block in ((40, 100), (10_000, 10)):
        got = waves.waves(frame, ["batch"], most, block).collect()
        assert len(got) == len(batch_greedy(rows)) and {(r.batch, r.issue): r.wave for r in got} == batch_greedy(rows)
    own = [(None, i, f) for b, i, f in rows if b == "big"]
    got = waves.waves(frame.where("batch = 'big'").drop("batch"), (), 100, 150).collect()
    assert {(None, r.issue): r.wave for r in got} == batch_greedy(own)


def test_a_hot_file_is_many_bounded_tasks(spark):
    """A third of all rows lie on one file: no pass holds more than a block, and its waves are one interval."""
    rows = spark.range(900).selectExpr("id AS issue", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('f', id) END AS file")
    got = {r.issue: r.wave for r in waves.waves(rows, (), 100, 100).collect()}
    assert got == {i: i // 3 if i % 3 == 0 else 0 for i in range(900)}
    taken = waves.Waves()
    for wave in (0, 2, 1, 5, 4, 3):
        assert taken.after(wave) == wave
        taken.add(wave)
    assert taken.intervals() == [[0, 5]] and waves.lowest_free([taken, waves.Waves([[6, 7], [9, 9]])]) == 8


def test_plan_tells_of_each_issue_what_the_frames_tell(spark):
    draw = random.Random(12)
    sets = {i: {f"f{draw.randint(0, 30)}" for _ in range(draw.randint(0, 5))} | ({"hot"} if i % 3 == 0 else set())
            for i in range(60)}
    pairs = {(f"f{a}", f"f{a + 1}"): draw.randint(1, 6) for a in range(30)}
    co_changes = spark.createDataFrame(
        [(a, b, n) for (a, b), n in pairs.items()], "file_a string, file_b string, count long"
    )
    both = {**pairs, **{(b, a): n for (a, b), n in pairs.items()}}
    users = {f: {i for i in sets if f in sets[i]} for f in set().union(*sets.values())}
    placed = greedy(sets)
    want = {
        i: (
            placed[i], placed[i] == 0, len(files), sum(len(users[f]) > 1 for f in files),
            sum(n >= 3 and a in files and bool(users.get(b, set()) - {i}) for (a, b), n in both.items()),
        )
        for i, files in sets.items()
    }
    rows = waves.plan(touches_of(spark, sets), co_changes).collect()
    assert {r.issue: (r.wave, r.independent, r.n_files, r.n_shared_files, r.n_warnings) for r in rows} == want
    assert len(rows) == len(sets)


def test_plan_of_batches_that_are_null_or_empty(spark):
    schema = "batch string, issue long, file string"
    touches = spark.createDataFrame(
        [(None, 1, "a"), (None, 2, "a"), (None, 3, None), ("x", 1, "a"), ("x", 1, "a")], schema
    )
    co_changes = spark.createDataFrame([("a", "b", 9)], "file_a string, file_b string, count long")
    rows = {(r.batch, r.issue): (r.wave, r.n_files, r.n_shared_files, r.n_warnings)
            for r in waves.plan(touches, co_changes, ["batch"]).collect()}
    assert rows == {
        (None, 1): (0, 1, 1, 0), (None, 2): (1, 1, 1, 0), (None, 3): (0, 0, 0, 0), ("x", 1): (0, 1, 0, 0),
    }
    assert waves.plan(touches.limit(0), co_changes, ["batch"]).count() == 0
