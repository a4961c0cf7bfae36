"""Titles kept in order: the distributed form against the loop it stands for."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provlake.operators import titles
from provlake.plans.session import checkpointed

SCHEMA = "run int, id int, publisher string, title string, place string, g int"


def loop(rows, threshold, similarity):
    """Ids that a pass over each run keeps."""
    kept, out = {}, []
    for run, ident, publisher, title, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        p, t = (publisher or "").lower(), (title or "").lower().strip()
        near = titles.matching_blocks if similarity == "blocks" else lambda a, b, x: titles._edits(a, b) >= x
        if p and any(near(t, x, threshold) for x in kept.get((run, p), [])):
            continue
        kept.setdefault((run, p), []).append(t)
        out.append(ident)
    return sorted(out)


def made(seed, n):
    """Families of titles in random order, copies, nulls, blanks, short and very long titles, one publisher with a third of all."""
    rng = random.Random(seed)
    heads = ["annual report of the city", "minutes of the board", "a study of rivers and lakes", "ab", "x", "prices"]
    rows = []
    for i in range(n):
        t = f"{rng.choice(heads)} {rng.choice(['', '1', '2', 'no. 17', 'part two', 'revised edition'])}"
        t = "".join(c if rng.random() > 0.04 else rng.choice("abcxyz ") for c in t)
        t = rng.choice([t] * 20 + [t.upper(), f"  {t}\n", None, "", "ab" * 120, "long " * 60 + t])
        rows.append((rng.choice([1, 1, 2, None]), i, "Hot.org" if i % 3 == 0 else rng.choice(["a.org", "B.org", "", None]), t, "x", 1))
    return rows + [(1, n + k, "hot.org", "the same title", "x", 1) for k in range(40)]


@pytest.mark.parametrize("similarity, first, most, threshold", [("blocks", 256, 1 << 14, 0.85), ("blocks", 2, 16, 0.85), ("edits", 1, 8, 0.85), ("blocks", 4, 4, 0.6), ("edits", 3, 64, 0.3)])
def test_kept_as_by_a_loop(spark, similarity, first, most, threshold):
    rows = made(first, 160)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = titles.dedup_titles_ordered(df, "run", "id", threshold, similarity, checkpointed, first, most)
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == loop(rows, threshold, similarity)


def test_no_rows(spark):
    assert titles.dedup_titles_ordered(spark.createDataFrame([], SCHEMA), "run", "id", keep=checkpointed).collect() == []


def test_first_kept_on_chains(spark):
    """A row that only a dropped row is similar to is kept: 1 - 2 - 3 - 4 - 5 keeps 1, 3, 5."""
    ids = spark.createDataFrame([("a", i) for i in range(1, 6)] + [("b", 1)], "g string, place long")
    edges = spark.createDataFrame([("a", i, i + 1) for i in range(1, 5)], "g string, early long, late long")
    assert sorted(map(tuple, titles.first_kept(ids, edges, checkpointed).collect())) == [("a", 1), ("a", 3), ("a", 5), ("b", 1)]


def test_blocks_double_and_then_stay(spark):
    rows = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("t"), "id").withColumnRenamed("id", "o")
    got = [r.block for r in titles._placed(rows, checkpointed, 4, 16).orderBy("o").collect()]
    assert got == [0] * 4 + [1] * 4 + [2] * 8 + [3] * 16 + [4] * 16 + [5] * 16 + [6] * 16 + [7] * 16 + [8] * 4


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=25), st.lists(st.tuples(st.integers(0, 24), st.sampled_from(["", "a", "xy"])), max_size=4), st.sampled_from([0.6, 0.85, 0.9]))
def test_lost_pairs_are_bounded(text, changes, threshold):
    """The bound that candidates rest on: similar titles share all but so many counted pairs."""
    from collections import Counter

    other = text
    for at, new in changes:
        other = other[:at] + new + other[at + 1 :]
    if titles.matching_blocks(text, other, threshold):
        pairs = [Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (text, other)]
        shared = sum((pairs[0] & pairs[1]).values())
        for t in (text, other):
            assert max(0, len(t) - 1) - shared <= 4 * (1 - threshold) * len(t) / (2 - threshold) + 1e-9


@pytest.mark.parametrize("cell", [1, 7])
def test_titles_meet_in_cells(spark, monkeypatch, cell):
    """Both forms over several cells, as by comparing all; no pair of titles leaves the task where it meets."""
    from provlake.operators import retrieval

    monkeypatch.setattr(titles, "CELL", cell)
    rows = [r for r in made(11, 90) if r[0] == 1]
    df = spark.createDataFrame(rows, SCHEMA)
    got = titles.dedup_titles_ordered(df, "run", "id", 0.85, "edits", checkpointed, 2, 16)
    assert sorted(r.id for r in got.collect()) == loop(rows, 0.85, "edits")
    free = retrieval.dedup_titles(df, keep=checkpointed)
    cut = [(i, (p or "").lower(), t.lower().strip(" ")) for _, i, p, t, *_ in rows if t is not None]
    gone = {i for i, p, t in cut for j, o, u in cut if j < i and p and p == o and titles._edits(t, u) >= 0.85}
    assert {r.id for r in free.where("title is not null").collect()} == {i for i, _, _ in cut} - gone
    plan = free._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join Inner" not in plan


@pytest.mark.parametrize("similarity, threshold", [("edits", 0.85), ("edits", 0.5), ("blocks", 0.85), ("blocks", 0.6)])
def test_marks_never_part_similar_titles(spark, similarity, threshold):
    rng = random.Random(9)
    base = ["".join(rng.choice("aabthe né") for _ in range(rng.randrange(0, 70))) for _ in range(30)]
    texts = sorted({"".join(rng.choice(["", "x", "é", c + "a"]) if rng.random() < 0.08 else c for c in rng.choice(base)) for _ in range(120)} | {"", "a"})
    every = titles.marked(spark.createDataFrame([(t,) for t in texts], "t string"))
    a, b = (every.select([F.col(c).alias(f"{s}_{c}") for c in every.columns]) for s in ("late", "early"))
    both = a.crossJoin(b).select("late_t", "early_t", titles.may_be_near(threshold, similarity).alias("may"), titles.near_by_edits(threshold).alias("near")).collect()
    if similarity == "edits":
        near = {(r.late_t, r.early_t) for r in both if titles._edits(r.late_t, r.early_t) >= threshold}
        assert near == {(r.late_t, r.early_t) for r in both if r.near}
    else:
        near = {(r.late_t, r.early_t) for r in both if titles.matching_blocks(r.late_t, r.early_t, threshold)}
    assert near <= {(r.late_t, r.early_t) for r in both if r.may} and len(near) > len(texts)
