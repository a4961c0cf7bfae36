"""Merging of whole runs, on documents written for it."""

import random

import pytest
from pyspark.sql import functions as F

from provlake.operators import claims
from provlake.plans import catalog, session


def written(spark, at, texts, source="run"):
    rows = [(i, t, "en", source, len(t)) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """One run of 240 claims: few words, so that chains are long and the order tells."""
    rng = random.Random(5)
    words = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    some = [" ".join(rng.sample(words, rng.randrange(4, 9))) for _ in range(70)]
    return written(spark, tmp_path_factory.mktemp("many"), [f"{rng.choice(some)}. {rng.choice(some)}" for _ in range(120)])


def test_ordered_merging_takes_all_claims(spark, many):
    got = {r.claim_id: (r.run_id, r.group_id) for r in catalog.QUERIES["f14_merge_ordered"](spark, many).collect()}
    rows = catalog.all_claims(spark, many).withColumn("seq", F.col("claim_id"))
    want = {r.claim_id: (r.run_id, r.group_id) for r in claims.merge_ordered(rows).collect()}
    chains = {r.claim_id: r.group_id for r in catalog.QUERIES["f14_merge_claims"](spark, many).collect()}
    assert len(got) == 240 and got == want
    assert any(chains[c] != g for c, (_, g) in got.items())


@pytest.mark.parametrize("seed, n", [(1, 110), (2, 60)])
def test_rounds_of_long_chains(spark, seed, n):
    """Chains through rounds, without the loop: hot copies, texts that grow, texts past the length bound, several runs."""
    rng = random.Random(seed)
    words = [f"word{c}" for c in "abcdefghijkl"]
    some = [" ".join(rng.sample(words, rng.randrange(2, 9))) for _ in range(14)]
    some += [f"{some[0]} {'x' * 290}", f"{some[1]} {'y' * 230}", f"{some[1]} about 7 mills", f"{some[1]} about 9 mills", ""]
    picked = [some[0] if rng.random() < 0.3 else rng.choice(some) for _ in range(n)]
    rows = [(i, f"r{i % 2}", rng.randrange(60), t.upper() if rng.random() < 0.2 else t) for i, t in enumerate(picked, 1)]
    made = spark.createDataFrame(rows, "claim_id long, run_id string, seq long, statement string")
    want = {r.claim_id: (r.run_id, r.group_id) for r in claims.merge_ordered(made).collect()}
    got = claims.merge_ordered_parts(made, session.written, most=0).collect()
    assert len(got) == n and {r.claim_id: (r.run_id, r.group_id) for r in got} == want
    assert len({g for _, g in want.values()}) > 2


@pytest.mark.parametrize("seed, block", [(3, 1), (4, 40), (5, 64)])
def test_blocks_hand_their_groups_on(spark, monkeypatch, seed, block):
    """Chains of several blocks, with ids past 2 ** 53: groups begin, grow and are joined across blocks; there are as many rounds as blocks."""
    rng = random.Random(seed)
    words = [f"word{c}" for c in "abcdefghij"]
    some = [" ".join(rng.sample(words, rng.randrange(2, 8))) for _ in range(40)] + [f"{words[0]} {words[1]} {'x' * 290}", ""]
    n = 8 if block == 1 else 150
    rows = [(2**60 + i, f"r{i % 7 // 6}", rng.randrange(400), rng.choice(some)) for i in range(n)]
    made = spark.createDataFrame(rows, "claim_id long, run_id string, seq long, statement string")
    want = {r.claim_id: r.group_id for r in claims.merge_ordered(made).collect()}
    loops = []
    keep = lambda df: (loops.append(1) if "of" in df.columns else None, session.written(df))[1]
    got = claims.merge_ordered_parts(made, keep, most=0, block=block).collect()
    assert len(got) == n and {r.claim_id: r.group_id for r in got} == want
    assert 1 < len(loops) <= -(-n // block)


@pytest.mark.parametrize("hot", [100_000, 0, 5])
def test_components_with_hubs(spark, hot):
    """Two stars, a bridge between their leaves, a long path and pairs, with and without hubs by broadcast."""
    rng = random.Random(3)
    edges = [(1000, i) for i in range(1, 200)] + [(2000, i) for i in range(300, 400)] + [(150, 350)]
    edges += [(i, i + 1) for i in range(5000, 5040)] + [(2 * i, 2 * i + 1) for i in range(4000, 4020)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    got = claims.label_components(spark.createDataFrame(edges + edges[:30], "a long, b long"), session.checkpointed, hot=hot)
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for x in parent}


def test_components_hook_whole_trees(spark):
    """A path of 600 nodes in no order settles in a few rounds, also where its smallest node is at its end."""
    nodes = [0, *random.Random(9).sample(range(1, 600), 599)]
    rounds = []
    keep = lambda df: (rounds.append(1) if df.columns == ["node", "component", "next"] else None, session.checkpointed(df))[1]
    got = claims.label_components(spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long"), keep)
    assert {r.node: r.component for r in got.collect()} == dict.fromkeys(range(600), 0)
    assert len(rounds) <= 10


def test_settled_components_leave_the_rounds(spark):
    """A path in order among many pairs: the rounds after the first hold what the path comes to, not the pairs."""
    edges = [(i, i + 1) for i in range(300)] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(3000)]
    sizes = []

    def keep(df):
        out = session.checkpointed(df)
        if df.columns == ["node", "component", "next"]:
            sizes.append(out.count())
        return out

    got = {r.node: r.component for r in claims.label_components(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    assert got == {i: 0 for i in range(301)} | {n: n & ~1 for n in range(10_000, 16_000)}
    assert 2 < len(sizes) <= 10 and sizes[0] == len(got) and sum(sizes[1:]) < 600


def test_cap_falls_on_groups(spark, tmp_path):
    d = written(spark, tmp_path, ["Copies of one statement stand first"] * 50 + [f"zebra{i} lion{i} tiger{i} otter{i} whale{i}" for i in range(60)])
    rows = sorted((r.group_id, r.merged_count) for r in catalog.QUERIES["f18_cap_groups"](spark, d).collect())
    assert rows == [(2, 50)] + [(2 * i, 1) for i in range(51, 90)]


def brute_conflicts(spark, d):
    """group: worst severity over all pairs of its claims that say the same or have the same text."""
    from provlake.operators import links

    rows = claims.featured(catalog.merged(spark, d)).select("claim_id", "group_id", "statement", "finding_type", "toks", "nums")
    a, b = (rows.select([F.col(c).alias(f"{s}_{c}") for c in rows.columns]) for s in "ab")
    found = a.join(b, (F.col("a_group_id") == F.col("b_group_id")) & (F.col("a_claim_id") < F.col("b_claim_id"))).where(claims.duplicate("a_", "b_"))
    found = found.withColumn("c", links.conflict(F.col("a_statement"), F.col("b_statement"), F.col("a_finding_type"), F.col("b_finding_type"))).where("c is not null")
    rank = {"low": 0.04, "medium": 0.08, "high": 0.15}
    out = {}
    for r in found.select("a_group_id", "c.severity").collect():
        out[r.a_group_id] = max(out.get(r.a_group_id, 0.0), rank[r.severity])
    return out


def test_penalty_of_all_members(spark, tmp_path):
    base = "Output of steel mills rose"
    first = f"{base} across many northern towns. Nothing else is said of pumps here"  # in chain, but in no conflict
    others = [f"{base} across many northern towns in China. Wind farms need rare metals and long cables", f"{base} across many northern towns in India. Rivers carry sand and gravel to wide deltas", "Rivers carry sand and gravel to wide deltas. Old bridges need fresh paint each spring"]
    d = written(spark, tmp_path, [first, *others])
    got = {r.group_id: r.contradiction_penalty for r in catalog.QUERIES["f17_calibrate_groups"](spark, d).collect()}
    want = brute_conflicts(spark, d)
    assert got == {g: want.get(g, 0.0) for g in got}
    assert sorted(want.values()) == [0.04, 0.08] and got[2] == 0.04


@pytest.mark.parametrize("threshold, containment, meet", [(0.55, 0.65, 4096), (0.55, 0.65, 3), (0.75, None, 2), (0.3, 0.9, 3)])
def test_pairs_are_judged_where_they_meet(spark, monkeypatch, threshold, containment, meet):
    """All pairs as by comparing all, with tokens in shards; no pair is moved before it is known to hold."""
    rng = random.Random(meet)
    monkeypatch.setattr(claims, "MEET", meet)
    words = [f"{c}{c}word" for c in "abcdefghijkl"]
    rows = [(r, r * 1000 + i, " ".join(rng.sample(words, rng.randint(1, 7))) + rng.choice(["", "", "", " 12 mills", " 30%"])) for r in (1, 2) for i in range(120)]
    texts = claims.featured(claims.texts_of(spark.createDataFrame(rows, "run_id int, claim_id long, statement string"))).cache()
    got = claims.text_pairs(texts, "run_id", "claim_id", threshold, containment, session.checkpointed)
    side = lambda s: texts.select(F.col("run_id").alias(f"{s}run"), *[F.col(c).alias(f"{s}{c}") for c in ("claim_id", "statement", "toks", "nums")])
    want = side("a_").crossJoin(side("b_")).where("a_run = b_run and a_claim_id < b_claim_id").where(claims.duplicate("a_", "b_", threshold, containment))
    found = sorted(map(tuple, got.collect()))
    assert found and found == sorted(map(tuple, want.select("a_run", "a_claim_id", "b_claim_id").collect()))
    assert "Exchange" not in got._jdf.queryExecution().optimizedPlan().toString() and got._jdf.queryExecution().sparkPlan().toString().split("Join")[0].count("Aggregate") == 0


def test_edges_for_components_grow_with_nodes(spark):
    every = spark.range(60).selectExpr("id as a").crossJoin(spark.range(60).selectExpr("id as b")).where("a < b and a % 3 = b % 3").coalesce(2)
    few = claims.spanning(every)
    assert few.count() <= 2 * 57 < every.count()
    got = {r.node: r.component for r in claims.label_components(few, session.checkpointed).collect()}
    assert got == {i: i % 3 for i in range(60)}


def test_a_claim_is_read_once_not_once_a_pair(spark):
    from provlake.operators import links

    said = spark.createDataFrame([(1, 1, "Output rose in China", "fact"), (1, 2, "Output rose in India", "fact"), (1, 3, "Output rose in India by 2030", "risk")], "run_id int, claim_id long, statement string, finding_type string")
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "run_id int, id_a long, id_b long")
    got = links.detect_contradictions(pairs, said)
    assert sorted((r.id_a, r.id_b, r.category) for r in got.collect()) == [(1, 2, "SCOPE_DIFFERENCE"), (2, 3, "CONTEXTUAL_TENSION")]
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].upper()
