"""The best documents, caps, sketches and metadata beyond what the tables hold."""

import random

import pytest
from pyspark.sql import functions as F

from provlake.functions.text import tokens
from provlake.operators import retrieval
from provlake.plans import session
from provlake.sources import entities


@pytest.fixture(scope="module")
def asked(spark):
    """Skewed words, so that some stand in most documents; copies and ties; queries without a hit, of one word and of many."""
    rng = random.Random(11)
    words = [f"word{i:03}" for i in range(300)]
    pick = lambda n: " ".join(words[min(int(rng.paretovariate(0.6)) - 1, 299)] for _ in range(n))
    docs = [(i, pick(rng.randrange(0, 60))) for i in range(1500)] + [(1500 + i, "word001 word002 word250") for i in range(40)] + [(None, pick(9)), (9999, None), (9998, "")]
    asked = [(i, pick(rng.randrange(1, 25))) for i in range(60)] + [(60, "nowhere at all"), (61, ""), (62, None), (None, "word001"), (63, "word001 word002 word250"), (64, "word000")]
    return spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def brute(spark, asked):
    queries, docs = asked
    q = [(r.query_id, set(r.t)) for r in queries.select("query_id", tokens(F.col("query")).alias("t")).collect() if r.query_id is not None]
    c = [(r.doc_id, set(r.t)) for r in docs.select("doc_id", tokens(F.col("text")).alias("t")).collect() if r.doc_id is not None]
    return {(i, k): sorted((-len(t & u), x) for x, u in c if t & u)[:k] for i, t in q for k in (1, 5, 50)}


@pytest.mark.parametrize("k", [1, 5, 50])
@pytest.mark.parametrize("form", ["scan", "scan in small slices", "tokens", "tokens in parts"])
def test_best_documents(spark, asked, brute, monkeypatch, form, k):
    queries, docs = asked
    if form == "scan in small slices":
        whole = retrieval.best_in_scan
        monkeypatch.setattr(retrieval, "best_in_scan", lambda w, p, k: whole(w, p, k, most=500))
    if form == "tokens in parts":
        every = retrieval.best_by_tokens
        monkeypatch.setattr(retrieval, "best_by_tokens", lambda w, p, k, keep: every(w, p, k, keep, part=100))
    out = retrieval.retrieve(queries, docs, k, 1_000_000 if form.startswith("scan") else 10, session.checkpointed)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.hits, r.doc_id))
    assert got == {i: rows for (i, n), rows in brute.items() if n == k and rows}


def test_first_of_a_host_are_accepted(spark):
    rows = [(1, i, f"https://hot.org/{i}" if i % 3 else f"https://h{i % 7}.org/", i) for i in range(200)] + [(None, 1000, "https://hot.org/", 0), (2, 1001, None, 1)]
    df = spark.createDataFrame(rows, "run_id int, page_id int, url string, accepted_before int").repartition(7)
    out = retrieval.diversity_split(df, "run_id", ["page_id"])
    got = {(r.run_id, r.page_id): r.accepted for r in out.collect()}
    seen, want = {}, {}
    for run, page, url, _ in sorted(rows, key=lambda r: r[1]):
        k = (run, url and url.split("/")[2])
        seen[k] = seen.get(k, 0) + 1
        want[run, page] = seen[k] <= 2
    assert got == want and out.columns == [*df.columns, "accepted", "rejection_reason"]
    assert {r.rejection_reason for r in out.where("not accepted").collect()} == {"DOMAIN_DIVERSITY_CAP"}


def test_sketches_merge_within_their_error(spark):
    """30,000 hosts over 10 days, each day's overlapping the next: any days merged are within 5 %."""
    df = spark.range(60_000).select(F.lit(1).alias("run_id"), (F.col("id") % 10).alias("day"), F.concat(F.lit("https://h"), (F.floor(F.col("id") / 2)).cast("string"), F.lit(".org/")).alias("url"))
    sketches = retrieval.domain_sketches(df, "run_id", "day")
    for days in ([0], [0, 1, 2], list(range(10))):
        exact = df.where(F.col("day").isin(days)).select("url").distinct().count()
        r = retrieval.merged_domains(sketches.where(F.col("day").isin(days)), "run_id").first()
        assert r.n == 6_000 * len(days) and abs(r.unique_domains - exact) < 0.05 * exact
    assert retrieval.merged_domains(sketches).first().n == 60_000


def test_variants_and_texts_agree(spark):
    texts = ['{"relevance":{"score":0.25}}', '{"relevance":{"score":"0.5"}}', '{"relevance":{"score":"high"}}', '{"relevance":[1]}', '{"relevance":{"score":null}}', "no json", "", None, '{"relevance":{"score":3}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, meta string")
    both = df.select("i", entities.meta_get(F.col("meta"), "$.relevance.score", 0.7).alias("a"), entities.variant_meta(entities.as_variant(F.col("meta")), "$.relevance.score", 0.7).alias("b"))
    rows = both.orderBy("i").collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [0.25, 0.5, 0.7, 0.7, 0.7, 0.7, 0.7, 0.7, 3.0]
