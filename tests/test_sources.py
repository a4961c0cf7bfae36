"""Sources, sinks and rollups on rows written for them."""

import pytest
from pyspark.sql import functions as F

from provlake.operators import provenance
from provlake.sources import entities


def test_entity_schemas_round_trip(spark, tmp_path):
    for name, schema in entities.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
        assert entities.load(spark, str(tmp_path), name).schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()


def test_hits_get_defaults_and_unsafe_ones_go(spark):
    rows = [("https://www.reuters.com/a?utm_source=x", None, None), ("http://127.0.0.1/", "t", "s"), ("https://a.example.com", "t", "s")]
    out = {r.url: r for r in entities.ingest_hits(spark.createDataFrame(rows, "url string, title string, snippet string")).collect()}
    assert set(out) == {"https://www.reuters.com/a", "https://a.example.com"}
    first = out["https://www.reuters.com/a"]
    assert (first.title, first.snippet, first.publisher, first.source_type, first.credibility) == ("Untitled Source", "", "www.reuters.com", "news", 0.85)


def test_long_bodies_are_cut_at_bytes(spark):
    rows = [(1, "aé" * 10), (2, "short"), (3, None)]
    out = {r.i: r.body for r in entities.ingest_pages(spark.createDataFrame(rows, "i int, body string"), limit=11).collect()}
    assert out == {1: "aéaéaéa", 2: "short", 3: None}


def test_responses_are_parsed_or_quarantined(spark):
    rows = [(1, '[{"statement":"a","finding_type":"fact","confidence":0.5},{"statement":"b"}]'), (2, "not json"), (3, None), (4, "[]")]
    out = entities.parse_responses(spark.createDataFrame(rows, "i int, response string"))
    got = sorted((r.i, r.quarantined, r.item, r.statement) for r in out.collect())
    assert got == [(1, False, 0, "a"), (1, False, 1, "b"), (2, True, 0, None), (3, True, 0, None)]


def test_writing_a_run_replaces_only_that_run(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int")
    at = str(tmp_path)
    entities.write_run({"t": df}, at, df)
    entities.write_run({"t": df.where("run_id = 'a'").withColumn("x", F.lit(9))}, at, df.where("run_id = 'a'"))
    assert sorted((r.run_id, r.x) for r in entities.read_run(spark, at, "t").collect()) == [("a", 9), ("b", 2)]


def test_a_failed_run_leaves_nothing_but_its_state(spark, tmp_path):
    """The second table fails after the first is written: neither is seen, and the run has a failed row."""
    df, at = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int"), str(tmp_path)
    entities.write_run({"t": df, "u": df}, at, df)
    bad = df.withColumn("x", F.raise_error(F.lit("no such number")).cast("int"))
    with pytest.raises(Exception, match="no such number"):
        entities.write_run({"t": df.withColumn("x", F.lit(9)), "u": bad}, at, df.where("run_id = 'a'"))
    for name in ("t", "u"):
        assert sorted((r.run_id, r.x) for r in entities.read_run(spark, at, name).collect()) == [("a", 1), ("b", 2)]
    states = {r.run_id: (r.status, r.error_message) for r in entities.run_states(spark, at).collect()}
    assert states["b"] == ("completed", None) and states["a"][0] == "failed" and "no such number" in states["a"][1]


def test_ids_that_fail_leave_a_failed_row(spark, tmp_path):
    df, at = spark.createDataFrame([("a", 1)], "run_id string, x int"), str(tmp_path)
    bad = df.withColumn("run_id", F.raise_error(F.lit("no ids")).cast("string"))
    with pytest.raises(Exception, match="no ids"):
        entities.write_run({"t": df}, at, bad)
    assert [(r.run_id, r.status, "no ids" in r.error_message) for r in entities.run_states(spark, at).collect()] == [(None, "failed", True)]
    entities.write_run({"t": df}, at, df)
    assert [r.x for r in entities.read_run(spark, at, "t").collect()] == [1]


def test_two_writers_and_expiry(spark, tmp_path):
    """Writers at a time get numbers of their own, their versions never mix, and what no run reads goes."""
    from concurrent.futures import ThreadPoolExecutor

    at = str(tmp_path)

    def wrote(k):
        df = spark.createDataFrame([("a", k, i) for i in range(3)], "run_id string, k int, i int")
        return entities.write_run({"t": df}, at, df)

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(wrote, range(6)))
    assert sorted(numbers) == list(range(1, 7))
    last = numbers.index(6)
    got = [(r.k, r.i) for r in entities.read_run(spark, at, "t").collect()]
    assert sorted(got) == [(last, i) for i in range(3)]
    read = entities.read_run(spark, at, "t").inputFiles()
    assert len({f.split("version=")[1].split("/")[0] for f in read if "/t/version=" in f}) == 1
    assert len(entities.expire(spark, at, retain=2)) == 4 and len(list((tmp_path / "t").glob("version=*"))) == 2
    assert sorted((r.k, r.i) for r in entities.read_run(spark, at, "t").collect()) == sorted(got)


def test_cascade_and_consolidation(spark):
    projects = spark.createDataFrame([(1, "A "), (2, "a"), (3, "b")], "id int, name string").withColumn("created_at", F.col("id"))
    asked = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "question_id int, project_id int")
    kept, moved = provenance.consolidate(projects, asked)
    assert {(r.id, r.merged) for r in kept.collect()} == {(2, 1), (3, 0)}
    assert {(r.question_id, r.project_id) for r in moved.collect()} == {(10, 2), (11, 2), (12, 3)}
    evidence = spark.createDataFrame([(100, 10, 7), (101, 12, 10)], "evidence_id int, question_id int, content_id int")
    left = provenance.cascade_delete({"projects": projects, "asked": asked, "evidence": evidence}, projects.where("id = 1").select("id"), "id", [("projects", "id", "id"), ("asked", "project_id", "question_id"), ("evidence", "question_id", "evidence_id")])
    assert (left["projects"].count(), left["asked"].count(), left["evidence"].count()) == (2, 2, 1)
    nulled = provenance.cascade_delete({"evidence": evidence}, spark.createDataFrame([(7,)], "id int"), "id", [], [("evidence", "content_id")])["evidence"]
    assert {r.content_id for r in nulled.collect()} == {None, 10}


def test_relative_age(spark):
    ages = [(0, "Just now"), (20, "20s ago"), (300, "5m ago"), (7200, "2h ago"), (90_000, "Yesterday"), (3 * 86400, "3d ago"), (30 * 86400, "2023-12-16")]
    df = spark.createDataFrame([(s, w) for s, w in ages], "s int, want string")
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    got = df.select("want", provenance.relative_age(F.timestamp_micros(F.unix_micros(now) - F.col("s") * F.lit(1_000_000).cast("long")), now).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
