"""The way from candidate claims to findings, on claims written for it."""

from pyspark.sql import functions as F

from provlake.operators import findings
from provlake.plans import session

CLAIM = "run_id string, claim_id long, batch long, source_id long, source_url string, statement string, excerpt string, finding_type string, importance string, confidence double, relevance double"
SOURCE = "batch long, source_id long, url string, content string, relevance double, credibility double, role string"
TEXT = "Output of steel mills rose across many northern towns in China. Wind farms need rare metals. Over 12 mills closed"


def made(spark, rows, texts=None, **more):
    sources = texts or [(1, 10, "u10", TEXT, 0.5, 0.9, "PRIMARY"), (1, 11, "u11", TEXT, 0.5, None, "DISCOVERY_ONLY"), (2, 20, "u20", TEXT, 0.25, 0.1, "DISCOVERY_ONLY")]
    claims = [(run, i, batch, source, url, said, excerpt, kind, "high", 0.9, 0.95) for i, (run, batch, source, url, said, excerpt, kind) in enumerate(rows, 1)]
    return findings.run_findings(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(sources, SOURCE), session.checkpointed, **more)


def test_each_cause_and_each_way_to_a_source(spark):
    wind, mills = "Wind farms need rare metals", "Over 12 mills closed"
    rows = [
        ("a", 1, 10, None, wind, wind, "fact"),  # by id
        ("a", 1, None, "u11", wind.upper(), f" {wind} ", "fact"),  # by url, a copy in capitals
        ("a", 1, None, None, wind, wind, "fact"),  # two sources in the batch: unresolved
        ("b", 2, 99, "none", mills, mills, "fact"),  # the only source of the batch
        ("b", 2, 20, None, "", mills, "fact"),
        ("b", 2, 20, None, None, mills, "fact"),
        ("b", 2, 20, None, mills, " ", "fact"),
        ("b", 2, 20, None, mills, None, "fact"),
        ("b", 2, 20, None, "Over 13 mills closed", "13 mills", "fact"),
        ("b", 2, 20, None, "All 77 plants stay open", "Over 12 mills closed", "risk"),  # an alert, but used
        ("c", 3, 10, None, wind, wind, "fact"),  # a batch without sources
    ]
    out = made(spark, rows)
    counts = {r.run_id: r.asDict() for r in out.counts.collect()}
    assert counts["a"] == {"run_id": "a", "candidates": 3, "unsupported": 1, "claims": 2, "numeric_alerts": 0, "merged": 1, "grounded": 1, "evidence": 2}
    assert counts["b"] == {"run_id": "b", "candidates": 7, "unsupported": 5, "claims": 2, "numeric_alerts": 1, "merged": 0, "grounded": 2, "evidence": 2}
    assert counts["c"] == {"run_id": "c", "candidates": 1, "unsupported": 1, "claims": 0, "numeric_alerts": 0, "merged": 0, "grounded": 0, "evidence": 0}
    got = {r.group_id: r for r in out.findings.collect()}
    assert sorted(got) == [1, 4, 10]
    assert (got[1].n_sources, got[1].role, got[1].is_contradicted) == (2, "PRIMARY", False)
    assert got[1].confidence == round(0.2 + 0.3 * 0.5 + 0.3 * (0.9 + 0.75) / 2 + 0.08, 2)
    assert got[4].role == "DISCOVERY_ONLY" and got[4].confidence == round(0.2 + 0.3 * 0.25 + 0.3 * 0.1, 2)
    assert {(r.group_id, r.claim_id, r.source_id, r.excerpt) for r in out.evidence.where("group_id = 1").collect()} == {(1, 1, 10, wind), (1, 2, 11, wind)}


def test_conflicts_lower_confidence_and_the_cap_keeps_first_groups(spark):
    texts = [(1, 10, "u10", "zebra " * 5 + TEXT + ". " + ". ".join(f"lion{i} otter{i} whale{i} crane{i}" for i in range(60)), 0.5, 0.9, "PRIMARY")]
    steel = "Output of steel mills rose across many northern towns"
    rows = [("a", 1, 10, None, steel, steel, "fact")] * 30 + [("a", 1, 10, None, steel, steel, "risk")]
    rows += [("a", 1, 10, None, f"lion{i} otter{i} whale{i} crane{i}", f"lion{i} otter{i}", "fact") for i in range(60)]
    out = made(spark, rows, texts)
    got = {r.group_id: r for r in out.findings.collect()}
    assert sorted(got) == [1, *range(32, 71)]
    assert (got[1].merged_count, got[1].n_evidence, got[1].n_sources) == (31, 31, 1)
    assert (got[1].is_contradicted, got[1].severity, got[1].contradiction_penalty) == (True, "medium", 0.08)
    assert got[32].contradiction_penalty == 0.0 and round(got[32].confidence - got[1].confidence, 2) == 0.08
    assert out.counts.first()["merged"] == 30 and out.evidence.count() == 31 + 39


def test_no_claims(spark):
    out = made(spark, [("a", 1, 10, None, "x", "not there", "fact")])
    assert out.findings.count() == out.evidence.count() == 0 and out.counts.count() == 1
    none = findings.run_findings(spark.createDataFrame([], CLAIM), spark.createDataFrame([], SOURCE), session.checkpointed)
    assert none.findings.where(F.lit(True)).count() == none.counts.count() == 0


def test_alerts_of_the_query_as_in_sql(spark, tmp_path):
    import duckdb

    from provlake.plans import catalog

    text = "Call 555-0303 for the annual report of mills. Over 12 mills closed in nine northern towns"
    spark.createDataFrame([(i, text, "en", "src1", len(text)) for i in range(1, 5)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES["f21_finding_counts"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL['f21_finding_counts']})").fetchall()
    assert [tuple(r) for r in got.collect()] == want


def test_a_phone_number_is_an_alert_only_as_an_inverted_range(spark):
    call = "Call 555-0303 for the annual report of mills"
    texts, rows = [(1, 10, "u10", call, 0.5, 0.9, "PRIMARY")], [("a", 1, 10, None, call, call, "fact"), ("a", 1, 10, None, "Call 77 mills for a report", call, "fact")]
    assert made(spark, rows, texts).counts.first()["numeric_alerts"] == 2
    assert made(spark, rows, texts, inverted=False).counts.first()["numeric_alerts"] == 1
