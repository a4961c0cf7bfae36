"""A run's record where its parts are missing or awkward."""

import json

import pytest

from provlake.operators import telemetry

SETTINGS = {n: n for n in telemetry.SETTINGS}
SOURCE = "run_id long, url string, title string, source_type string, lifecycle_state string, reason string, http_status int, failure_type string, error string, word_count long"
METRICS = "discovered, selected, fetched, eligible, findings, grounded, conclusions, linked_conclusions"


def record(spark, sources, runs=((1,), (2,)), settings=SETTINGS):
    counters = spark.createDataFrame([(r, *[4] * 8) for (r,) in runs], "run_id long, " + ", ".join(f"{c} long" for c in METRICS.split(", ")))
    empty = lambda schema: spark.createDataFrame([], f"run_id long, {schema}")
    out = telemetry.run_record(counters, spark.createDataFrame(sources, SOURCE), empty("name string, value double"), empty("category string"), empty("a boolean, b long"), empty("message string"), empty("provider string, fell_back boolean"), settings)
    return {r.run_id: r.metadata for r in out.collect()}


def test_lists_and_what_is_missing(spark):
    sources = [
        (1, "https://a.org/1", 'say "x"\n', "general_web", "FETCH_FAILED", None, None, "timeout", "e" * 300, None),
        (1, "https://a.org/0", None, "general_web", "EVIDENCE_ELIGIBLE", None, 200, None, None, 7),
        (1, "https://b.org/", "t", None, "DISCOVERED", None, None, None, None, None),
        (1, "https://c.org/", "t", "news", "REJECTED", "RANK_BELOW_TOP_N", None, None, None, None),
    ]
    got = record(spark, sources)
    one, two = got[1], got[2]
    assert json.loads(one["failed_sources"]) == [{"url": "https://a.org/1", "title": 'say "x"\n', "http_status": None, "failure_type": "timeout", "error": "e" * 100}]
    assert json.loads(one["successful_sources"]) == [{"url": "https://a.org/0", "title": None, "http_status": 200, "word_count": 7}]
    assert one["rejected_sources"] == one["rejected_irrelevant_sources"] and json.loads(one["rejected_sources"])[0]["reason"] == "RANK_BELOW_TOP_N"
    assert json.loads(one["source_diversity"]) == {"unique_domains_count": 2, "max_sources_per_domain": 2, "source_types": {"general_web": 2}}
    assert two["rejected_sources"] == two["warnings"] == "[]" and two["search_duration_seconds"] == "0.0" and two["execution_mode"] == "real"
    assert json.loads(two["source_diversity"])["unique_domains_count"] == 0
    assert json.loads(one["quality_metrics"])["conclusion_traceability"] is True and set(one) == set(two)


def test_settings_are_asked_for(spark):
    with pytest.raises(ValueError, match="ai_model"):
        record(spark, [], settings={k: v for k, v in SETTINGS.items() if k != "ai_model"})


def test_all_names(spark):
    from provlake.plans import catalog

    rows = catalog.QUERIES["h06_run_record"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.n_names for r in rows} == {45}
