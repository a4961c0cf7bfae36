"""A run's whole record (H6), from the results of the operators that make its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.operators.provenance import execution_mode, quality_metrics, telemetry_record
from provlake.operators.urls import host

#: fixed values: names that all runs of one installation share
SETTINGS = ["ai_provider", "ai_model", "research_provider", "prompt_versions", "search_parallelism", "extraction_parallelism"]
#: fixed values: the stages whose seconds have a name of their own
STAGES = {"search_and_ranking": "search_duration_seconds", "extraction": "extraction_duration_seconds"}
METRICS = ["source_coverage", "evidence_coverage", "successful_fetch_rate", "evidence_eligibility_rate", "conclusion_traceability"]
KEEP_NULLS = {"ignoreNullFields": "false"}


def _listed(when: Column, *columns: str) -> Column:
    """The rows for which `when` holds as a JSON array of objects, in the order of their columns."""
    rows = F.array_sort(F.collect_list(F.when(when, F.struct(*columns))))
    return F.when(F.size(rows) > 0, F.to_json(rows, KEEP_NULLS)).otherwise("[]")


def _counted(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """key and a JSON object of the number of rows of each value, in the order of the values."""
    each = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), F.col("n").alias("v"))))
    return each.groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias(name))


def source_lists(sources: DataFrame, per_domain: int = 2, key: str = "run_id") -> DataFrame:
    """key and the JSON lists of rejected, successful and failed sources, and source_diversity over those that are not rejected.

    sources(key, url, title, source_type, lifecycle_state, reason, http_status, failure_type,
    error, word_count). A run's sources are the hits of its searches: some tens.
    """
    state = F.col("lifecycle_state")
    open_ = sources.where(state != "REJECTED")
    rejected = _listed(state == "REJECTED", "url", "title", "source_type", "reason")
    lists = sources.groupBy(key).agg(
        rejected.alias("rejected_sources"),
        rejected.alias("rejected_irrelevant_sources"),
        _listed(state == "EVIDENCE_ELIGIBLE", "url", "title", "http_status", "word_count").alias("successful_sources"),
        _listed(state == "FETCH_FAILED", "url", "title", "http_status", "failure_type", F.substring("error", 1, 100).alias("error")).alias("failed_sources"),
        F.countDistinct(F.when(state != "REJECTED", host(F.col("url")))).alias("__hosts"),
    )
    types = F.coalesce("__types", F.lit("{}"))
    diversity = F.concat(F.lit('{"unique_domains_count":'), F.col("__hosts").cast("string"), F.lit(f',"max_sources_per_domain":{per_domain},"source_types":'), types, F.lit("}"))
    return lists.join(_counted(open_, key, "source_type", "__types"), key, "left").withColumn("source_diversity", diversity).drop("__hosts", "__types")


def run_record(
    counters: DataFrame, sources: DataFrame, timing: DataFrame, contradictions: DataFrame, constraints: DataFrame, messages: DataFrame, modes: DataFrame,
    settings: dict[str, str], per_domain: int = 2, key: str = "run_id",
) -> DataFrame:
    """key, metadata map<string, string>: the record of every run of counters under all of its names (H6).

    counters as in telemetry_record and quality_metrics; sources as in source_lists;
    timing(key, name, value) in seconds by stage; contradictions(key, category);
    constraints(key and the columns of their summary); messages(key, message), kept in
    order of their text; modes(key, provider, fell_back). settings gives the names that all
    runs share (SETTINGS). A run without rows in a table has an empty list or object, or 0.0 seconds.
    """
    missing = set(SETTINGS) - set(settings)
    if missing:
        raise ValueError(f"settings lack {sorted(missing)}")
    parts = {n: "[]" for n in ("rejected_sources", "rejected_irrelevant_sources", "successful_sources", "failed_sources", "warnings")}
    parts |= {"source_diversity": f'{{"unique_domains_count":0,"max_sources_per_domain":{per_domain},"source_types":{{}}}}', "contradictions_by_category": "{}", "constraint_preservation": "{}"}
    parts |= {n: "0.0" for n in STAGES.values()} | {"execution_mode": "real", "quality_metrics": "{}"}
    summary = [c for c in constraints.columns if c != key]
    tables = [
        source_lists(sources, per_domain, key),
        timing.groupBy(key).agg(*[F.sum(F.when(F.col("name") == s, F.col("value"))).cast("string").alias(n) for s, n in STAGES.items()]),
        _counted(contradictions, key, "category", "contradictions_by_category"),
        constraints.select(key, F.to_json(F.struct(*summary), KEEP_NULLS).alias("constraint_preservation")),
        messages.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list("message"))).alias("warnings")),
        modes.select(key, execution_mode(F.col("provider"), F.col("fell_back")).alias("execution_mode")),
        quality_metrics(counters).select(key, F.to_json(F.struct(*METRICS), KEEP_NULLS).alias("quality_metrics")),
    ]
    out = telemetry_record(counters, settings=settings, key=key)
    for table in tables:
        out = out.join(table, key, "left")
    added = F.create_map(*[x for n, empty in parts.items() for x in (F.lit(n), F.coalesce(n, F.lit(empty)))])
    return out.select(key, F.map_concat("metadata", added).alias("metadata"))
