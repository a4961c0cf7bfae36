"""Sources and sinks (A): entity tables, ingest of hits, pages and responses, run output."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions import rules
from provlake.operators.urls import authority, canonical_url, classify_domain, url_safety

#: the eleven entity tables
SCHEMAS = {
    "research_projects": "id string, name string, description string, research_topic string, industry string, status string, created_at timestamp, updated_at timestamp",
    "research_questions": "id string, project_id string, question string, status string, created_at timestamp, updated_at timestamp",
    "research_runs": "id string, question_id string, status string, started_at timestamp, completed_at timestamp, error_message string, metadata_json string, created_at timestamp",
    "research_sub_questions": "id string, research_run_id string, question string, sequence_number int, status string, created_at timestamp, completed_at timestamp",
    "research_sources": "id string, research_run_id string, title string, url string, publisher string, author string, published_at timestamp, retrieved_at timestamp, source_type string, credibility_score double, metadata_json string, created_at timestamp",
    "source_contents": "id string, source_id string, content string, content_hash string, word_count int, extraction_status string, metadata_json string, created_at timestamp, updated_at timestamp",
    "findings": "id string, research_run_id string, statement string, finding_type string, confidence double, importance string, created_at timestamp, updated_at timestamp",
    "evidences": "id string, finding_id string, source_id string, source_content_id string, excerpt string, relevance_score double, evidence_type string, created_at timestamp",
    "contradictions": "id string, research_run_id string, finding_a_id string, finding_b_id string, description string, severity string, contradiction_category string, resolution_status string, resolution_notes string, created_at timestamp",
    "conclusions": "id string, research_run_id string, statement string, confidence double, created_at timestamp, updated_at timestamp",
    "conclusion_findings": "conclusion_id string, finding_id string",
}
#: what an unparseable response leaves and what a parsed one holds
RESPONSE = "array<struct<statement:string,finding_type:string,confidence:double>>"


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An entity table with its fixed schema (A1)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def ingest_hits(df: DataFrame) -> DataFrame:
    """Typed search hits from raw ones(url, title, snippet): canonical url, defaults, type and credibility; unsafe urls go (A2)."""
    out = df.withColumn("url", canonical_url(F.col("url"))).where(url_safety(F.col("url"))["safe"])
    kind = classify_domain(F.col("url"))
    return out.withColumns({"title": F.coalesce("title", F.lit("Untitled Source")), "snippet": F.coalesce("snippet", F.lit("")), "publisher": authority(F.col("url")), "source_type": kind["source_type"], "credibility": kind["quality"]})


def ingest_pages(df: DataFrame, body: str = "body", limit: int = rules.MAX_BODY_BYTES) -> DataFrame:
    """Page snapshots with the body cut at a number of bytes, a broken last character dropped (A3)."""
    raw = F.encode(F.col(body), "UTF-8")
    cut = F.when(F.octet_length(body) > limit, F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, limit).cast("string")), "�+$", "")).otherwise(F.col(body))
    return df.withColumn(body, cut)


def parse_responses(df: DataFrame, column: str = "response", schema: str = RESPONSE) -> DataFrame:
    """Rows of each structured response, one an item; an unparseable one gives a row with quarantined true (A4)."""
    parsed = df.withColumn("__items", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    bad = F.col("__items").isNull() | F.exists("__items", lambda x: x["statement"].isNull())
    out = parsed.withColumn("quarantined", F.coalesce(bad, F.lit(True)))
    items = F.when(F.col("quarantined"), F.array(F.lit(None).cast(schema[6:-1]))).otherwise(F.col("__items"))
    return out.select(*[c for c in df.columns if c != column], "quarantined", F.posexplode(items).alias("item", "__x")).select("*", "__x.*").drop("__x")


def meta_get(column: Column, path: str, default: float) -> Column:
    """A number inside a JSON column, with a default (A5)."""
    return F.coalesce(F.get_json_object(column, path).try_cast("double"), F.lit(default))


def as_variant(column: Column) -> Column:
    """A JSON text as a variant value, parsed once where it is written; null if it is no JSON (A5)."""
    return F.try_parse_json(column)


def variant_meta(column: Column, path: str, default: float) -> Column:
    """A number inside a variant column, with a default for what is missing or no number (A5)."""
    return F.coalesce(F.try_variant_get(column, path, "double"), F.lit(default))


COMMIT = "run_id string, status string, error_message string, version string"
LOG = "value string"


def _files(spark: SparkSession, path: str):
    """(file system of a path, the path's own constructor) of any store that Spark reads."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def _publish(spark: SparkSession, path: str, version: str) -> int:
    """Gives a version the next number: a file of that name, created only if no writer has it; the loser takes the one after.

    A store must refuse to create a file twice for two writers to be told apart.
    """
    fs, of = _files(spark, path)
    fs.mkdirs(of(f"{path}/_log"))
    number = max((int(x.getPath().getName()) for x in fs.listStatus(of(f"{path}/_log")) if x.getPath().getName().isdigit()), default=0)
    while True:
        number += 1
        try:
            out = fs.create(of(f"{path}/_log/{number:020d}"), False)
        except Exception as e:
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            continue
        out.write(bytearray(version.encode()))
        out.close()
        return number


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """run_id, status, error_message, version, commit: what each published commit says; the order is that of the numbers."""
    number = F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("long").alias("commit")
    log = spark.read.schema(LOG).text(f"{path}/_log").select(number, F.col("value").alias("version"))  # a row for each write
    return spark.read.schema(COMMIT).parquet(f"{path}/_commits").join(log, "version")


def write_run(tables: dict[str, DataFrame], path: str, runs: DataFrame, key: str = "run_id") -> int:
    """Writes the runs' rows of all tables as one: all are seen, or none is (A6). The number of the commit.

    The run ids and the tables go to a version of their own first; the runs(key) then become
    visible by one small file, created last. On an error nothing of the version is ever
    read, the runs get a failed row with the message, and the error goes on; if the ids
    themselves can't be made, the failed row has none. read_run gives what was committed
    last for each run; a run without rows in a table has none there afterwards. Of two
    writers at a time, the one with the higher number is the later.
    """
    spark, version = runs.sparkSession, uuid.uuid4().hex

    def commit(ids: DataFrame, status: str, message: str | None) -> int:
        ids.select("run_id", F.lit(status).alias("status"), F.lit(message).cast("string").alias("error_message")).write.parquet(f"{path}/_commits/version={version}")
        return _publish(spark, path, version)

    said = lambda e: str(e).splitlines()[0] if str(e) else type(e).__name__
    try:
        runs.select(F.col(key).cast("string").alias("run_id")).distinct().write.parquet(f"{path}/_ids/version={version}")
    except Exception as e:
        commit(spark.createDataFrame([(None,)], "run_id string"), "failed", said(e))
        raise
    ids = spark.read.schema("run_id string").parquet(f"{path}/_ids/version={version}")
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{path}/{name}/version={version}")
    except Exception as e:
        commit(ids, "failed", said(e))
        raise
    return commit(ids, "completed", None)


def run_states(spark: SparkSession, path: str) -> DataFrame:
    """run_id, status, error_message, commit: the last commit of each run, failed ones too."""
    last = F.max_by(F.struct("status", "error_message", "commit"), "commit").alias("x")
    return _commits(spark, path).groupBy("run_id").agg(last).select("run_id", "x.*")


def _live(spark: SparkSession, path: str) -> DataFrame:
    """run_id and the version that was committed last for it."""
    return _commits(spark, path).where("status = 'completed'").groupBy("run_id").agg(F.max_by("version", "commit").alias("version"))


def read_run(spark: SparkSession, path: str, name: str, key: str = "run_id") -> DataFrame:
    """The rows of a table that were committed last for each run; a later failure takes nothing away. Only folders that hold such rows are opened."""
    live = _live(spark, path)
    fs, of = _files(spark, path)
    folders = [f"{path}/{name}/version={r.version}" for r in live.select("version").distinct().collect()]  # one for each write that still counts
    folders = [f for f in folders if fs.exists(of(f))]
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(*folders)
    done = live.select(F.col("run_id").alias("__run"), F.col("version").alias("__version"))
    return rows.join(done, (F.col("version") == F.col("__version")) & (F.col(key).cast("string") == F.col("__run")), "left_semi").drop("version")


def expire(spark: SparkSession, path: str, retain: int = 10) -> list[str]:
    """Deletes the folders of versions that no run reads any more and that are older than the last `retain` commits; their names."""
    commits = _commits(spark, path)
    newest = commits.agg(F.max("commit")).first()[0] or 0
    live = {r.version for r in _live(spark, path).select("version").distinct().collect()}
    old = {r.version for r in commits.where(F.col("commit") <= newest - retain).select("version").distinct().collect()} - live
    fs, of = _files(spark, path)
    for top in fs.listStatus(of(path)):
        if top.isDirectory() and not top.getPath().getName() in ("_log", "_commits"):
            for version in sorted(old):
                fs.delete(of(f"{top.getPath()}/version={version}"), True)
    return sorted(old)


def export_summary(df: DataFrame, path: str) -> None:
    """A summary as JSON lines."""
    df.write.mode("overwrite").json(path)
