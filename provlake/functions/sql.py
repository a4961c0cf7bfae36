"""The same functions in SQL: SQL-bodied functions of the session, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from provlake.functions import text
from provlake.operators import urls


def written(spark: SparkSession, made: Column, *names: str) -> str:
    """A column expression over these strings, written as SQL. Lambdas have no such form."""
    rows = spark.createDataFrame([], ", ".join(f"{n} string" for n in names)).select(made.alias("out"))
    return rows._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Registers canonical_url (B1), url_host (B7), clean_query (C4) and normalize_statement (F11) as temporary functions of one string; their names."""
    x = F.col("x")
    stays = written(spark, urls.parameter_stays(F.col("p")), "p")
    trimmed = F.trim(F.coalesce(x, F.lit("")))
    listed = written(spark, F.split(F.regexp_extract(trimmed, urls.QUERY, 1), "&"), "x")
    kept = f"array_join(filter({listed}, p -> {stays}), '&')"
    bodies = {
        "canonical_url": written(spark, urls.with_query(trimmed, F.col("kept_parameters")), "x", "kept_parameters").replace("kept_parameters", kept),
        "url_host": written(spark, urls.host(x), "x"),
        "clean_query": written(spark, text.clean_query(x), "x"),
        "normalize_statement": written(spark, text.normalize_statement(x), "x"),
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    return list(bodies)
