"""Session helpers: size-checked broadcasts, bounded Arrow batches, names that are free."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Lets no Arrow batch that goes to a Python worker grow far beyond `most` bytes; a lower bound of the session stays.

    Spark's own bound is made for narrow rows; whole texts fill such a batch twice over, in
    the executor and in its worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    bytes_now = None if now is None or not now.lower().removesuffix("b").isdigit() else int(now.lower().removesuffix("b"))
    if bytes_now is None or bytes_now <= 0 or bytes_now > most:
        spark.conf.set(name, str(most))


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only when the row count is checked to be within the bound."""
    return F.broadcast(df) if small(df, rows) else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until no column of df has it, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(col):
    """A-Z to a-z and nothing else. For a text of ASCII alone, lower() is the same and faster."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
