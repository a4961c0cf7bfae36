"""Tables laid out for lists and lookups (H8, H9): files sorted by range, with an index of what each holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = 1_000_000


def write_sorted(df: DataFrame, at: str, order: list[str], newest_first: bool = True, lookup: tuple[str, ...] = (), rows: int = ROWS) -> None:
    """df as Parquet files of about `rows` rows under at/data, sorted by the columns of order, and at/index with a row for each file.

    order must be total for pages to be stable (rows equal in all its columns may change
    places between writes); nulls are the smallest values. Columns of lookup get bloom
    filters. The index is a row for each file: its name and place, rows, rows before it, and the least and
    greatest value of the first column of order and of the lookup columns, nulls aside.
    """
    spark = df.sparkSession
    n_files = max(1, -(-df.count() // rows))
    keys = [F.col(c).desc_nulls_last() if newest_first else F.col(c).asc_nulls_first() for c in order]
    writer = df.repartitionByRange(n_files, *keys).sortWithinPartitions(*keys).write
    for c in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.option("maxRecordsPerFile", 0).parquet(f"{at}/data")
    data = spark.read.schema(df.schema).parquet(f"{at}/data").select("*", F.col("_metadata.file_path").alias("__file"), F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).cast("long").alias("__place"))
    held = list(dict.fromkeys([order[0], *lookup]))
    files = data.groupBy("__file", "__place").agg(F.count("*").alias("__rows"), *[F.min(c).alias(f"least_{c}") for c in held], *[F.max(c).alias(f"most_{c}") for c in held])
    # names tell the number of the task that wrote them, and so the place of their range
    earlier = Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{at}/index")


def _of_files(spark: SparkSession, at: str, files: DataFrame) -> DataFrame:
    """The rows of some files, with the rows before each."""
    named = files.select("__file", "__before").collect()  # files of one page or one id
    schema = spark.read.parquet(f"{at}/data").schema
    if not named:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[r["__file"] for r in named])


def page_of(spark: SparkSession, at: str, order: list[str], limit: int, offset: int = 0, newest_first: bool = True) -> DataFrame:
    """Rows offset to offset + limit of the list that write_sorted laid out: only the files that hold them are read."""
    index = spark.read.parquet(f"{at}/index")
    files = index.where((F.col("__before") < offset + limit) & (F.col("__before") + F.col("__rows") > offset))
    skipped = files.agg(F.min("__before")).first()[0] or 0
    keys = [F.col(c).desc_nulls_last() if newest_first else F.col(c).asc_nulls_first() for c in order]
    return _of_files(spark, at, files).orderBy(*keys).offset(max(0, offset - skipped)).limit(limit)


def page_after(spark: SparkSession, at: str, order: list[str], limit: int, last: tuple, newest_first: bool = True) -> DataFrame:
    """The limit rows after a row whose values of order are last, none of them null: the next page, whatever was put before it.

    Files are taken from the index, in order, until they surely hold the page: one that may hold
    last itself, and those after it with limit rows in all.
    """
    first = order[0]
    index = spark.read.parquet(f"{at}/index")
    bound = F.col(f"least_{first}") if newest_first else F.col(f"most_{first}")
    open_ = index.where((bound <= last[0]) | bound.isNull() if newest_first else bound >= last[0])
    whole = (F.col(f"most_{first}") < last[0]) | F.col(f"most_{first}").isNull() if newest_first else F.col(f"least_{first}") > last[0]  # all of its rows come after last
    sure = F.sum(F.when(whole, F.col("__rows")).otherwise(0)).over(Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
    files = open_.withColumn("__sure", F.coalesce(sure, F.lit(0))).where(F.col("__sure") < limit)
    after, same = F.lit(False), F.lit(True)
    for c, value in zip(order, last, strict=True):
        beyond = F.col(c) < value if newest_first else F.col(c) > value
        after = after | (same & (F.coalesce(beyond, F.lit(newest_first))))
        same = same & F.coalesce(F.col(c) == value, F.lit(False))
    keys = [F.col(c).desc_nulls_last() if newest_first else F.col(c).asc_nulls_first() for c in order]
    return _of_files(spark, at, files).where(after).orderBy(*keys).limit(limit)


def lookup(spark: SparkSession, at: str, column: str, value) -> DataFrame:
    """Rows with a value in an indexed column: files whose range holds it are opened, and their bloom filters spare the rest."""
    index = spark.read.parquet(f"{at}/index")
    files = index.where((F.col(f"least_{column}") <= value) & (F.col(f"most_{column}") >= value))
    return _of_files(spark, at, files).where(F.col(column) == value)
