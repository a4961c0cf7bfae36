"""Session helpers: tables by name, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder where the cluster shares checkpoints: that of spark.checkpoint.dir.

    A master on this machine alone (tests, a laptop) may do without the setting and gets a
    local folder; on a cluster a folder of one machine would lose data, so that it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base}/{prefix}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"spark-{prefix}-", dir="/tmp")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, materialised in the shared folder named by spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, as Parquet in the shared folder.

    For steps that go on from round to round: a checkpoint keeps the size and the constraints
    that its plan was estimated to have, and these multiply with every join of every round.
    """
    df.write.parquet(at := shared_folder(df.sparkSession, "round"))
    return df.sparkSession.read.schema(df.schema).parquet(at)
