"""A training-data pipeline over documents; each stage calls one operator of provlake.llm.

A stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns
of documents; the last returns the packed pieces. run() writes each stage's result to the
folder of spark.checkpoint.dir before the next one reads it, so that a lost executor never
costs more than a stage.

Defined results of all stages: a null or empty text is kept and stays as it is (packed, it
is one end id); a row with a null id goes on like any other, unless a stage below says
else; columns beyond those of documents are kept by all but the last stage, whatever their
names; no rows give no rows; texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import decontamination, near_duplicates, packing, site_lines, toxicity
from provlake.llm.queries import vocabulary
from provlake.plans.session import shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go (operator 10).

    Repeated rows have one score and go or stay together; a score at the threshold is toxic.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source and repeated passages go (operator 3); n_chars follows the text.

    Pages with one and the same text count once, and null and empty sources are one host.
    A line at the bound itself stays. A document that loses all its lines stays with
    an empty text. A column n_chars is taken to be the text's length in characters, null
    for a null text.
    """
    out = site_lines.cleaned(docs, **site_lines.HOST_RULE)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 7, similarity of 0.8 or more).

    The smallest id of a group stays, and one row of an id that is repeated. A row with a
    null id stays if nothing with an id is like it; texts without words are like nothing.
    """
    return near_duplicates.unique_documents(docs, 80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go (operator 5): those with a twentieth of their words or more in windows of its items.

    Texts without words are clean; repeated rows go or stay together.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences (operator 8): a row a piece, without the columns of documents but for doc_id.

    Repeated rows are packed each; which of two pieces of one length comes first depends on the order of rows.
    """
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near-dedup", near), ("decontamination", benchmark), ("packing", pack)]

#: SQL cannot express the learnt classifier and the tokenizer; tests/llm/test_pipeline.py has a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(at := f"{folder}/stage{k}")
            docs = spark.read.parquet(at)
    return docs
