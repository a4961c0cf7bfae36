"""Operator 1, quality classifier: importance resampling towards a target.

Two bags of hashed words and word pairs, one of all raw texts and one of the target texts,
give each text a log ratio of its probabilities. Sampling without replacement in
proportion to the ratios is a top-k of log ratio plus Gumbel noise. The noise of a row
comes from a hash of its id, text and a seed, so that a lost task repeats it. The ratio is
that of the two models for the whole text; with `length` it is taken per word or pair and
scaled to so many of them, for a choice that does not grow with the length of texts.

The k-th largest key is found by histograms, each within the bin of the one before, so
that nothing is sorted in one place.

Defined results: null and empty texts have a log ratio of 0; a null label makes no target;
repeated rows share one key and so are kept or left together (the kept number can exceed k
by these); equal keys of different ids are kept by the smaller id; without target texts all
ratios are 0; very long texts are taken whole; an empty table gives no rows; other columns,
whatever their names, are ignored. Beyond 1,000,000 targets, texts are shuffled once by id
to be told from the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import bounded_batches, maybe_broadcast
from provlake.llm._text import Tokens, batches_of
from provlake.plans.session import checkpointed

BUCKETS = 10_000
SEED = 1
#: share of the rows that the sample keeps
KEEP = 0.85
BINS = 2_000
EXACT = 5_000


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each pair of neighbours."""
    t = Tokens(column)
    row, pair = t.grams(2)
    return np.concatenate((t.doc, row)), (np.concatenate((t.h, pair)) % np.uint64(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Log ratio of each bucket. target(doc_id): ids of the target texts; counts cover all rows."""
    flagged = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(maybe_broadcast(target.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True)), 1_000_000), "doc_id", "left").select(F.coalesce("target", F.lit(False)).alias("target"), "text")

    def count(batches):
        raw, wanted = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches_of(batches, "text"):
            row, bucket = buckets(batch.column(1))
            raw += np.bincount(bucket, minlength=BUCKETS)
            wanted += np.bincount(bucket[batch.column(0).to_numpy(zero_copy_only=False).astype(bool)[row]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(wanted[used])], names=["bucket", "raw", "target"])

    table = flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most BUCKETS rows
    raw, wanted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table.bucket], wanted[table.bucket] = table.raw, table.target
    if not wanted.sum():
        return np.zeros(BUCKETS)
    return np.log((wanted + 1) / (wanted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weighted(docs: DataFrame, ratios: np.ndarray, length: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and gumbel_key of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    uniform = (F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text")).cast("double") + F.lit(2.0**63) + 0.5) / F.lit(2.0**64)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("noise", -F.log(-F.log(F.least(F.greatest(uniform, F.lit(1e-15)), F.lit(1 - 1e-15)))))

    def run(batches):
        table = shared.value
        for batch in batches_of(batches, "text"):
            row, bucket = buckets(batch.column(1))
            weight = np.bincount(row, weights=table[bucket], minlength=batch.num_rows)
            if length is not None:
                weight *= length / np.maximum(np.bincount(row, minlength=batch.num_rows), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(weight + batch.column(2).to_numpy())], names=["doc_id", "log_weight", "gumbel_key"])

    return rows.mapInArrow(run, "doc_id long, log_weight double, gumbel_key double")


def kth_largest(rows: DataFrame, key: str, tie: str, k: int) -> tuple[float, int | None]:
    """(key, tie) of the k-th row by key descending, then tie ascending; the driver sees bin counts and at most EXACT rows, or ids with one equal key in the same manner."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if k >= n:
        return float("-inf"), None
    live = rows
    while True:
        if n <= EXACT:
            x = live.select(key, tie).toPandas().sort_values([key, tie], ascending=[False, True], na_position="first")
            value, last = x.iloc[k - 1]
            return float(value), None if last is None or last != last else int(last)
        if high <= low:  # one key: the tie decides
            reached, _ = kth_largest(live.select((-F.coalesce(tie, F.lit(-(2**53)))).cast("double").alias(key), F.lit(0).alias(tie)), key, tie, k)
            return float(low), -int(reached)
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1))
        table = live.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).toPandas().sort_values("bin", ascending=False)  # at most BINS rows
        above = table.n.cumsum()
        at = int(np.searchsorted(above.to_numpy(), k))
        k -= int(above.iloc[at] - table.n.iloc[at])
        n, low, high = int(table.n.iloc[at]), float(table.low.iloc[at]), float(table.high.iloc[at])
        live = live.where(F.col(key).between(low, high))


def resample(docs: DataFrame, target: DataFrame, keep: float = KEEP, length: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept of every row; kept marks the sample of keep * rows."""
    bounded_batches(docs.sparkSession)
    rows = checkpointed(weighted(docs, fit(docs, target), length, seed))
    n = rows.count()
    key, last = kth_largest(rows, "gumbel_key", "doc_id", max(1, round(keep * n))) if n else (0.0, None)
    tied = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(True))
    return rows.withColumn("kept", (F.col("gumbel_key") > key) | ((F.col("gumbel_key") == key) & tied))
