"""Operator 10, toxicity: a linear classifier by non-negative positive-unlabelled learning.

Only confirmed toxic examples count as labels; every other training text is unlabelled, a
mixture that holds toxic texts too. With class prior p, losses l and scores z, the risk

    p * mean_P l(z) + max(0, mean_U l(-z) - p * mean_P l(-z))

corrects the unlabelled part for the toxic share in it, and is kept from going negative.
Features are hashed words, beginnings of words and 5-byte windows of the lower-cased text
(ASCII signs count as a space), present or absent. Those are used that are at least LIFT
times as frequent in confirmed texts as in the others, and so by more than chance: tails of
the binomial distribution, with at most FALSE_DISCOVERIES of them false (Benjamini and
Hochberg), which asks of few confirmed texts no more than they can show. Their frequencies
are counted over all training texts. The fit takes at most MAX_POSITIVE confirmed rows, and
as many unlabelled rows as keep the standard error of their mean loss, which lies between 0
and 1, within RISK_ERROR. Weights are zero or more. Scoring covers every text whole.

Defined results: a null or empty text has no features and gets the score of the intercept;
a null label is no label; a null doc_id is never learnt from and is not held out; repeated
rows each get their score; of equally telling features the lower bucket comes first; without
a single confirmed example, or with none that tells anything, all scores are 0; very long
texts are taken whole, by segments; an empty table gives no rows; other columns, whatever
their names, are ignored (without_toxic keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import bounded_batches
from provlake.llm._text import LOWER, Tokens, batches_of, spans_of, windows

WINDOW = 5
PREFIXES = (4, 6, 8)
BUCKETS = 1 << 20
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: bound of the confirmed sample, in rows, and of the sampling error of the unlabelled risk
MAX_POSITIVE = 8_000
RISK_ERROR = 0.004
MAX_FEATURES = 2_000
LIFT = 3.0
FALSE_DISCOVERIES = 0.02

#: other ASCII signs than letters and digits end a word
NO_WORD = np.zeros(256, dtype=bool)
NO_WORD[[x for x in range(128) if not chr(x).isalnum()]] = True
_FOLD = np.where(NO_WORD, 32, LOWER).astype(np.uint8)


@dataclass
class Model:
    """weight of each bucket (0: unused) and the intercept."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, dtype=np.float32))
    bias: float = float("-inf")


def present(column: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, bucket) with wanted[bucket] of every word, word beginning and window of the texts."""
    t = Tokens(column, _FOLD, NO_WORD)
    keys = []

    def add(row, h):
        bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
        hit = wanted[bucket]
        keys.append(np.unique(row[hit] * BUCKETS + bucket[hit]))

    add(t.doc, t.h)
    for n in PREFIXES:
        add(*t.prefixes(n))
    for row, h in windows(t.raw, t.offsets, WINDOW):
        add(row, h)
    both = np.unique(np.concatenate(keys))
    return both // BUCKETS, both % BUCKETS


def fold_of(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(rows_p, cols_p, n_p, rows_u, cols_u, n_u, start, prior, steps=30, rate=0.05, decay=1e-5):
    """Weights and intercept by full-batch Adam on the non-negative risk with the sigmoid loss l(z) = 1 / (1 + exp(z))."""
    mean = np.bincount(rows_p, weights=start[cols_p], minlength=n_p).mean()
    w = np.append(start * (10 / mean if mean else 0.0), -2.0)  # the last is the intercept; confirmed texts begin at 8
    m, v = np.zeros_like(w), np.zeros_like(w)

    def scores(rows, cols, n):
        z = np.bincount(rows, weights=w[cols], minlength=n)[:n] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def gradient(rows, cols, g):
        return np.append(np.bincount(cols, weights=g[rows], minlength=len(w) - 1), g.sum())

    for t in range(1, steps + 1):
        p, u = scores(rows_p, cols_p, n_p), scores(rows_u, cols_u, n_u)  # l(-z) of both
        on_p = gradient(rows_p, cols_p, prior * p * (1 - p) / n_p)
        apart = gradient(rows_u, cols_u, u * (1 - u) / n_u) - on_p
        g = apart - on_p if u.mean() >= prior * p.mean() else -apart
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])
    return w[:-1], float(w[-1])


def telling(p: np.ndarray, n_p: int, others: np.ndarray, n_others: int, most: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(indices, log odds) of the features that are surely more frequent in the confirmed texts, most certain first.

    p of n_p confirmed texts and others of n_others have each feature.
    """
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n_p + 1)))))
    rate = (others + 1) / (n_others + 2)
    ratio = (n_p - p) / (p + 1) * rate / (1 - rate)  # of each term of the tail to the one before, at most
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = logs[n_p] - logs[p] - logs[n_p - p] + p * np.log(rate) + (n_p - p) * np.log1p(-rate) - np.log(1 - ratio)
    tail = np.where((ratio < 1) & (p > rate * n_p), np.minimum(tail, 0), 0)
    order = np.argsort(tail, kind="stable")
    passed = np.flatnonzero(tail[order] <= np.log(FALSE_DISCOVERIES * np.arange(1, len(p) + 1) / max(len(p), 1)))
    best = order[: passed[-1] + 1] if len(passed) else order[:0]
    odds = np.log((p + 0.5) / (n_p + 1)) - np.log((p + others + 0.5) / (n_p + n_others + 1))
    best = best[odds[best] >= np.log(LIFT)][:most]
    return best, odds[best]


def _hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit(10))


def _sample(ids: DataFrame, rows: int, bound: int) -> DataFrame:
    """At most `bound` of the distinct ids, by a hash; rows: how many there are, so that few are ever sorted."""
    if rows > 2 * bound:
        ids = ids.where(_hash() < -(2**63) + int(2**64 * 1.5 * bound / rows))
    return ids.distinct().orderBy(_hash(), "doc_id").limit(bound)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, risk_error: float = RISK_ERROR, max_features: int = MAX_FEATURES, prior: float | None = None) -> Model:
    """Learns from rows outside the held-out fold. prior: share of toxic texts; by default that of the labelled rows."""
    bounded_batches(docs.sparkSession)
    learnt = F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT)
    labels = labels.select("doc_id", "toxic").where(learnt & F.col("toxic").isNotNull())
    share, confirmed = labels.agg(F.avg((F.col("toxic") == 1).cast("double")), F.count_if(F.col("toxic") == 1)).first()
    if not confirmed:
        return Model()
    prior = float(np.clip(share if prior is None else prior, 0.01, 0.9))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(learnt)
    positive = _sample(labels.where("toxic = 1").select("doc_id"), confirmed, max_positive)

    def frequencies(wanted):
        def run(batches):
            counts, rows = np.zeros(BUCKETS, dtype=np.int64), 0
            for batch in batches_of(batches, "text"):
                counts += np.bincount(present(batch.column(0), wanted())[1], minlength=BUCKETS)
                rows += batch.num_rows
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], rows))], names=["bucket", "n"])

        return run

    def counted(rows: DataFrame, wanted) -> DataFrame:
        """bucket, n; bucket -1 counts the rows."""
        return rows.select("text").mapInArrow(frequencies(wanted), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    found = counted(texts.join(F.broadcast(positive), "doc_id", "left_semi"), lambda: np.ones(BUCKETS, dtype=bool)).where("n >= 2 or bucket = -1").toPandas().sort_values("bucket")  # at most BUCKETS rows; max_positive ids
    n_p = int(found.n[found.bucket == -1].sum())
    found = found[found.bucket >= 0]
    candidates, p = found.bucket.to_numpy(), found.n.to_numpy()
    if not len(candidates):
        return Model()

    marked = np.zeros(BUCKETS, dtype=bool)
    marked[candidates] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))
    every = counted(texts, lambda: np.unpackbits(shared.value).astype(bool)).toPandas()  # at most BUCKETS rows
    n = int(every.n[every.bucket == -1].sum())
    counts = np.zeros(BUCKETS, dtype=np.int64)
    every = every[every.bucket >= 0]
    counts[every.bucket] = every.n
    best, start = telling(p, n_p, counts[candidates] - p, n - n_p, max_features)
    if not len(best):
        return Model()
    chosen = candidates[best]
    order = docs.sparkSession.sparkContext.broadcast(chosen)

    unlabelled = _sample(texts.select("doc_id"), n, int(np.ceil(0.25 / risk_error**2)))
    ids = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    sample = texts.join(F.broadcast(ids), "doc_id").select("positive", "text")  # ids bounded by both samples

    def features(batches):
        index = np.full(BUCKETS, -1, dtype=np.int32)
        index[order.value] = np.arange(len(order.value))
        for batch in batches_of(batches, "text"):
            row, bucket = present(batch.column(1), index >= 0)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(index[bucket]))], names=["positive", "features"])

    held = sample.mapInArrow(features, "positive boolean, features array<int>").toPandas()  # rows bounded by both samples, features by max_features

    def sparse(x):
        n = [len(f) for f in x]
        return np.repeat(np.arange(len(n)), n), (np.concatenate([*x, []]).astype(np.int64) if len(x) else np.zeros(0, dtype=np.int64)), len(n)

    w, bias = train(*sparse(held.features[held.positive].tolist()), *sparse(held.features[~held.positive].tolist()), start, prior)
    model = Model(bias=bias)
    model.weights[chosen] = w
    return model


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """The score of each text."""
    if not np.isfinite(model.bias):
        return np.zeros(len(column))
    used = model.weights != 0
    z = np.zeros(len(column))
    for a, b in spans_of(column):
        row, bucket = present(column.slice(a, b - a), used)
        z[a:b] = np.bincount(row, weights=model.weights[bucket].astype(np.float64), minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(z + model.bias, -60, 60)))


def score_of(docs: DataFrame, model: Model) -> Column:
    """The score of docs' texts as a column: a text goes to Python once, and only its score comes back."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(scores(text, shared.value))

    return score(F.coalesce(docs["text"].cast("string"), F.lit("")))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    out = docs.select("doc_id", score_of(docs, fit(docs, labels)).alias("score"))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    return docs.where(score_of(docs, fit(docs, labels)) < THRESHOLD)
