"""Operator 2, LM scoring: deleted interpolation.

The model mixes three estimates of a token w after a context h (the token before it):

    p(w | h) = a0 / (V + 1) + a1 * c(w) / N + a2 * c(h, w) / c(h)

with mixture weights a of their own for each bucket of contexts, by the power of two of
c(h). The weights are learnt by expectation-maximisation on a part deleted from the
training texts (one fold of seven): its tokens' probabilities under counts of the rest,
binned to quarters of a power of two. Counts then cover all training texts again.

Texts stay where they are read until the end. A task gathers chunks of some megabytes of
texts, and for each asks for the counts of its distinct words and pairs: sorted
fingerprints, cut by value into shards, of which there are as many as the bytes of all
texts ask for (SHARD_BYTES of keys each). A shard adds the counts of all chunks and answers
every chunk in the order asked. A chunk's texts then meet its answers, which fit its sorted
fingerprints one to one. So what is shuffled is fingerprints already summed by chunk, a
frequent pair is no hot key, and no model is ever whole in one place.

Chunks are dealt by the order in which a task reads its rows, so docs must be read the same
way twice, as tables are; checkpoint anything else first. Answers carry a hash of the keys
they are for, so that a chunk read otherwise is an error. Fingerprints are 63 bits wide.

Defined results: a null or empty text is its end alone; a null doc_id is trained on, in no
fold; repeated rows count and score each; contexts never trained on use words alone;
without training texts every estimate is the uniform one; ties cannot arise; a very long
text is a chunk of its own, taken whole; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import bounded_batches
from provlake.llm._text import Tokens, batches_of, joined, mix
from provlake.plans.session import checkpointed

FOLDS, HELD_OUT, DELETED = 7, 2, 3
CHUNK_BYTES = 8 << 20
#: keys of one shard, about, and bytes of keys that a byte of text brings
SHARD_BYTES = 16 << 20
KEY_BYTES = 2.5
CONTEXT_BUCKETS = 26
STEP = 4.0
ROUNDS = 100
END = np.uint64(0x5EED5EED5EED5EE0)
BEGIN = np.uint64(0xB061B061B061B061)
#: odd keys are pairs and the beginning, even ones words
EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)


def dealt(batches, limit: int):
    """(chunk, [batches of fold, id, text]) by order of reading; texts of the deleted fold have chunks of their own, with odd numbers."""
    task, made = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {0: [], 1: []}
    size = {0: 0, 1: 0}
    for batch in batches_of(batches, "text"):
        deleted = batch.column(0).to_numpy() == DELETED
        for kind in (0, 1):
            part = batch.filter(pa.array(deleted == bool(kind)))
            if part.num_rows:
                held[kind].append(part)
                size[kind] += part.get_total_buffer_size()
                if size[kind] >= limit:
                    yield (task << 28) + (made << 1) + kind, held[kind]
                    made, held[kind], size[kind] = made + 1, [], 0
    for kind in (0, 1):
        if held[kind]:
            yield (task << 28) + (made << 1) + kind, held[kind]
            made += 1


def tokens_of(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, token before it) of texts, an end after each and a beginning before."""
    rows, now, before, at = [], [], [], 0
    for column in parts:
        t = Tokens(column)
        token = np.insert(t.h & EVEN, t.first[1:], END)
        last = np.concatenate(([BEGIN], token[:-1])).astype(np.uint64)
        last[(t.first + np.arange(t.docs + 1))[:-1]] = BEGIN
        rows.append(np.repeat(np.arange(t.docs), t.n + 1) + at)
        now.append(token)
        before.append(last)
        at += t.docs
    return np.concatenate(rows), np.concatenate(now), np.concatenate(before)


def asked(now: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sorted keys, index of each token, index of each pair, index of the beginning)."""
    pair = joined([before, now]) | np.uint64(1)
    keys, place = np.unique(np.concatenate((now, pair, [BEGIN])), return_inverse=True)
    return keys, place[: len(now)], place[len(now) : -1], int(place[-1])


def proof(keys: np.ndarray) -> int:
    """A hash of keys."""
    return int(np.bitwise_xor.reduce(mix(keys)).view(np.int64))


def shards_for(rows: DataFrame) -> int:
    """A power of two, by the bytes of all texts."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return 1 << max(4, int(KEY_BYTES * size / SHARD_BYTES).bit_length())


def packed(values: np.ndarray) -> bytes:
    """Counts in a byte each, and large ones after them."""
    large = values[values >= 255].astype("<u8").tobytes()
    return zlib.compress(np.minimum(values, 255).astype(np.uint8).tobytes() + large, 1)


def unpacked(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    values = np.frombuffer(data[:n], dtype=np.uint8).astype(np.int64)
    values[values == 255] = np.frombuffer(data[n:], dtype="<u8").astype(np.int64)
    return values


def source(docs: DataFrame) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("int")
    return docs.select(fold.alias("fold"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def questions(rows: DataFrame, shards: int) -> DataFrame:
    """chunk, shard, keys, counts: what a chunk adds to the counts of its keys, and so also what it asks for."""
    shift = np.uint64(64 - (shards.bit_length() - 1)) if shards > 1 else None

    def run(batches):
        for chunk, parts in dealt(batches, CHUNK_BYTES):
            row, now, before = tokens_of([p.column(2) for p in parts])
            keys, word, pair, begin = asked(now, before)
            learnt = np.concatenate([p.column(0).to_numpy() for p in parts]) != HELD_OUT
            train = learnt[row].astype(np.float64)
            counts = np.bincount(word, weights=train, minlength=len(keys)) + np.bincount(pair, weights=train, minlength=len(keys))
            counts[begin] += learnt.sum()
            counts = counts.astype(np.int64)
            ends = np.searchsorted(keys >> shift, np.arange(shards + 1, dtype=np.uint64)) if shift is not None else np.array([0, len(keys)])
            used = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), chunk)), pa.array(used.astype(np.int64)), pa.array([keys[ends[k] : ends[k + 1]].tobytes() for k in used], type=pa.binary()), pa.array([packed(counts[ends[k] : ends[k + 1]]) for k in used], type=pa.binary())],
                names=["chunk", "shard", "keys", "counts"],
            )

    return rows.mapInArrow(run, "chunk long, shard long, keys binary, counts binary")


def answers(asking: DataFrame, shards: int) -> DataFrame:
    """chunk, shard, n (keys asked), proof (their hash), every and rest (counts of all training texts, and without the deleted fold), and once a shard its sums: tokens and types of both."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        keys = [np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()]
        size = np.array([len(x) for x in keys])
        counts = np.concatenate([unpacked(x, n) for x, n in zip(table.column("counts").to_pylist(), size, strict=True)])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
        kept = np.repeat(chunk & 1 == 0, size)
        rest = np.bincount(place[kept], weights=counts[kept], minlength=len(distinct)).astype(np.int64)
        word = distinct & np.uint64(1) == 0
        sums = [every[word].sum(), (every[word] > 0).sum(), rest[word].sum(), (rest[word] > 0).sum()]
        ends = np.concatenate(([0], np.cumsum(size)))
        once = np.zeros(len(size), dtype=np.int64)
        once[0] = 1
        out = {"chunk": chunk, "shard": table.column("shard").to_numpy(), "n": size.astype(np.int64), "proof": np.array([proof(x) for x in keys], dtype=np.int64)}
        for name, values in (("every", every), ("rest", rest)):
            out[name] = pa.array([packed(values[place[ends[i] : ends[i + 1]]]) for i in range(len(size))], type=pa.binary())
        out |= {name: once * int(x) for name, x in zip(("tokens", "types", "rest_tokens", "rest_types"), sums, strict=True)}
        return pa.table(out)

    return asking.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "chunk long, shard long, n long, proof long, every binary, rest binary, tokens long, types long, rest_tokens long, rest_types long")


def boxed(batch: pa.RecordBatch) -> bytes:
    """A batch of texts, compressed as a whole."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def unboxed(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def chunks(rows: DataFrame, deleted_only: bool = False) -> DataFrame:
    """chunk, box: rows, boxed, with the chunk that asked for them."""

    def run(batches):
        for chunk, parts in dealt(batches, CHUNK_BYTES):
            if chunk & 1 or not deleted_only:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), chunk)), pa.array([boxed(p) for p in parts], type=pa.binary())], names=["chunk", "box"])

    return rows.mapInArrow(run, "chunk long, box binary")


def counted(parts: list[pa.RecordBatch], right: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, count of the token, of its context, of the pair) for the tokens of a chunk."""
    row, now, before = tokens_of([p.column(2) for p in parts])
    keys, word, pair, begin = asked(now, before)
    right = right.sort_by("shard")
    values = np.concatenate([unpacked(x, n) for x, n in zip(right.column(name).to_pylist(), right.column("n").to_pylist(), strict=True)])
    ends = np.cumsum(right.column("n").to_numpy())
    if len(values) != len(keys) or [proof(keys[b - n : b]) for b, n in zip(ends, right.column("n").to_pylist(), strict=True)] != right.column("proof").to_pylist():
        raise ValueError("a chunk's texts were read in another order than before: checkpoint the input")
    context = np.full(len(row), begin)
    inner = np.flatnonzero(before != BEGIN)
    context[inner] = word[inner - 1]
    return row, values[word], values[context], values[pair]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the power of two in its count."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, CONTEXT_BUCKETS - 1), 0)


def learn(histogram: np.ndarray, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (buckets x 3). histogram: rows of bucket, bins of both estimates (NaN: zero) and number."""
    weights = np.tile([1.0, 0.0, 0.0], (CONTEXT_BUCKETS, 1))
    last = None
    for b in range(CONTEXT_BUCKETS):
        x = histogram[histogram[:, 0] == b]
        if not len(x):
            if b > 1 and last is not None:
                weights[b] = last
            continue
        p = np.stack([np.full(len(x), 1 / (types + 1)), np.nan_to_num(2 ** (x[:, 1] / STEP)), np.nan_to_num(2 ** (x[:, 2] / STEP))])
        a = np.array([1 / 2, 1 / 2, 0.0]) if b == 0 else np.full(3, 1 / 3)
        for _ in range(rounds):
            share = a[:, None] * p
            a = (share / share.sum(axis=0) * x[:, 3]).sum(axis=1) / x[:, 3].sum()
        weights[b] = np.maximum(a, [1e-6, 0, 0]) / np.maximum(a, [1e-6, 0, 0]).sum()
        last = weights[b] if b else None
    if last is None and histogram.size == 0:
        weights[:] = [1.0, 0.0, 0.0]
    return weights


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    bounded_batches(docs.sparkSession)
    rows = source(docs)
    shards = shards_for(rows)
    replies = checkpointed(answers(questions(rows, shards), shards))
    tokens, types, rest_tokens, rest_types = (int(x or 0) for x in replies.agg(*[F.sum(c) for c in ("tokens", "types", "rest_tokens", "rest_types")]).first())
    replies = replies.select("chunk", "shard", "n", "proof", "every", "rest")

    def bins(left, right):
        if not left.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "word": pa.array([], pa.float64()), "pair": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        _, word, context, pair = counted([unboxed(x) for x in left.column("box")], right, "rest")
        with np.errstate(divide="ignore", invalid="ignore"):
            one = np.round(STEP * np.log2(word / max(rest_tokens, 1)))
            two = np.round(STEP * np.log2(pair / np.maximum(context, 1)))
        x = np.stack([bucket_of(context), np.where(word > 0, one, -9999), np.where(pair > 0, two, -9999)], axis=1)
        x, n = np.unique(x, axis=0, return_counts=True)
        return pa.table({"bucket": x[:, 0].astype(np.int64), "word": x[:, 1], "pair": x[:, 2], "n": n.astype(np.int64)})

    deleted = chunks(rows, True).groupBy("chunk").cogroup(replies.where("chunk % 2 = 1").groupBy("chunk")).applyInArrow(bins, "bucket long, word double, pair double, n long")
    histogram = deleted.groupBy("bucket", "word", "pair").agg(F.sum("n").alias("n")).toPandas().to_numpy(dtype=float)  # bounded by the bins
    histogram[histogram == -9999] = np.nan
    weights = learn(histogram, rest_types)

    def score(left, right):
        parts = [unboxed(x) for x in left.column("box")]
        row, word, context, pair = counted(parts, right, "every")
        a, n = weights[bucket_of(context)], sum(p.num_rows for p in parts)
        p = a[:, 0] / (types + 1) + a[:, 1] * word / max(tokens, 1) + a[:, 2] * pair / np.maximum(context, 1)
        base = np.log10((word + 1) / (tokens + types + 1))
        total = lambda x: np.bincount(row, weights=x, minlength=n)
        return pa.table(
            {
                "doc_id": pa.chunked_array([x.column(1) for x in parts], type=pa.int64()),
                "held_out": np.concatenate([x.column(0).to_numpy() for x in parts]) == HELD_OUT,
                "n_tokens": np.bincount(row, minlength=n).astype(np.int64),
                "n_known": total(word > 0).astype(np.int64),
                "train_tokens": np.full(n, tokens, dtype=np.int64),
                "base_score": total(base),
                "score": total(np.log10(p)),
            }
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks(rows).groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, out)
