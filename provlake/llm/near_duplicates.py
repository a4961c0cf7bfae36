"""Operator 7, MinHash near-dedup with tensored banding.

A document's set is its distinct 5-word shingles. Texts with one set are one node. Each
node has n small collections of HASHES minhashes; a table's key is a pair of collections,
so that n * HASHES hashes serve n * (n - 1) / 2 tables. Two nodes meet in a table when two
of their collections agree; n is the least number for which a pair exactly at the
threshold fails to do so with a probability of at most MISS (for 0.85: 16 collections,
48 hashes, 120 tables; as many tables with hashes of their own would need 720).

Nodes meet by single collections first, and in a group of up to BLOCK nodes the second half
of the key is compared inside the group: its tables' keys are never written. Where a
collection's group is larger (a template's pages share one), its nodes are dealt by whole
keys, the pairs of collections of which both have large groups. What meets in a table and
is not far too unlike by its minhashes (SLACK standard deviations) forms clusters; within
clusters exact sets, made again from the texts of these few nodes, confirm links;
components of the links are the result. Groups are compared in blocks of bounded rows and
shingles (components.py), so that large groups of near copies do not meet in one task, and
rows with a set of many copies get their result by a broadcast.

Defined results: a null, empty or blank text has no shingles, is linked with nothing and
is kept; a text of fewer than five words has one shingle, all its words; component_id is
the smallest id not null; a row with a null id is kept only if its component has no other
id; repeated rows share their result; ties cannot arise, since the smallest id stands for
a component; very long texts are taken whole; an empty table gives no rows; other columns,
whatever their names, are ignored (unique_documents keeps them). Set hashes are 64 bits wide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlake.llm._spark import bounded_batches, maybe_broadcast, small, unused
from provlake.llm._text import Tokens, batches_of, distinct_by_row, joined, mix
from provlake.llm.components import BLOCK, components, connect, dealt
from provlake.plans.session import checkpointed

WORDS = 5
HASHES = 3
MISS = 1e-5
SLACK = 5.0
BROADCAST_IDS = 1_000_000
HOT_COPIES = 64


def collections_for(percent: int, miss: float = MISS) -> int:
    """How many collections two sets at the threshold need to agree in two, but for `miss`."""
    p, n = (percent / 100) ** HASHES, 2
    while (1 - p) ** n + n * p * (1 - p) ** (n - 1) > miss:
        n += 1
    return n


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, shingle) of a batch of texts, sorted."""
    t = Tokens(column)
    rows, hashes = [], []
    row, h = t.grams(WORDS)
    rows.append(row)
    hashes.append(h)
    for m in range(1, WORDS):
        short = np.flatnonzero(t.n == m)
        rows.append(short)
        hashes.append(joined([t.h[t.first[short] + i] for i in range(m)]))
    return distinct_by_row(np.concatenate(rows), np.concatenate(hashes))


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def minhashes(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n minhashes (columns) of each run of h that begins at starts."""
    out = np.empty((len(starts), n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, a in enumerate(multipliers(n)):
            out[:, k] = np.minimum.reduceat(h * a, starts)
    return out


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("text_key"), text.alias("text"))


def set_hash(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a set, start of each, size of each row's set, hash of each set)."""
    size = np.bincount(row, minlength=n)
    have = np.flatnonzero(size)
    starts = np.concatenate(([0], np.cumsum(size[have])))[:-1].astype(np.int64)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts) if len(have) else np.zeros(0, dtype=np.uint64)
        return have, starts, size, mix(sums + size[have].astype(np.uint64))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (null without shingles), halves (a hash of each collection) and bytes (one of each minhash)."""

    def run(batches):
        for batch in batches_of(batches, "text"):
            m = batch.num_rows
            row, h = shingle_sets(batch.column(2))
            have, starts, size, node = set_hash(row, h, m)
            mins = minhashes(h, starts, n * HASHES) if len(have) else np.zeros((0, n * HASHES), dtype=np.uint64)
            halves = np.stack([joined([np.full(len(have), k, dtype=np.uint64), *[mins[:, k * HASHES + i] for i in range(HASHES)]]) for k in range(n)], axis=1)
            small_bytes = (mins & np.uint64(0xFF)).astype(np.uint8)
            none = np.ones(m, dtype=bool)
            none[have] = False
            at = np.zeros(m, dtype=np.int64)
            at[have] = np.arange(len(have))
            list_ends = np.concatenate(([0], np.cumsum(np.where(none, 0, n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(size.astype(np.int64)),
                    pa.array(node.view(np.int64)[at] if len(have) else np.zeros(m, dtype=np.int64), mask=none),
                    pa.ListArray.from_arrays(pa.array(list_ends), pa.array(halves.view(np.int64).ravel())),
                    pa.array([None if x else small_bytes[i].tobytes() for x, i in zip(none, at, strict=True)], type=pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "node", "halves", "bytes"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long, halves array<long>, bytes binary")


@dataclass
class SameTable:
    """The test for candidates: in one table, sizes within bounds, and minhashes not far too unlike."""

    percent: int
    collections: int

    @property
    def least(self) -> float:
        """The fewest minhashes in which candidates agree."""
        t, n = self.percent / 100, self.collections * HASHES
        return n * t - SLACK * float(np.sqrt(n * t * (1 - t)))

    @staticmethod
    def columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = rows.column("halves").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        signs = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
        return halves, signs, rows.column("n_shingles").to_numpy()

    def close(self, halves, signs, size, halves2, signs2, size2) -> np.ndarray:
        ok = (100 * np.minimum(size, size2) >= self.percent * np.maximum(size, size2)) & ((signs == signs2).sum(axis=1) >= self.least)
        return ok & ((halves == halves2).sum(axis=1) >= 2)

    def every(self, rows: pa.Table) -> np.ndarray:
        halves, signs, size = self.columns(rows)
        out = np.stack([self.close(halves, signs, size, halves[i], signs[i], size[i]) for i in range(len(size))])
        np.fill_diagonal(out, False)
        return out

    def paired(self, left: pa.Table, right: pa.Table) -> np.ndarray:
        return self.close(*self.columns(left), *self.columns(right))


@dataclass
class SameSets:
    """The exact test on whole sets."""

    percent: int

    @staticmethod
    def columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size of each set, row and shingle of each member)."""
        column = rows.column("shingles").combine_chunks()
        size = column.value_lengths().to_numpy().astype(np.int64)
        return size, np.repeat(np.arange(len(size)), size), column.flatten().to_numpy()

    def close(self, shared: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (100 * shared >= self.percent * (size + other - shared)) & (shared > 0)

    def every(self, rows: pa.Table) -> np.ndarray:
        size, row, h = self.columns(rows)
        m = len(size)
        _, at, seen = np.unique(h, return_inverse=True, return_counts=True)
        shared = np.cumsum(seen > 1) - 1
        keep = seen[at] > 1
        row, col = row[keep], shared[at[keep]]
        both = np.zeros((m, m), dtype=np.float32)
        step = max(256, 4_000_000 // m)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for low in range(0, int(col[-1]) + 1 if len(col) else 0, step):
            a, b = np.searchsorted(col, [low, low + step])
            x = np.zeros((m, step), dtype=np.float32)
            x[row[a:b], col[a:b] - low] = 1
            both += x @ x.T
        out = self.close(both.astype(np.int64), size[:, None], size[None, :])
        np.fill_diagonal(out, False)
        return out

    def paired(self, left: pa.Table, right: pa.Table) -> np.ndarray:
        size, row, h = self.columns(left)
        other, row2, h2 = self.columns(right)
        row, h = np.concatenate((row, row2)), np.concatenate((h, h2))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        twice = (row[1:] == row[:-1]) & (h[1:] == h[:-1])  # a set has each shingle once
        return self.close(np.bincount(row[1:][twice], minlength=len(size)), size, other)


def shingles_again(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of each of the nodes(node, first_id), from the text of one of its documents."""
    wanted = nodes.select(F.col("first_id").alias("__first")).distinct()
    wanted = F.broadcast(wanted) if small(wanted, BROADCAST_IDS) else wanted
    texts = texts_of(docs)
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi").select("text")

    def run(batches):
        for batch in batches_of(batches, "text"):
            row, h = shingle_sets(batch.column(0))
            have, starts, size, node = set_hash(row, h, batch.num_rows)
            ends = np.concatenate((starts, [len(h)])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def meetings(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """grp, node: the groups in which nodes meet, by one collection, or by a table's key where that group is larger than block."""
    halves = nodes.select("node", F.explode("halves").alias("grp"))
    sizes = checkpointed(halves.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"))
    large = sizes.where(F.col("n") > block).select("grp")
    none = large.isEmpty()
    large = maybe_broadcast(large, BROADCAST_IDS)
    rest = halves if none else halves.join(large, "grp", "left_anti")
    out = rest.join(sizes.where(F.col("n") <= block), "grp", "left_semi").select("grp", "node")
    if none:
        return out
    # both halves of a key are in large groups: otherwise its nodes meet in the smaller one
    held = halves.join(large, "grp", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("grp")).alias("g"))
    keys = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: F.xxhash64(x, y))))
    tables = checkpointed(held.select("node", F.explode(keys).alias("grp")))
    met = tables.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    return out.unionByName(tables.join(met, "grp", "left_semi").select("grp", "node"))


def with_component(rows: DataFrame, per_node: DataFrame) -> DataFrame:
    """rows with component_id(of their node). per_node(node, copies, component_id): nodes of many copies are broadcast, if they are few."""
    hot = per_node.where(F.col("copies") > HOT_COPIES).select("node", F.col("component_id").alias("hot_id"))
    rest = per_node.select("node", "component_id")
    if not small(hot, BROADCAST_IDS):
        return rows.join(rest, "node", "left")
    marked = rows.join(F.broadcast(hot), "node", "left")
    found = marked.where("hot_id is not null").withColumnRenamed("hot_id", "component_id")
    return marked.where("hot_id is null").drop("hot_id").join(rest, "node", "left").unionByName(found)


def linked(docs: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every row."""
    bounded_batches(docs.sparkSession)
    n = collections_for(percent)
    rows = checkpointed(sketches(docs, n))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("halves").alias("halves"), F.any_value("bytes").alias("bytes"))
    nodes = checkpointed(nodes)
    meeting = checkpointed(meetings(nodes, block).join(nodes.select("node", "copies", "n_shingles", "halves", "bytes"), "node"))
    clusters = checkpointed(components(connect(meeting, ["n_shingles", "halves", "bytes"], SameTable(percent, n), block=block)))
    members = clusters.join(nodes.select("node", "first_id", "copies", "n_shingles"), "node")
    sets = members.join(shingles_again(docs, members), "node").select(F.col("component").alias("grp"), "node", "copies", "n_shingles", "shingles")
    links = components(connect(checkpointed(sets), ["shingles"], SameSets(percent), "n_shingles", block))
    firsts = links.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("smallest"), F.count("*").alias("n"))
    named = dealt(links, firsts, "component", "smallest", links.count()).select("node", "smallest")
    per_node = checkpointed(nodes.select("node", "first_id", "copies").join(named, "node", "left").select("node", "copies", F.coalesce("smallest", "first_id").alias("component_id")))
    out = with_component(rows.select("doc_id", "text_key", "n_shingles", "node"), per_node)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def unique_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, all columns, one of each group; of rows with one id in one group, that with the smallest text hash, once."""
    judged = checkpointed(linked(docs, percent))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(text, F.length(text))
    ident, other, place = unused(docs, "id", "key", "place")
    gone = judged.where("not kept").select(F.col("doc_id").alias(ident), F.col("text_key").alias(other)).distinct()
    out = docs.join(maybe_broadcast(gone, BROADCAST_IDS), F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (key == F.col(other)), "left_anti")
    again = judged.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(ident))
    if again.isEmpty():
        return out
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(ident))
    once = Window.partitionBy(F.col("doc_id").cast("long")).orderBy(key)
    repeated = out.join(again, same, "left_semi").withColumn(place, F.row_number().over(once)).where(F.col(place) == 1).drop(place)
    return out.join(again, same, "left_anti").unionByName(repeated)
