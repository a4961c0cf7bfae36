"""Operator 11, conversation prefix trie: range minima over sorted longest common prefixes.

A conversation becomes the sequence of its turns' digests. Sequences are sorted over the
cluster and cut into blocks of bounded size. Within a block, a sparse table answers the
least common prefix of any range of neighbours: a prefix first seen at some row reaches as
far left and right as that least stays at its depth, found by two independent binary
searches, so that members, smallest members, leaves and savings are differences of
running sums over an interval. Only prefixes of a block's first and last row can reach
into other blocks; their parts are summed over blocks.

Defined results: turns are ordered by turn (null first), then role, then digest of the
text; a null role or text is an empty one; repeated rows are turns of their own; rows
without a conv_id belong to no conversation and are left out; an empty table gives no
rows, not even the root; other columns are ignored. A conversation is one row of about
24 bytes a turn, whatever the length of its texts. Equal turns are told by the first 128
bits of SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import bounded_batches, maybe_broadcast
from provlake.plans.session import shared_folder

#: a block ends with the row that reaches either
BLOCK_ROWS, BLOCK_TURNS = 1 << 14, 1 << 16
#: bytes of a turn's digest
WIDTH = 16
#: rows of the edges between blocks, or of the prefixes open at them, up to which they are broadcast
MAX_BROADCAST = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
BLOCK = "part int, sub int, conv binary, turns binary, key binary, sizes binary, first binary, last binary"
NUMBERS = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
NODE = f"block long, node binary, parent binary, {', '.join(f'{x} long' for x in NUMBERS)}, ends_sha256 string, ends string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as digest and number of code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    each = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).alias("size")).alias("t")
    )
    ordered = F.sort_array(F.collect_list("t"))
    return each.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


class RangeMinimum:
    """A sparse table: the minimum of any range, and how far a bound from below holds."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while 2 * step <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))
            step *= 2

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum over low..high, both included."""
        level = np.floor(np.log2(high - low + 1)).astype(np.int64)
        out = np.empty(len(low), dtype=self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k)) + 1])
        return out

    def right(self, row: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last row up to which all values after `row` are at least `bound`."""
        row, n = row.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            inside = np.flatnonzero(row + step < n)
            row[inside[self.levels[k][row[inside] + 1] >= bound[inside]]] += step
        return row

    def left(self, row: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first row after which all values up to `row` are at least `bound`."""
        row = row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            inside = np.flatnonzero(row >= step)
            row[inside[self.levels[k][row[inside] - step + 1] >= bound[inside]]] -= step
        return row


def common(a: bytes, b: bytes) -> int:
    """The number of equal turns at the start of both."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(v, dtype=np.uint64, count=2 * n).reshape(-1, 2) for v in (a, b))
    apart = np.flatnonzero((x != y).any(axis=1))
    return int(apart[0]) if len(apart) else n


def _prefix_ids(key: bytes) -> list[bytes]:
    """An id of each prefix of one sequence, the empty one first."""
    h, out = hashlib.blake2b(digest_size=WIDTH), []
    out.append(h.digest())
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.copy().digest())
    return out


def block_nodes(conv: np.ndarray, turns: np.ndarray, key: bytes, sizes: np.ndarray, before: int, after: int) -> dict:
    """The nodes of a block of sorted sequences, as columns.

    before, after: turns its first row shares with the row before the block, and its last
    row with the row after; -1 where there is none. A node that reaches into another block
    is open: it gets an id, and its numbers are those of its part in this block.
    """
    m = len(turns)
    at = np.concatenate(([0], np.cumsum(turns)))
    digests = np.frombuffer(key, dtype=np.uint64).reshape(-1, 2)
    shared = np.minimum(turns[1:], turns[:-1])
    row = np.repeat(np.arange(1, m), shared)
    k = np.arange(len(row)) - np.repeat(np.cumsum(shared) - shared, shared)
    apart = np.flatnonzero((digests[at[row] + k] != digests[at[row - 1] + k]).any(axis=1))
    lcp = np.concatenate(([0], shared)).astype(np.int64)
    rows, first = np.unique(row[apart], return_index=True)
    lcp[rows] = k[apart[first]]

    # candidates: the root, then each prefix at the row where it is first seen
    new = turns - lcp
    offset = np.cumsum(new) - new  # of a row's candidates, the root not counted
    i = np.concatenate(([0], np.repeat(np.arange(m), new)))
    d = np.concatenate(([0], np.arange(int(new.sum())) - np.repeat(offset - lcp, new) + 1))
    table, ids = RangeMinimum(lcp), RangeMinimum(conv)
    low, high = table.left(i, d), table.right(i, d)
    up = np.maximum(d - 1, 0)
    above_low, above_high = table.left(i, up), table.right(i, up)
    parent = np.where(up > 0, 1 + offset[above_low] + up - lcp[above_low] - 1, 0)
    continued = (i == 0) & (d <= before)
    is_open = continued | ((high == m - 1) & (d <= after))

    chars = np.concatenate(([0], np.cumsum(sizes)))
    upto = lambda r, depth: chars[at[r] + depth] - chars[at[r]]  # noqa: E731  code points of a row's first turns
    same = lcp.copy()
    same[0] = max(before, 0)
    known = np.concatenate(([0], np.cumsum(upto(np.arange(m), same))))
    saved = known[high + 1] - known[low + 1 - continued] - (high - low + continued) * upto(i, up)
    leaf = np.concatenate(([0], np.cumsum(np.append(lcp[1:], after) < turns)))
    children = np.bincount(parent[1:][~continued[1:]], minlength=len(i))

    # runs of equal sequences: the members that end at a node
    starts = np.flatnonzero(np.concatenate(([True], (lcp[1:] != turns[1:]) | (turns[1:] != turns[:-1]))))
    ends, digest = [None] * len(i), [NO_ENDS] * len(i)
    for a, b in zip(starts.tolist(), np.append(starts[1:], m).tolist(), strict=True):
        node = int(1 + offset[a] + turns[a] - lcp[a] - 1) if turns[a] else 0
        listed = ",".join(map(str, conv[a:b].tolist()))
        if is_open[node]:
            ends[node] = listed
        else:
            digest[node] = hashlib.sha256(listed.encode()).hexdigest()

    node = [None] * len(i)
    start_ids, end_ids = _prefix_ids(key[: at[1] * WIDTH]), _prefix_ids(key[at[m - 1] * WIDTH :])
    for x in np.flatnonzero(is_open).tolist():
        node[x] = (start_ids if continued[x] else end_ids)[d[x]]
    above = [None, *(node[x] for x in parent[1:].tolist())]
    smallest, above_smallest = ids.least(low, high), ids.least(above_low, above_high).tolist()
    return {
        "node": node, "parent": above, "depth": d, "conv_id": smallest, "parent_conv_id": [None if x == 0 or above[x] is not None else v for x, v in enumerate(above_smallest)],
        "n_convs": high - low + 1, "n_children": children, "n_leaves": leaf[high + 1] - leaf[low], "saved_tokens": saved, "ends_sha256": digest, "ends": ends,
    }


def _packed(batches, most_rows: int, most_turns: int):
    """Sorted rows to blocks, a row each."""
    part, sub = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    turns = 0

    def block():
        nonlocal sub, turns
        conv, n, key, sizes = (np.concatenate([x[k] for x in held]) for k in (0, 1, 2, 3))
        width = n * WIDTH
        out = [[part], [sub], [conv.astype("<i8").tobytes()], [n.astype("<i8").tobytes()], [key.tobytes()], [sizes.astype("<i8").tobytes()], [key[: width[0]].tobytes()], [key[len(key) - width[-1] :].tobytes()]]
        sub, turns = sub + 1, 0
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, type=pa.int32() if k < 2 else pa.binary()) for k, v in enumerate(out)], names=[x.split()[0] for x in BLOCK.split(", ")])

    rows = 0
    for batch in batches:
        conv = np.asarray(batch.column(0))
        keys, sizes = batch.column(1), batch.column(2)
        n = np.asarray(sizes.value_lengths(), dtype=np.int64)
        flat = np.asarray(sizes.flatten(), dtype=np.int64)
        raw = np.frombuffer(b"".join(keys.to_pylist()), dtype=np.uint8)
        ends, at = np.cumsum(n), 0
        while at < len(n):
            begin = ends[at] - n[at]
            stop = min(at + most_rows - rows, int(np.searchsorted(ends, begin + most_turns - turns, side="left")) + 1, len(n))
            held.append((conv[at:stop], n[at:stop], raw[begin * WIDTH : ends[stop - 1] * WIDTH], flat[begin : ends[stop - 1]]))
            rows, turns, at = rows + stop - at, turns + int(ends[stop - 1] - begin), stop
            if rows >= most_rows or turns >= most_turns:
                yield block()
                rows = 0
    if held:
        yield block()


def _edges(batches):
    for batch in batches:
        numbers, first, last = (batch.column(k) for k in range(3))
        left = [-1 if b is None else common(a, b) for a, b in zip(first.to_pylist(), last.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([numbers, pa.array(left, type=pa.int64())], names=["block", "before"])


def _found(batches):
    for batch in batches:
        for r in batch.to_pylist():
            conv, turns, sizes = (np.frombuffer(r[c], dtype="<i8") for c in ("conv", "turns", "sizes"))
            found = block_nodes(conv, turns, r["key"], sizes, r["before"], r["after"])
            columns = {"block": np.full(len(found["depth"]), r["block"], dtype=np.int64)} | found
            kinds = dict.fromkeys(("node", "parent"), pa.binary()) | dict.fromkeys(("ends_sha256", "ends"), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(v, type=kinds.get(c, pa.int64())) for c, v in columns.items()], names=list(columns))
            for at in range(0, out.num_rows, 10_000):
                yield out.slice(at, 10_000)


def _hashed(batches):
    """(node, SHA-256 of its lists of ends on end): rows come sorted by node and block."""
    node, h = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([node], type=pa.binary()), pa.array([h.hexdigest()], type=pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != node:
                if h:
                    yield row()
                node, h = key, hashlib.sha256(ends.encode())
            else:
                h.update(("," + ends).encode())
    if h:
        yield row()


def _blocks(seqs: DataFrame, folder: str, most_rows: int, most_turns: int) -> DataFrame:
    """The sorted blocks with their number and what they share with their neighbours."""
    spark = seqs.sparkSession
    keyed = seqs.select("conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("key"), F.col("turns.size").alias("sizes"))
    keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lambda batches: _packed(batches, most_rows, most_turns), BLOCK).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    counts, total, offsets = blocks.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect(), 0, []  # a row for each partition of the sort
    for r in counts:
        offsets.append((r["part"], total))
        total += r["n"]
    blocks = blocks.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part").withColumn("block", F.col("offset") + F.col("sub"))
    ends = blocks.select("block", "first", "last")
    left = ends.select("block", "first").join(ends.select((F.col("block") + 1).alias("block"), "last"), "block", "left").select("block", "first", "last")
    left.mapInArrow(_edges, "block long, before long").write.parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")
    both = edges.join(edges.select((F.col("block") - 1).alias("block"), F.col("before").alias("after")), "block", "left").fillna(-1, ["after"])
    return blocks.join(maybe_broadcast(both, MAX_BROADCAST), "block").select("block", "conv", "turns", "key", "sizes", "before", "after")


def nodes(seqs: DataFrame, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row for each distinct prefix of the given sequences (see sequences), the empty one included."""
    spark = seqs.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark, "trie")
    _blocks(seqs, folder, block_rows, block_turns).mapInArrow(_found, NODE).write.parquet(f"{folder}/nodes")
    found = spark.read.parquet(f"{folder}/nodes")
    closed, parts = found.where("node is null"), found.where("node is not null")

    # open nodes: parts of several blocks are summed; lists of ends run through one digest in the order of blocks
    sums = parts.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in NUMBERS[3:]))
    hashed = parts.where("ends is not null").select("node", "block", "ends").repartition("node").sortWithinPartitions("node", "block").select("node", "ends").mapInArrow(_hashed, "node binary, ends_sha256 string")
    sums.join(hashed, "node", "left").fillna(NO_ENDS, ["ends_sha256"]).write.parquet(f"{folder}/open")
    reaching = spark.read.parquet(f"{folder}/open")
    smallest = reaching.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    few = maybe_broadcast(smallest, MAX_BROADCAST)
    upper = reaching.join(few, "parent", "left")
    near = parts.select("block", F.col("node").alias("parent")).join(few, "parent")  # a block's open prefixes: no key is hot
    under = closed.where("parent is not null").drop("parent_conv_id").join(near, ["block", "parent"])
    return closed.where("parent is null").select(OUT).unionByName(under.select(OUT)).unionByName(upper.select(OUT))
