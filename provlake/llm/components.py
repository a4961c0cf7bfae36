"""Connected components and bounded group comparison, shared by near-duplicate stages.

connect() compares the rows of each group with one another by a test over Arrow columns,
and returns edges that span what the test connects. A group of up to BLOCK rows and MOST
units of weight is one task's work. A larger group first meets its centre, the row with
most copies, which is broadcast if all centres are few and light, and otherwise joined in
a way that Spark can split; rows that fail against the centre are dealt with the whole
group in blocks, so that no task ever holds more than a block, and rows that passed are
never compared with each other.

Defined results: rows of no or of one-row groups have no edges; of equal numbers of copies
the largest node is the centre; without rows there are no edges and no components.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import maybe_broadcast
from provlake.plans.session import checkpointed

BLOCK = 1024
MOST = 4_000_000
BROADCAST_GROUPS = 10_000
HUB = 256
HUBS = 100_000
EDGES = "u long, v long"


class Test(Protocol):
    """Whether rows belong together, by their payload columns; symmetric."""

    def every(self, rows: pa.Table) -> np.ndarray:
        """A matrix: each row against each."""

    def paired(self, left: pa.Table, right: pa.Table) -> np.ndarray:
        """Each row of one table against the same row of the other."""


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what the matrix connects: no more than rows - 1."""
    m = len(linked)
    free = np.ones(m, dtype=bool)
    us, vs = [], []
    for root in range(m):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            new = np.flatnonzero(linked[u] & free)
            free[new] = False
            us.append(np.full(len(new), u))
            vs.append(new)
            queue.extend(new.tolist())
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))


def _edges_of(test: Test):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        if len(node) > 1:
            linked = test.every(table)
            passed = table.column("passed").to_numpy(zero_copy_only=False).astype(bool)
            linked &= ~(passed[:, None] & passed[None, :])
            u, v = spanning(linked)
        else:
            u = v = np.zeros(0, dtype=int)
        return pa.table({"u": node[u], "v": node[v]})

    return run


def _passes_centre(test: Test, payload: list[str], out: list[str]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                side = lambda before: pa.table({c: batch.column(batch.schema.get_field_index(before + c)) for c in payload})  # noqa: B023, E731
                ok = test.paired(side(""), side("centre_"))
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in out[:-1]], pa.array(ok)], names=out)

    return run


def connect(rows: DataFrame, payload: list[str], test: Test, weight: str | None = None, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """u, v. rows: grp (long), node (long, once in a group), copies (long), the payload columns that the test reads, and weight: what a row adds to a block besides itself."""
    w = F.lit(0) if weight is None else F.col(weight)
    rows = rows.select("grp", "node", "copies", *payload, w.cast("long").alias("weight"))
    counts = rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.max(F.struct("copies", "node"))["node"].alias("centre")).where("n > 1")
    counts = checkpointed(counts)
    columns = ["grp", "node", "weight", *payload]
    fits = (F.col("n") <= block) & (F.col("total") <= most)
    large = counts.where(~fits).select("grp", "centre")
    none = large.isEmpty()
    large = maybe_broadcast(large, BROADCAST_GROUPS)
    whole = rows if none else rows.join(large, "grp", "left_anti")
    whole = whole.join(counts.where(fits).select("grp"), "grp").select("grp", "node", *payload, F.lit(False).alias("passed"))
    edges = whole.groupBy("grp").applyInArrow(_edges_of(test), EDGES)
    if none:
        return edges
    members = rows.join(large, "grp").select(*columns, "centre")
    centres = checkpointed(members.where("node = centre").select("grp", F.col("weight").alias("centre_weight"), *[F.col(c).alias(f"centre_{c}") for c in payload]))
    n, total = centres.agg(F.count("*"), F.coalesce(F.sum("centre_weight"), F.lit(0))).first()
    centres = centres.drop("centre_weight")
    tested = members.join(F.broadcast(centres) if n <= BROADCAST_GROUPS and total <= most else centres, "grp")
    types = {f.name: f.dataType.simpleString() for f in tested.schema.fields}
    out = [*columns, "centre", "passed"]
    tested = tested.mapInArrow(_passes_centre(test, payload, out), ", ".join(f"`{c}` {'boolean' if c == 'passed' else types[c]}" for c in out))
    tested = checkpointed(tested.withColumn("passed", F.col("passed") | (F.col("node") == F.col("centre"))))
    star = tested.where("passed and node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v"))
    parts = lambda test: F.ceil(F.greatest(F.count_if(test) / (block // 2), F.sum(F.when(test, F.col("weight")).otherwise(0)) / (most / 2)))
    sizes = checkpointed(tested.groupBy("grp").agg(parts(~F.col("passed")).alias("n_rest"), F.greatest(parts(F.col("passed")), F.lit(1)).alias("n_passed"), F.count_if(~F.col("passed")).alias("rest")).where("rest > 0"))
    dealt = tested.join(maybe_broadcast(sizes, BROADCAST_GROUPS), "grp")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("passed"), F.col("n_passed")).otherwise(F.col("n_rest")))
    rest = F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1)
    with_rest = F.transform(rest, lambda j: F.xxhash64("grp", F.lit(0), F.least(own, j), F.greatest(own, j)))
    rest_with_passed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_passed") - 1), lambda j: F.xxhash64("grp", F.lit(1), own, j))
    passed_with_rest = F.transform(rest, lambda j: F.xxhash64("grp", F.lit(1), j, own))
    tasks = F.when(F.col("passed"), passed_with_rest).otherwise(F.concat(with_rest, rest_with_passed))
    blocks = dealt.select(F.explode(tasks).alias("grp"), "node", *payload, "passed")
    return edges.unionByName(star).unionByName(blocks.groupBy("grp").applyInArrow(_edges_of(test), EDGES))


def dealt(rows: DataFrame, values: DataFrame, key: str, name: str, n_rows: int) -> DataFrame:
    """rows with the column name of values(key, name, n: rows of that key), one for each key of rows.

    Hubs, keys with more than HUB rows and more than one HUBS-th of all, get their value by
    broadcast, and their rows are dealt over all tasks. They are fewer than HUBS, since each
    has more than n_rows / HUBS of the n_rows rows that n was counted over.
    """
    hub = F.col("n") > max(HUB, n_rows // HUBS)
    hubs = values.where(hub).select(key, F.col(name).alias("of_hub"))
    rest = values.where(~hub).select(F.col(key).alias("dealt_by"), name)
    marked = rows.join(F.broadcast(hubs), key, "left")
    marked = marked.withColumn("dealt_by", F.when(F.col("of_hub").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    return marked.join(rest, "dealt_by", "left").select(*rows.columns, F.coalesce("of_hub", name).alias(name))


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number and hash of edges."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the edges, by alternating large and small stars.

    Every round is joins and sums by node with partial results; a hub's edges are dealt over
    all tasks. The rounds end when the edges stay the same.
    """
    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, now = None, _state(e)
    while now != before:
        n = 2 * now[0]  # no node has more edges in the second half of a round than in both directions of the first
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        e = dealt(both.where("v > u"), least, "u", "m", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        e = dealt(e, least, "u", "m", n).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        e = checkpointed(e)
        before, now = now, _state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
