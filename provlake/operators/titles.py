"""Near-duplicate titles in arrival order (D5, ordered form), for groups of any size."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a group decided in one task, one after the other, and the most decided in one step later on
FIRST_BLOCK, MOST_BLOCK = 1024, 1 << 14
#: from this length on, the matching-blocks ratio passes over frequent characters, and a title need not resemble itself
LONG_TITLE = 200


def matching_blocks(late: str, early: str, threshold: float) -> bool:
    """Whether the ratio of matching blocks reaches the threshold; cheap upper bounds come first."""
    total = len(late) + len(early)
    if total and 2 * min(len(late), len(early)) < threshold * total:
        return False
    if total and 2 * sum((Counter(late) & Counter(early)).values()) < threshold * total:
        return False
    return SequenceMatcher(None, late, early).ratio() >= threshold


def _edits(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


#: titles of a group in one cell: the most that a task holds of one side, each met by as many of the other
CELL = 4096
#: words of 64 bits that mark a title's pairs of characters, and its characters
PAIR_WORDS, CHAR_WORDS = 4, 2


def _numbered(parts: Column) -> Column:
    """Hashes of an array's elements, each with its number among equal ones."""
    return F.transform(parts, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(parts, F.lit(1), i), lambda y: y == x))))


def marked(rows: DataFrame, t: str = "t") -> DataFrame:
    """Adds n, the length of a title, and marks, words of 64 bits: a bit for each counted pair of characters, and for each counted character.

    Where all but k of a title's pairs are in another, at most k of its marks are not.
    """

    def words(hashes: str, n: int) -> list[Column]:
        one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        return [F.aggregate(F.filter(hashes, lambda x: F.pmod(F.shiftright(x, 6), F.lit(n)) == k), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(one(x))) for k in range(n)]  # noqa: B023

    cut = rows.withColumn("n", F.length(t)).withColumn("__c", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substr(t, i, F.lit(1)))).otherwise(F.array().cast("array<string>")))
    cut = cut.withColumn("__p", F.transform(F.slice("__c", F.lit(1), F.greatest(F.size("__c") - 1, F.lit(0))), lambda c, i: F.concat(c, F.get("__c", i + 1))))
    return cut.withColumns({"__c": _numbered(F.col("__c")), "__p": _numbered(F.col("__p"))}).withColumn("marks", F.struct(*[w.alias(f"p{k}") for k, w in enumerate(words("__p", PAIR_WORDS))], *[w.alias(f"c{k}") for k, w in enumerate(words("__c", CHAR_WORDS))])).drop("__c", "__p")


def may_be_near(threshold: float, similarity: str, a: str = "late", b: str = "early") -> Column:
    """A cheap necessary condition of the similarity of two titles, by columns {a}_n, {a}_marks, {b}_n and {b}_marks.

    An edit changes two of a title's own pairs of characters and one character at most. Of
    two titles of lengths n and m with blocks in common, at most (1 - threshold)(n + m)
    characters lie outside of these; each breaks two of a title's own pairs or one of the
    other's, so that at most 4 (1 - threshold) n / (2 - threshold) pairs of a title are not
    in common.
    """
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    gone = lambda x, y, kind, k: sum(F.bit_count(F.col(f"{x}_marks.{kind}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}_marks.{kind}{i}")))) for i in range(k))
    if similarity == "edits":
        most = F.floor((1 - threshold) * F.greatest(n, m) + 1e-6)
        lost = {a: (2 * most, most), b: (2 * most, most)}
        long_enough = F.abs(n - m) <= most
    else:
        lost = {x: (F.floor(4 * (1 - threshold) * k / (2 - threshold) + 1e-6), F.floor(k - threshold * (n + m) / 2 + 1e-6)) for x, k in ((a, n), (b, m))}
        long_enough = 2 * F.least(n, m) >= threshold * (n + m) - 1e-6
    out = long_enough
    for x, y in ((a, b), (b, a)):
        out = out & (gone(x, y, "p", PAIR_WORDS) <= lost[x][0]) & (gone(x, y, "c", CHAR_WORDS) <= lost[x][1])
    return out


def near_by_edits(threshold: float, a: str = "late", b: str = "early") -> Column:
    """Whether two titles are similar by edits, by columns {a}_t, {a}_n, {b}_t and {b}_n; the distance is sought up to the most edits allowed."""
    longest = F.greatest(f"{a}_n", f"{b}_n")
    most = F.floor((1 - threshold) * longest + 1e-6).cast("int")
    d = F.call_function("levenshtein", F.col(f"{a}_t"), F.col(f"{b}_t"), most)
    return F.when(longest == 0, 1.0 >= F.lit(threshold)).otherwise((d >= 0) & (1 - d / longest >= threshold))


def met(late: DataFrame, early: DataFrame, condition: Column, how: str) -> DataFrame:
    """late joined with early on g and cell, where the condition holds: each pair of rows meets once, in a task that holds a cell of CELL rows at a time.

    late(g, late_cells array<int>, late_cell, ...), early(g, early_cells, early_cell, ...):
    a row goes to the cells of the other side. Partitions are asked for by number, so that
    small but busy ones are not put together.
    """
    n_tasks = int(late.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = late.withColumn("y", F.explode("late_cells")).withColumn("x", F.col("late_cell")).drop("late_cells", "late_cell").repartition(n_tasks, "g", "x", "y")
    a = early.withColumn("x", F.explode("early_cells")).withColumn("y", F.col("early_cell")).drop("early_cells", "early_cell").repartition(n_tasks, "g", "x", "y")
    a = a.withColumnsRenamed({"g": "__g", "x": "__x", "y": "__y"})
    same = (F.col("g") == F.col("__g")) & (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y"))
    return b.join(a.hint("merge"), same & condition, how)


def _side(rows: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """rows(g, place, t, n, marks) as one side of met: they go to the cells of the places from first to last."""
    cells = F.sequence(F.lit(first // CELL), F.lit(last // CELL))
    return rows.select("g", F.col("place").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("t", "n", "marks")], cells.alias(f"{name}_cells"), F.floor(F.col("place") / CELL).cast("int").alias(f"{name}_cell"))


def _edges(late: DataFrame, early: DataFrame, threshold: float, similarity: str) -> DataFrame:
    """g, early, late: the similar pairs of two sides (_side), earlier rows first."""
    near = (F.col("early") < F.col("late")) & may_be_near(threshold, similarity)
    if similarity == "edits":
        return met(late, early, near & near_by_edits(threshold), "inner").select("g", "early", "late")

    def run(batches):
        for batch in batches:
            ok = [matching_blocks(a, b, threshold) for a, b in zip(batch.column("late_t").to_pylist(), batch.column("early_t").to_pylist(), strict=True)]
            yield batch.select(["g", "early", "late"]).filter(pa.array(ok, type=pa.bool_()))

    return met(late, early, near, "inner").select("g", "early", "late", "early_t", "late_t").mapInArrow(run, "g string, early long, late long")


def _like_earlier(late: DataFrame, early: DataFrame, threshold: float, similarity: str) -> DataFrame:
    """g, place: the rows of one side that are similar to a row of the other."""
    if similarity == "edits":  # the first such row will do
        near = (F.col("early") < F.col("late")) & may_be_near(threshold, similarity) & near_by_edits(threshold)
        return met(late, early, near, "left_semi").select("g", F.col("late").alias("place")).distinct()
    return _edges(late, early, threshold, similarity).select("g", F.col("late").alias("place")).distinct()


def first_kept(rows: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """The rows (g, place) that a sequential pass keeps: those without an edge (g, early, late) from an earlier kept one.

    Rows wait for earlier neighbours alone. In each round, those that wait for none are kept
    and their later neighbours dropped, until no edge is left between undecided rows.
    """
    edges = keep(edges)
    if edges.isEmpty():
        return rows.select("g", "place")
    kept = rows.join(edges.select("g", F.col("late").alias("place")).distinct(), ["g", "place"], "left_anti").select("g", "place")
    free, rounds = kept, [kept]
    while True:
        gone = edges.join(free.withColumnRenamed("place", "early"), ["g", "early"], "left_semi").select("g", F.col("late").alias("place")).distinct()
        gone = keep(gone)
        left = edges.join(gone.withColumnRenamed("place", "late"), ["g", "late"], "left_anti")  # rows that are still undecided
        waits = left.select("g", "late").distinct()
        alive = left.join(gone.withColumnRenamed("place", "early"), ["g", "early"], "left_anti")
        alive = keep(alive)
        free = keep(waits.join(alive.select("g", "late").distinct(), ["g", "late"], "left_anti").withColumnRenamed("late", "place"))
        if free.isEmpty():
            break
        rounds.append(free)
        edges = alive
        if edges.isEmpty():
            break
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def _placed(rows: DataFrame, keep, first: int, most: int) -> DataFrame:
    """Adds place, a row's rank in its group, and block: the first `first` rows, then twice as many up to `most` at once.

    Rows are ranged over all tasks and ranked where they lie; counts of the tasks before are added.
    """
    ranged = keep(rows.repartitionByRange("g", "o", "t").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))  # a row for each task of a group
    local = F.row_number().over(Window.partitionBy("g", "part").orderBy("o", "t")) - 1
    placed = ranged.withColumn("local", local).join(counts.select("g", "part", "before"), ["g", "part"]).withColumn("place", F.col("local") + F.col("before"))
    place, steps = F.col("place"), 0
    while first << steps < most:
        steps += 1
    doubled = sum((F.when(place >= first << k, 1).otherwise(0) for k in range(steps + 1)), F.lit(0))
    last = first << steps  # all steps of doubling end here
    return placed.withColumn("block", (doubled + F.when(place >= last, F.floor((place - last) / most)).otherwise(0)).cast("long")).drop("part", "local", "before")


def _bounds(block: int, first: int, most: int) -> tuple[int, int]:
    """The places of a block: from the first, up to the second without it (_placed)."""
    steps = 0
    while first << steps < most:
        steps += 1
    if block <= steps:
        return first << block - 1, first << block
    return (first << steps) + (block - steps - 1) * most, (first << steps) + (block - steps) * most


def dedup_titles_ordered(df: DataFrame, key: str, order: str, threshold: float = 0.85, similarity: str = "blocks", keep=None, first_block: int = FIRST_BLOCK, most_block: int = MOST_BLOCK) -> DataFrame:
    """Rows whose title is not similar to an earlier kept one of the key and publisher (D5, ordered form).

    df(key, order, publisher, title): order is unique within a key. similarity is that of
    matching blocks, or edits. The result is that of a loop over each key's rows in order,
    against the titles it has kept. Of equal titles only the first can be kept. A group's
    first rows are decided by such a loop in one task; the rows after them in blocks that
    double: those similar to a kept row are dropped, and of the rest first_kept decides.
    Titles meet in cells of bounded size, where marks tell most pairs apart, so that a publisher of any size is spread.
    Rows without a publisher are kept; a null title is an empty one. keep materialises
    steps, e.g. by a checkpoint.
    """
    keep = keep or (lambda x: x.cache())
    publisher = F.lower(F.coalesce("publisher", F.lit("")))
    title = F.regexp_replace(F.lower(F.coalesce(F.col("title"), F.lit(""))), r"(?U)^\s+|\s+$", "")
    named = df.withColumns({"__p": publisher, "__g": F.to_json(F.struct(F.col(key).alias("k"), publisher.alias("p"))), "__t": title})
    rows = named.where("__p <> ''").select(F.col("__g").alias("g"), F.col("__t").alias("t"), F.col(order).alias("o"))
    base = rows.groupBy("g", "t").agg(F.min("o").alias("o"))
    if similarity == "blocks":  # a long title that does not resemble itself falls together with no other row

        def unlike(batches):
            for batch in batches:
                yield batch.filter(pa.array([not matching_blocks(t, t, threshold) for t in batch.column("t").to_pylist()], type=pa.bool_()))

        odd = base.where(F.length("t") >= LONG_TITLE).select("t").distinct().mapInArrow(unlike, "t string")
        base = base.join(odd, "t", "left_anti").unionByName(rows.join(odd, "t", "left_semi"))
    placed = keep(_placed(base, keep, first_block, most_block))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, places = [], []
        for place, t in pdf.sort_values("place")[["place", "t"]].itertuples(index=False):
            if not any(matching_blocks(t, x, threshold) if similarity == "blocks" else _edits(t, x) >= threshold for x in kept):
                kept.append(t)
                places.append(place)
        return pd.DataFrame({"g": pdf["g"].iloc[:1].repeat(len(places)).to_numpy(), "place": places})

    kept = keep(placed.where("block = 0").groupBy("g").applyInPandas(greedy, "g string, place long"))
    blocks = placed.agg(F.max("block")).first()[0] or 0
    if blocks:
        large = placed.where("block > 0").select("g").distinct()
        titled = keep(marked(placed.join(large, "g", "left_semi").select("g", "place", "block", "t")))
        for b in range(1, blocks + 1):
            first, last = _bounds(b, first_block, most_block)
            now = titled.where(F.col("block") == b)
            earlier = titled.where(F.col("block") < b).join(kept, ["g", "place"], "left_semi").join(now.select("g").distinct(), "g", "left_semi")
            gone = _like_earlier(_side(now, "late", 0, first - 1), _side(earlier, "early", first, last - 1), threshold, similarity)
            left = keep(now.join(gone, ["g", "place"], "left_anti"))
            edges = _edges(_side(left, "late", first, last - 1), _side(left, "early", first, last - 1), threshold, similarity)
            kept = keep(kept.unionByName(first_kept(left.select("g", "place"), edges, keep)))
    chosen = placed.join(kept, ["g", "place"], "left_semi").select(F.col("g").alias("__g"), F.col("t").alias("__t"), F.col("o").alias("__o"))
    same = (F.col("a.__g") == F.col("b.__g")) & (F.col("a.__t") == F.col("b.__t")) & (F.col(f"a.{order}") == F.col("b.__o"))
    return named.where("__p <> ''").alias("a").join(chosen.alias("b"), same, "left_semi").select(*df.columns).unionByName(named.where("__p = ''").select(*df.columns))
