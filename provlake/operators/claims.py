"""Claims (F): extraction, grounding, merging and confidence, for all runs at once."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from provlake.functions import rules
from provlake.functions.text import PLAIN_NUMBER, RANGE, numbers, statement_tokens

JACCARD, CONTAINMENT, MIN_CONTAINED = 0.55, 0.65, 3
#: a group's text is the longest of its claims' under so many characters
MAX_STATEMENT = 300
#: chains of duplicates of at most so many claims are merged in order within one task
LOOP_CLAIMS = 4096
#: longer chains are merged in blocks of so many claims
BLOCK = 8192
#: about the most texts of one token that meet others in one task
MEET = 4096


def pack_batches(df: DataFrame, key: str, ident: str, keep, n: int = 3) -> DataFrame:
    """key, ident, batch: the ids of a key in groups of n, in order (F1). Ids are unique within a key.

    Ids alone are ranged over all tasks, ranked where they lie, and moved up by the counts of
    the tasks before, so that a run of any size is spread. keep holds the ranges fast, e.g.
    a checkpoint.
    """
    ranged = keep(df.select(key, ident).repartitionByRange(key, ident).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # a row for each task of a run
    place = F.row_number().over(Window.partitionBy(key, "__part").orderBy(ident)) - 1
    same = F.col("x.__part").eqNullSafe(F.col("y.__part")) & F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}"))
    placed = ranged.withColumn("__place", place).alias("x").join(counts.alias("y"), same)
    return placed.select(f"x.{key}", ident, F.floor((F.col("__place") + F.col("__before")) / n).alias("batch"))


def assemble_batches(df: DataFrame, key: str, ident: str, keep, n: int = 3, max_chars: int = 6000, single_chars: int = 8000) -> DataFrame:
    """key, batch, n_sources, prompt: a header and the cut text of each source, a blank line between (F2).

    df(key, ident, title, content). Batches have at most n sources, so a prompt is bounded;
    texts are cut before they are moved.
    """
    cut = df.select(key, F.col(ident).alias("o"), F.format_string("SOURCE %s: %s\n", F.col(ident).cast("string"), F.col("title")).alias("h"), F.substring("content", 1, max(max_chars, single_chars)).alias("c"))
    batched = pack_batches(df, key, ident, keep, n).select(F.col(key).alias("__key"), F.col(ident).alias("__id"), "batch")
    rows = cut.join(batched, F.col(key).eqNullSafe(F.col("__key")) & (F.col("o") == F.col("__id")))
    grouped = rows.groupBy(key, "batch").agg(F.sort_array(F.collect_list(F.struct("o", "h", "c"))).alias("s"))
    limit = F.when(F.size("s") == 1, single_chars).otherwise(max_chars)
    text = F.array_join(F.transform("s", lambda x: F.concat(x["h"], F.substring(x["c"], F.lit(1), limit))), "\n\n")
    return grouped.select(key, "batch", F.size("s").alias("n_sources"), text.alias("prompt"))


def extract_claims(df: DataFrame, mode: str = "sentences", ident: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """ident, the columns to keep, seq, statement, excerpt, finding_type, importance, confidence, relevance.

    sentences: the first two of more than 20 characters, a fact and a risk. line: the first
    line of more than 30 characters, a fact.
    """
    text = F.coalesce(F.col(text), F.lit(""))
    if mode == "line":
        lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 30)
        out = df.select(ident, *keep, F.get(lines, F.lit(0)).alias("excerpt")).where("excerpt is not null")
        return out.select(ident, *keep, F.lit(1).alias("seq"), F.substring("excerpt", 1, 200).alias("statement"), F.substring("excerpt", 1, 200).alias("excerpt"), F.lit("fact").alias("finding_type"), F.lit("medium").alias("importance"), F.lit(0.60).alias("confidence"), F.lit(0.90).alias("relevance"))
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([^.\n]+)"), 1), lambda x: F.trim(x)), lambda x: F.length(x) > 20)
    out = df.select(ident, *keep, F.posexplode(F.slice(found, 1, 2)).alias("pos", "excerpt"))
    fact = F.col("pos") == 0
    return out.select(
        ident,
        *keep,
        (F.col("pos") + 1).alias("seq"),
        F.substring("excerpt", 1, 150).alias("statement"),
        "excerpt",
        F.when(fact, "fact").otherwise("risk").alias("finding_type"),
        F.when(fact, "high").otherwise("medium").alias("importance"),
        F.when(fact, 0.88).otherwise(0.82).alias("confidence"),
        F.when(fact, 0.95).otherwise(0.90).alias("relevance"),
    )


def cap_per(df: DataFrame, key: str | list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key in order: five claims a source (F4), forty a run."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def resolve_source(claims: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds resolved_id and resolved_url (F5): by a known id, else by a known url, else the only source of the batch.

    claims(batch, source_id, source_url), batch(batch, source_id, url).
    """
    by_id = batch.select("batch", F.col("source_id"), F.col("url").alias("__url"))
    by_url = batch.groupBy("batch", F.col("url").alias("source_url")).agg(F.min("source_id").alias("__id"))
    only = batch.groupBy("batch").agg(F.count("*").alias("__n"), F.min("source_id").alias("__only"), F.min("url").alias("__only_url"))
    out = claims.join(by_id, ["batch", "source_id"], "left").join(by_url, ["batch", "source_url"], "left").join(only, "batch", "left")
    alone = F.col("__n") == 1
    found = F.when(F.col("__url").isNotNull(), F.col("source_id")).when(F.col("__id").isNotNull(), F.col("__id")).when(alone, F.col("__only"))
    url = F.when(F.col("__url").isNotNull(), F.col("__url")).when(F.col("__id").isNotNull(), F.col("source_url")).when(alone, F.col("__only_url"))
    return out.withColumns({"resolved_id": found, "resolved_url": url}).drop("__url", "__id", "__n", "__only", "__only_url")


def is_template(statement: Column) -> Column:
    """Empty, or begins like a template."""
    text = F.trim(F.coalesce(statement, F.lit("")))
    return (text == "") | text.rlike("(?i)^(?:" + "|".join(rules.TEMPLATE_PHRASES) + ")")


def is_grounded(excerpt: Column, content: Column) -> Column:
    """Whether the trimmed excerpt, or its first 100 characters, stands word for word in the content."""
    text = F.trim(F.coalesce(excerpt, F.lit("")))
    return F.coalesce((text != "") & (F.contains(content, text) | F.contains(content, F.substring(text, 1, 100))), F.lit(False))


def ground(claims: DataFrame, contents: DataFrame, key: str = "source_id") -> DataFrame:
    """Claims with grounded, by their source's content."""
    return claims.join(contents.select(key, "content"), key, "left").withColumn("grounded", is_grounded(F.col("excerpt"), F.col("content"))).drop("content")


def numeric_guard(statement: Column, excerpt: Column) -> Column:
    """struct(ok, inverted, ungrounded): inverted ranges, and numbers above 4 that the excerpt lacks."""
    ranges = F.regexp_extract_all(F.coalesce(statement, F.lit("")), F.lit(RANGE), 0)
    inverted = F.filter(ranges, lambda x: F.regexp_extract(x, RANGE, 1).cast("double") > F.regexp_extract(x, RANGE, 2).cast("double"))
    said = F.regexp_extract_all(F.coalesce(statement, F.lit("")), F.lit(PLAIN_NUMBER), 0)
    known = F.regexp_extract_all(F.coalesce(excerpt, F.lit("")), F.lit(PLAIN_NUMBER), 0)
    ungrounded = F.filter(F.array_except(said, known), lambda x: x.cast("double") > 4)
    return F.struct(((F.size(inverted) == 0) & (F.size(ungrounded) == 0)).alias("ok"), inverted.alias("inverted"), ungrounded.alias("ungrounded"))


def duplicate(a: str, b: str, threshold: float = JACCARD, containment: float | None = CONTAINMENT) -> Column:
    """Whether two claims say the same (F13): a and b prefix columns statement, toks and nums."""
    x, y = F.col(f"{a}toks"), F.col(f"{b}toks")
    both, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    least = F.least(F.size(x), F.size(y))
    near = both >= threshold * every - 1e-9
    if containment is not None:
        near = near | ((least >= MIN_CONTAINED) & (both >= containment * least - 1e-9))
    same = F.lower(F.trim(f"{a}statement")) == F.lower(F.trim(f"{b}statement"))
    clash = (F.size(f"{a}nums") > 0) & (F.size(f"{b}nums") > 0) & ~F.arrays_overlap(f"{a}nums", f"{b}nums")
    return same | ((F.size(x) > 0) & (F.size(y) > 0) & ~clash & near)


def featured(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"toks": statement_tokens(F.col("statement")), "nums": F.array_distinct(numbers(F.col("statement")))})


def texts_of(claims: DataFrame, run: str = "run_id", ident: str = "claim_id") -> DataFrame:
    """One row for each distinct statement of a run: its smallest claim id stands for it."""
    return claims.groupBy(run, F.lower(F.trim("statement")).alias("folded")).agg(F.min(ident).alias(ident), F.min_by("statement", ident).alias("statement"), F.count("*").alias("copies"))


def claim_pairs(claims: DataFrame, run: str = "run_id", ident: str = "claim_id", threshold: float = JACCARD, containment: float | None = CONTAINMENT, keep=None) -> DataFrame:
    """run, id_a < id_b: the duplicate pairs of different statements within a run (F13, F15). keep: materialises the statements, e.g. a checkpoint."""
    texts = featured(texts_of(claims, run, ident))
    return text_pairs(keep(texts) if keep else texts, run, ident, threshold, containment, keep)


def text_pairs(texts: DataFrame, run: str, ident: str, threshold: float = JACCARD, containment: float | None = CONTAINMENT, keep=None) -> DataFrame:
    """claim_pairs of texts(run, ident, statement, toks, nums), one row for each different statement (texts_of, featured).

    With a run's tokens ordered by rarity, a text of n tokens that must share k of them with
    a text of no fewer has one of its first n - k + 1 tokens there: these meet all tokens of
    the others. All shared tokens come after the first shared one in both sets, so that what
    is left there must suffice for the overlap asked. A pair is judged where its first shared
    token meets, by tokens as numbers that go along, so that only pairs that hold leave their
    task: what is shuffled grows with the texts, whatever the number of pairs. A token with
    many texts is dealt in shards of at most about MEET of them.
    """
    keep = keep or (lambda x: x.cache())
    each = texts.where(F.size("toks") > 0).select(run, ident, F.explode("toks").alias("tok"))
    common = each.groupBy(run, "tok").agg(F.count("*").alias("df")).orderBy("df", "tok").withColumn("x", F.monotonically_increasing_id())
    shards = F.ceil(F.col("df") / MEET).cast("int").alias("s")
    ranked = each.join(keep(common), [run, "tok"]).groupBy(run, ident).agg(F.array_sort(F.collect_list(F.struct("x", shards))).alias("at"))
    bits = lambda k: F.aggregate("toks", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 6 * k).bitwiseAND(F.lit(63)).cast("int"))))
    sets = ranked.select(run, ident, "at", F.col("at.x").alias("toks"), F.size("at").alias("n"))
    nums = texts.where(F.size("nums") > 0).select(run, ident, "nums")
    sets = keep(sets.withColumns({"low": bits(0), "high": bits(1)}).join(nums, [run, ident], "left"))

    def needed(n: Column, m: Column) -> Column:
        alike = threshold / (1 + threshold) * (n + m)
        return (alike if containment is None else F.when(n >= MIN_CONTAINED, F.least(F.lit(containment) * n, alike)).otherwise(alike)) - 1e-9

    n_tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda d: d.repartition(n_tasks, run, "tok", "shard")
    out = sets.select(run, *[F.col(c).alias(f"{c}_a") for c in (ident, "toks", "n", "low", "high", "nums")], F.posexplode(F.slice("at", F.lit(1), (F.col("n") - F.ceil(needed(F.col("n"), F.col("n"))) + 1).cast("int"))).alias("r_a", "t"))
    a = dealt(out.select("*", F.col("t.x").alias("tok"), F.explode(F.sequence(F.lit(0), F.col("t.s") - 1)).alias("shard")).drop("t"))
    out = sets.select(run, *[F.col(c).alias(f"{c}_b") for c in (ident, "toks", "n", "low", "high", "nums")], F.posexplode("at").alias("r_b", "t"))
    b = dealt(out.select("*", F.col("t.x").alias("tok"), F.pmod(F.xxhash64(f"{ident}_b"), F.col("t.s")).cast("int").alias("shard")).drop("t"))
    id_a, id_b, n, m = F.col(f"{ident}_a"), F.col(f"{ident}_b"), F.col("n_a"), F.col("n_b")
    need = needed(n, m)
    absent = lambda x: F.bit_count(F.col(f"{x}_a").bitwiseAND(F.bitwise_not(F.col(f"{x}_b"))))
    first = (F.col("r_a") == 0) | ~F.arrays_overlap(F.slice("toks_a", F.lit(1), F.col("r_a")), "toks_b")
    clash = F.col("nums_a").isNotNull() & F.col("nums_b").isNotNull() & ~F.coalesce(F.arrays_overlap("nums_a", "nums_b"), F.lit(False))
    met = ((n < m) | ((n == m) & (id_a < id_b))) & (n - F.col("r_a") >= need) & (m - F.col("r_b") >= need) & (absent("low") <= n - need) & (absent("high") <= n - need)
    found = a.join(b, [run, "tok", "shard"]).where(met).where(first & (F.size(F.array_intersect("toks_a", "toks_b")) >= need) & ~clash)
    return found.select(run, F.least(id_a, id_b).alias("id_a"), F.greatest(id_a, id_b).alias("id_b"))


def spanning(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the components of all pairs, at most one for each node of a task: what a task's pairs join is said once."""

    def forest(batches):
        up = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if (a := top(a)) != (b := top(b)):
                    up[max(a, b)] = min(a, b)
        nodes = [x for x in up if up[x] != x]
        for i in range(0, len(nodes), 1 << 16):
            some = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([top(x) for x in some], kinds[0]), pa.array(some, kinds[1])], ["a", "b"])

    pairs = pairs.select("a", "b")
    kinds = [to_arrow_type(f.dataType) for f in pairs.schema.fields]
    return pairs.mapInArrow(forest, pairs.schema)


def looked_up(rows: DataFrame, key: str, values: DataFrame, ident: str, name: str, n_rows: int, hot: int) -> DataFrame:
    """rows with the column name of values(ident, name), one for each key of rows.

    Keys with more than hot rows, and more than one 100,000th of all, get their value by
    broadcast, so that their rows stay where they are; there are fewer than 100,000 of them.
    """
    rest, held = rows, values.select(F.col(ident).alias("__id"), name)
    if n_rows > hot:
        often = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(hot, n_rows // 100_000)).select(F.col(key).alias("__id"))
        hubs = F.broadcast(held.join(F.broadcast(often), "__id", "left_semi"))
        at_hub = F.col(key) == F.col("__id")
        rest = rows.join(hubs, at_hub, "left_anti").join(held, at_hub).unionByName(rows.join(hubs, at_hub))
        return rest.drop("__id")
    return rest.join(held, F.col(key) == F.col("__id")).drop("__id")


def label_components(pairs: DataFrame, keep, max_rounds: int = 50, hot: int = 100_000) -> DataFrame:
    """node, component (smallest node reachable) of the nodes of pairs(a, b), by contraction.

    A round lets each node go over to the neighbour first in an order by hash, which is another
    one each round, then on to where that one went; edges follow their nodes, and those within
    one node go. What is settled takes no part any more, so that all rounds together move a
    few times what the first one moves, and rounds grow with the logarithm of a path. At
    the end the rounds are followed back. A node with more than hot edges, or one that more
    than hot nodes go to, is never one task's work (looked_up). keep cuts lineage: best by
    files, since constraints that a checkpoint carries on make later rounds slow to plan.
    """
    edges = keep(pairs.select("a", "b"))
    rounds, left = [], edges.count()
    while left or not rounds:
        if len(rounds) == max_rounds:
            raise RuntimeError("the components did not settle")
        place = lambda c, k=len(rounds): F.xxhash64(c, F.lit(k))
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = sides.groupBy(F.col("a").alias("node")).agg(F.min_by("b", place("b")).alias("near"))
        over = keep(near.select("node", F.when(place("near") < place("node"), F.col("near")).otherwise(F.col("node")).alias("component")))
        gone = keep(looked_up(over, "component", over.select("node", F.col("component").alias("next")), "node", "next", left, hot))
        rounds.append((gone.select("node", "next"), left))
        ends = looked_up(edges, "a", gone.select("node", F.col("next").alias("x")), "node", "x", left, hot)
        ends = keep(ends) if left > hot else ends  # looked_up reads it more than once
        ends = looked_up(ends, "b", gone.select("node", F.col("next").alias("y")), "node", "y", left, hot).where("x <> y")
        edges = keep(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        left = edges.count()
    out, n = rounds.pop()
    for steps, n in reversed(rounds):
        far = out.select(F.col("node").alias("at"), F.col("next").alias("far"))
        last = steps.select(F.col("next").alias("via")).distinct().join(far, F.col("via") == F.col("at"), "left").select("via", F.coalesce("far", "via").alias("last"))
        out = looked_up(steps, "next", last, "via", "last", n, hot).select("node", F.col("last").alias("next"))
        out = keep(out) if n > hot else out
    first = out.groupBy(F.col("next").alias("last")).agg(F.min("node").alias("component"))
    return keep(looked_up(out, "next", first, "last", "component", n, hot).select("node", "component"))


def merge_claims(claims: DataFrame, keep, run: str = "run_id", ident: str = "claim_id", threshold: float = JACCARD, containment: float | None = CONTAINMENT) -> DataFrame:
    """claim ids, unique over runs, with group_id: the smallest id of a chain of duplicates (F14, components).

    The result does not depend on order. canonical(...) makes the merged rows of it. Only
    statements with a duplicate take part in the rounds; the others are their own groups.
    """
    texts = keep(featured(texts_of(claims, run, ident)))
    return merge_texts(claims, texts, _linked(texts, keep, run, ident, threshold, containment), keep, run, ident)


def _linked(texts: DataFrame, keep, run: str, ident: str, threshold: float, containment: float | None = CONTAINMENT) -> DataFrame:
    return text_pairs(texts, run, ident, threshold, containment, keep).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def merge_texts(claims: DataFrame, texts: DataFrame, pairs: DataFrame, keep, run: str, ident: str) -> DataFrame:
    """claims with group_id, by texts (texts_of, featured) and their duplicate pairs(a, b): merge_claims for callers that have both."""
    labels = label_components(spanning(pairs), keep)
    named = texts.select(run, "folded", F.col(ident).alias("__rep")).join(labels, F.col("__rep") == F.col("node"), "left").select(run, "folded", F.coalesce("component", "__rep").alias("group_id"))
    return claims.withColumn("folded", F.lower(F.trim("statement"))).join(named, [run, "folded"]).drop("folded")


def canonical(merged: DataFrame, run: str = "run_id", ident: str = "claim_id", max_chars: int = MAX_STATEMENT) -> DataFrame:
    """A row for each group: the longest statement under max_chars (else the first), the first claim's type and importance, sums."""
    short = F.when(F.length("statement") < max_chars, F.struct(F.length("statement").alias("n"), (-F.col(ident)).alias("i"), F.col("statement").alias("s")))
    first = F.min(F.struct(F.col(ident).alias("i"), F.col("statement").alias("s"), F.col("finding_type").alias("t"), F.col("importance").alias("m")))
    out = merged.groupBy(run, "group_id").agg(F.max(short).alias("best"), first.alias("first"), F.count("*").alias("merged_count"), F.countDistinct("source_id").alias("distinct_sources"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return out.select(run, "group_id", F.coalesce("best.s", "first.s").alias("statement"), F.col("first.t").alias("finding_type"), F.col("first.m").alias("importance"), "merged_count", "distinct_sources", "mean_confidence")


def merge_ordered(claims: DataFrame, run: str = "run_id", ident: str = "claim_id", order: str = "seq", threshold: float = JACCARD, part: str | None = None) -> DataFrame:
    """run, ident, group_id by the greedy rule in arrival order (F14, ordered): each claim joins the first group whose current text it repeats.

    One run, or one part of a run, is one task's work: for runs of bounded size, else merge_ordered_parts.
    """
    keys = [run, part] if part else [run]
    rows = featured(claims).select(*keys, ident, order, "statement", "toks", "nums")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        out = []
        for r in pdf.sort_values([order, ident]).itertuples(index=False):
            text, toks, nums = r.statement.strip(), set(r.toks), set(r.nums)
            for g in groups:
                both, least = len(toks & g[2]), min(len(toks), len(g[2]))
                near = least and (both / len(toks | g[2]) >= threshold or (least >= MIN_CONTAINED and both / least >= CONTAINMENT))
                if text.lower() == g[1].lower() or (near and not (nums and g[3] and not nums & g[3])):
                    if len(g[1]) < len(text) < MAX_STATEMENT:
                        g[1:] = [text, toks, nums]
                    break
            else:
                groups.append(g := [getattr(r, ident), text, toks, nums])
            out.append((getattr(r, run), getattr(r, ident), g[0]))
        return pd.DataFrame(out, columns=[run, ident, "group_id"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(*keys).applyInPandas(greedy, f"{run} {kinds[run]}, {ident} {kinds[ident]}, group_id {kinds[ident]}")


def merge_blocks(rows: DataFrame, pairs: DataFrame, keep, run: str, ident: str, order: str, size: int = BLOCK) -> DataFrame:
    """run, ident, group_id of rows(run, part, x, n, order, ident): the greedy rule for chains of any size, over the pairs (a, b) of similar texts x.

    A chain's claims go in blocks of size, in order, all chains at once. A block is one task's
    loop; it is given the pairs within it, at most size * size / 2, and those to texts that
    groups of earlier blocks have now, and hands on what its groups' texts became. Places in
    a chain are counted per task of a range, as in pack_batches.
    """
    ranged = keep(rows.repartitionByRange("part", order, ident).withColumn("__task", F.spark_partition_id()))
    before = Window.partitionBy("part").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("part", "__task").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("part", "__task").orderBy(order, ident)) - 1 + F.col("__before")
    placed = ranged.join(counts, ["part", "__task"]).withColumn("place", place).withColumn("block", F.floor(F.col("place") / size))
    placed = keep(placed.select(run, "part", "x", "n", ident, "place", "block"))

    sides = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    stood = placed.groupBy(F.col("x").alias("y")).agg(F.min("block").alias("since"))
    known = sides.join(stood, "y").unionByName(stood.select(F.col("y").alias("x"), "y", "since"))  # a text is next to itself
    near = placed.select("part", "x", "block").distinct().join(known, "x").where("since <= block").select("part", "block", "x", "y")
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = keep(near.repartition(n_tasks, "block", F.pmod(F.xxhash64("x"), F.lit(8))).sortWithinPartitions("block"))  # a block's rows lie together

    kinds = {f.name: f.dataType for f in placed.schema.fields}
    names = {"part": "part", "of": ident, "g": "place", "group_id": ident, "y": "x", "m": "n"}
    made = StructType([StructField(c, kinds[k]) for c, k in names.items()])

    def greedy(said: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        beside, at, name, changed, out = {}, {}, {}, {}, []
        for x, y, g, group, m in met[["x", "y", "g", "group_id", "m"]].itertuples(index=False, name=None):
            beside.setdefault(x, set()).add(y)
            if g >= 0:
                at.setdefault(y, {})[g], name[g] = m, group
        part = said["part"].iat[0]
        for place, x, n, i in said.sort_values("place")[["place", "x", "n", ident]].itertuples(index=False, name=None):
            g, y = min(((min(at[y]), y) for y in beside[x] if at.get(y)), default=(None, None))
            if g is None:
                g, name[place] = place, i
                at.setdefault(x, {})[g] = n
                changed[g] = (x, n)
            elif at[y][g] < n < MAX_STATEMENT:
                del at[y][g]
                at.setdefault(x, {})[g] = n
                changed[g] = (x, n)
            out.append((part, i, g, name[g], None, None))
        out += [(part, None, g, name[g], x, n) for g, (x, n) in changed.items()]
        return pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=object) for k, c in enumerate(names)})

    live, done = rows.sparkSession.createDataFrame([], StructType([f for f in made.fields if f.name != "of"])), []
    for k in range(placed.agg(F.max("block")).first()[0] + 1):
        said = placed.where(F.col("block") == k)
        inside = said.select(F.col("x").alias("y")).distinct().withColumn("inside", F.lit(True))
        met = near.where(F.col("block") == k).select("part", "x", "y").join(live.drop("part"), "y", "left").join(inside, "y", "left").where("inside or g is not null")
        met = met.select("part", "x", "y", F.coalesce("g", F.lit(-1)).alias("g"), F.coalesce("group_id", "y").alias("group_id"), F.coalesce("m", F.lit(0)).alias("m"))  # without nulls ids stay whole numbers
        out = keep(said.groupBy("part").cogroup(met.groupBy("part")).applyInPandas(greedy, made))
        done.append(out.where("of is not null").select(F.col("of").alias(ident), "group_id"))
        now = out.where("of is null").drop("of")
        live = keep(live.join(now, ["part", "g"], "left_anti").unionByName(now))
        if len(done) > 30:
            done = [keep(reduce(DataFrame.unionByName, done))]
    return placed.select(run, ident).join(reduce(DataFrame.unionByName, done), ident)


def merge_ordered_parts(claims: DataFrame, keep, run: str = "run_id", ident: str = "claim_id", order: str = "seq", threshold: float = JACCARD, most: int = LOOP_CLAIMS, block: int = BLOCK) -> DataFrame:
    """merge_ordered for runs of any size, with the same result; claim ids are unique over runs.

    A group's current text is one of its claims', so a claim only ever joins a group of its
    own chain of duplicates (merge_claims). In a chain of one text all claims join the
    first, without Python; one of at most `most` claims is one task's work; longer ones go
    in blocks (merge_blocks).
    """
    texts = keep(featured(texts_of(claims, run, ident)))
    pairs = keep(_linked(texts, keep, run, ident, threshold))
    chains = keep(merge_texts(claims, texts, pairs, keep, run, ident).withColumnRenamed("group_id", "__part").select(run, "__part", ident, order, "statement"))
    first = F.min(F.struct(order, ident))[ident].alias("group_id")
    folded = F.lower(F.trim("statement"))
    sizes = keep(chains.groupBy("__part").agg(first, (F.min(folded) == F.max(folded)).alias("__one"), F.count("*").alias("__n")))
    placed = chains.join(sizes, "__part")
    mixed = merge_ordered(placed.where(f"not __one and __n <= {most}").drop("group_id"), run, ident, order, threshold, "__part")
    out = placed.where("__one").select(run, ident, "group_id").unionByName(mixed)
    long = placed.where(f"not __one and __n > {most}")
    if sizes.where(f"not __one and __n > {most}").isEmpty():
        return out
    named = texts.select(run, "folded", F.col(ident).alias("x"), F.length(F.trim("statement")).alias("n"))
    rows = keep(long.withColumn("folded", folded).join(named, [run, "folded"]).select(run, F.col("__part").alias("part"), "x", "n", order, ident))
    nodes = rows.select(F.col("x").alias("a")).distinct()
    return out.unionByName(merge_blocks(rows, pairs.join(nodes, "a", "left_semi"), keep, run, ident, order, block))


def evidence_rollup(evidence: DataFrame, key: str = "group_id") -> DataFrame:
    """Distinct sources, mean relevance and credibility of each canonical claim (F16)."""
    return evidence.groupBy(key).agg(F.countDistinct("source_id").alias("n_sources"), F.round(F.avg(F.coalesce("relevance", F.lit(0.70))), 6).alias("mean_relevance"), F.round(F.avg(F.coalesce("credibility", F.lit(0.75))), 6).alias("mean_credibility"))


def calibrate(match: Column, relevance: Column, credibility: Column, n_sources: Column, role: Column, contradicted: Column, severity: Column) -> Column:
    """struct(confidence, corroboration_bonus, contradiction_penalty, raw)."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    bonus = F.when(n_sources >= 3, 0.15).when(n_sources == 2, 0.08).otherwise(0.0)
    penalty = F.when(~F.coalesce(contradicted, F.lit(False)), 0.0).when(severity == "high", 0.15).when(severity == "medium", 0.08).otherwise(0.04)
    raw = 0.20 * unit(match) + 0.30 * unit(relevance) + 0.30 * unit(credibility) + bonus - penalty
    final = F.when((role == "DISCOVERY_ONLY") & (n_sources <= 1), F.least(F.lit(0.50), raw)).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.15), raw)))
    return F.struct(F.round(F.round(final, 6), 2).alias("confidence"), bonus.alias("corroboration_bonus"), penalty.alias("contradiction_penalty"), F.round(raw, 4).alias("raw"))


def evidence_links(merged: DataFrame, ident: str = "claim_id") -> DataFrame:
    """A link from each merged claim's evidence to its group, relevance within 0 to 1."""
    return merged.select("group_id", ident, "source_id", "excerpt", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("relevance", F.lit(1.0)))).alias("relevance"))


def rejection_cause(claims: DataFrame) -> Column:
    """Why a claim is not used (F20): template, unresolved, empty excerpt or ungrounded; null if it is."""
    return F.when(is_template(F.col("statement")), "template").when(F.col("source_id").isNull(), "unresolved").when(F.trim(F.coalesce("excerpt", F.lit(""))) == "", "empty_excerpt").when(~F.col("grounded"), "ungrounded")
