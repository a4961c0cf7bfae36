"""Operator 5, benchmark decontamination: a prefix-filtered set join of shingles.

An item's windows (13 words; the whole item where it is shorter) are sets of shingles of
five words (of all words, for a window with fewer). A document that holds a window holds
all its shingles, so with the shingles ordered by rarity in the documents the necessary
prefix of a window is its rarest one alone: its anchor. Documents' shingles are joined with
anchors; the anchor's place in its window gives the start of a possible occurrence, which
must lie within the document (positional and length bounds), and the words there are
compared with the window's. Windows with a shingle that no document has take no part.

Anchors are broadcast only when their number is checked; beyond the bound the join is a
shuffle of narrow rows, and words are fetched for candidates afterwards.

Defined results: a null or empty document has no words, no hits and is clean; an item
without words has no window; an item with a null id still marks words but is not counted;
equal items count each by its id; repeated document rows each get the same row; an empty
table of documents gives no rows, an empty benchmark marks nothing; of equally rare
shingles the first of the window is its anchor; very long texts are taken whole; other
columns, whatever their names, are ignored (clean keeps them). Native: DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import ascii_lower, maybe_broadcast, small, unused
from provlake.plans.session import checkpointed

WINDOW = 13
SHINGLE = 5
BROADCAST_ANCHORS = 100_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: contaminated when hit words are at least one in so many
ONE_IN = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NO_WORD), "")


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id and text_key, which name a row up to repeats, with its words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("text_key"), words_of(F.col("text")).alias("words"))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win (text of a window), win_words."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    at = w.select("item_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))).alias("at"))
    at = at.select("item_id", F.slice("words", F.col("at"), F.lit(window)).alias("win_words"))
    return at.select("item_id", F.array_join("win_words", " ").alias("win"), "win_words").distinct()


def shingle(words: str, at: Column, k: int) -> Column:
    """Hash of k words from 0-based position `at`."""
    return F.xxhash64(F.lit(k), *[F.get(F.col(words), at + i) for i in range(k)])


def shingles_of(rows: DataFrame, words: str, sizes: list[int], keep: list[str]) -> DataFrame:
    """keep, pos and shingle: a row for each position and size at which a shingle fits."""
    at = rows.select(*keep, words, F.posexplode(words).alias("pos", "__word")) if words not in keep else rows.select(*keep, F.posexplode(words).alias("pos", "__word"))
    each = [F.when(F.col("pos") + k <= F.size(words), shingle(words, F.col("pos"), k)) for k in sizes]
    found = at.select(*keep, "pos", (each[0] if len(each) == 1 else F.explode(F.array(*each))).alias("shingle"))
    return found.where(F.col("shingle").isNotNull())


def anchors_of(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """win, win_words, shingle, offset: the shingle of each window that is rarest in docs; none for a window with a shingle that docs lack."""
    distinct = windows.select("win", "win_words").distinct()
    k = F.least(F.size("win_words"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in distinct.select(k).distinct().collect())  # SHINGLE sizes at most
    if not sizes:
        return distinct.select("win", "win_words", F.lit(0).cast("long").alias("shingle"), F.lit(0).alias("offset"))
    parts = shingles_of(distinct.withColumn("k", k), "win_words", sizes, ["win", "win_words", "k"]) if len(sizes) == 1 else None
    if parts is None:
        each = [shingles_of(distinct.where(k == size), "win_words", [size], ["win", "win_words"]) for size in sizes]
        parts = each[0]
        for other in each[1:]:
            parts = parts.unionByName(other)
    wanted = parts.select("shingle").distinct()
    seen = shingles_of(documents_of(docs).select("words"), "words", sizes, [])
    seen = seen.join(F.broadcast(wanted) if small(wanted, BROADCAST_ANCHORS * 10) else wanted, "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("seen"))
    ranked = parts.join(seen, "shingle", "left").groupBy("win", "win_words").agg(
        F.min_by(F.struct("shingle", F.col("pos").alias("offset")), F.struct(F.coalesce("seen", F.lit(0)), "pos")).alias("best"), F.min(F.coalesce("seen", F.lit(0))).alias("least")
    )
    return ranked.where("least > 0").select("win", "win_words", "best.shingle", "best.offset")


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, text_key, start, n, win: every place where a window's words stand in a document."""
    anchors = checkpointed(anchors_of(docs, windows))
    sizes = sorted(r[0] for r in anchors.select(F.least(F.size("win_words"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    rows = documents_of(docs)
    start, n = (F.col("pos") - F.col("offset")), F.size("win_words")
    fits = (start >= 0) & (start + n <= F.size("words"))
    same = F.slice("words", start + 1, n) == F.col("win_words")
    out = ["doc_id", "text_key", start.alias("start"), n.alias("n"), "win"]
    if small(anchors, BROADCAST_ANCHORS):
        found = shingles_of(rows, "words", sizes, ["doc_id", "text_key", "words"]).join(F.broadcast(anchors), "shingle")
        return found.where(fits & same).select(*out).distinct()
    found = shingles_of(rows.withColumn("n_words", F.size("words")), "words", sizes, ["doc_id", "text_key", "n_words"]).join(anchors, "shingle")
    found = found.where((start >= 0) & (start + n <= F.col("n_words"))).select("doc_id", "text_key", "pos", "offset", "win", "win_words").distinct()
    found = found.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}).join(rows, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("text_key")))
    return found.where(fits & same).select(*out).distinct()


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row, and text_key."""
    windows = windows_of(items)
    found = checkpointed(occurrences(docs, windows))
    # start and n of the hits of one text: no more of them than 13 a word
    spans = F.array_sort(F.collect_set(F.struct("start", "n")))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["n"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).cast("long").alias("hit")),
        lambda a: a["hit"],
    )
    hits = found.groupBy("doc_id", "text_key").agg(covered.alias("n_hit"))
    named = found.select("doc_id", "text_key", "win").distinct().join(windows.select("win", F.col("item_id").cast("string").alias("item")).distinct(), "win")
    listed = named.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_text = hits.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}).join(listed, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("text_key"))).select("__id", "__key", "n_hit", "items")
    rows = documents_of(docs).select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    joined = rows.join(per_text, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("text_key")), "left")
    out = joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), "text_key"
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident, key = unused(docs, "id", "key")
    bad = checkpointed(judged(docs, items).where("contaminated").select(F.col("doc_id").alias(ident), F.col("text_key").alias(key)).distinct())
    return docs.join(maybe_broadcast(bad, 1_000_000), F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64(text, F.length(text)) == F.col(key)), "left_anti")
