"""Operator 13, phrase collocations by stripes.

A stripe belongs to a prefix of words: it counts the words that follow it. Stripes of
prefixes of 0 to 4 words are built level by level. Tasks add up stripes in a table of
bounded size, equal prefixes meet by a shuffle of whole stripes, and are merged
elementwise. A merged stripe holds the frequent extensions of its prefix, the prefix's own
number of occurrences (its sum, for which occurrences without a frequent extension are
counted under an empty word), and its largest extension, which tells whether the prefix
is subsumed. The stripe of a prefix with a thousandth of all words or more is cut by
hashes of the next word, so that many tasks merge it.

A phrase can be frequent only if both phrases left by cutting its first or last word are.
Which those are is told to the next level by a table of 2**26 bits, so that what is sent
does not grow; a bit set by another phrase costs a count more and changes no result.

Defined results: a null text is an empty one; a null language is `und`; repeated rows
count each; ties in rank go by a, then phrase; an empty table gives no rows; other
columns are ignored. Long texts are taken whole; a task holds some bytes for each byte of
its longest text. Phrases meet as texts; only within a task are they told apart by a
fingerprint of 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlake.llm._spark import bounded_batches, maybe_broadcast
from provlake.llm._text import LOWER, Tokens, batches_of, joined, mix
from provlake.plans.session import shared_folder

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: bits of the table of frequent phrases, and of one part of it
BITS, PART = 1 << 26, 1 << 19
#: entries of a task's table, and words of its vocabulary
HELD, WORDS = 2_000_000, 2_000_000
#: parts of the stripe of a hot prefix: the empty one, and those with at least a HOT-th of all words, of which there are HOT at most
PARTS, HOT = 64, 1000
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True
#: languages of the rows that are counted here: their number is small
MAX_LANGS = 100_000
#: stripes travel in rows by hashes of their prefixes
BUCKETS = 2048
#: words and counts of a stripe are joined by spaces
SCHEMA = "bucket int, langs array<string>, prefixes array<string>, words array<string>, counts array<string>"


def _lang_print(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Known:
    """Places of 64-bit keys in the order in which they came."""

    def __init__(self):
        self.keys, self.order = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is new); new keys get the next places."""
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), dtype=bool)
        place = np.empty(len(distinct), dtype=np.int64)
        place[~new] = self.order[at[~new]]
        place[new] = np.arange(len(self.keys), len(self.keys) + int(new.sum()))
        if new.any():
            keys = np.concatenate((self.keys, distinct[new]))
            sort = np.argsort(keys, kind="stable")
            self.keys, self.order = keys[sort], np.concatenate((self.order, place[new]))[sort]
        return place, new


class Stripes:
    """A task's stripes: entries (language, prefix, next word) with their counts."""

    def __init__(self, level: int):
        self.level, self.langs = level, {}
        self.clear()
        self.forget()

    def clear(self) -> None:
        self.known, self.counts = Known(), np.zeros(0, dtype=np.int64)
        self.prefix, self.bucket, self.lang = (np.zeros(0, dtype=k) for k in (np.uint64, np.int32, np.int32))
        self.ids = np.zeros((0, self.level), dtype=np.int32)

    def forget(self) -> None:
        """Place 0 is no word."""
        self.vocabulary, self.words = Known(), [""]

    def add(self, keys: np.ndarray, entries) -> None:
        """Counts entries by fingerprint; entries(places) gives language, word fingerprints (0: none), spelling of a word by row and column, prefix fingerprint and bucket."""
        distinct, first, n = np.unique(keys, return_index=True, return_counts=True)
        place, new = self.known.find(distinct)
        self.counts[place[~new]] += n[~new]
        if not new.any():
            return
        lang, prints, spelled, prefix, bucket = entries(first[new])
        self.counts = np.concatenate((self.counts, n[new]))
        self.prefix, self.bucket = np.concatenate((self.prefix, prefix)), np.concatenate((self.bucket, bucket.astype(np.int32)))
        self.lang = np.concatenate((self.lang, np.array([self.langs.setdefault(x, len(self.langs)) for x in lang], dtype=np.int32)))
        words, at, back = np.unique(prints, return_index=True, return_inverse=True)
        real = words != 0
        ids = np.zeros(len(words), dtype=np.int64)
        where, unseen = self.vocabulary.find(words[real])
        ids[real] = where + 1
        self.words += [spelled(*divmod(x, self.level)) for x in at[real][unseen].tolist()]
        self.ids = np.concatenate((self.ids, ids[back].reshape(-1, self.level).astype(np.int32)))

    def full(self) -> bool:
        return len(self.counts) >= HELD or len(self.words) >= WORDS

    def rows(self):
        """The stripes, those of a bucket in one row; the table is empty afterwards."""
        if len(self.counts):
            sort = np.lexsort((self.prefix, self.bucket))
            prefix, bucket = self.prefix[sort], self.bucket[sort]
            start = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (bucket[1:] != bucket[:-1]))))
            first = np.flatnonzero(np.concatenate(([True], bucket[start[1:]] != bucket[start[:-1]])))  # stripe of each bucket
            vocabulary, langs = pa.array(self.words, type=pa.string()), pa.array(list(self.langs), type=pa.string())
            start, first = np.append(start, len(sort)), np.append(first, len(start))
            for at in range(0, len(first) - 1, 64):
                rows = first[at : at + 65]
                stripe = start[rows[0] : rows[-1] + 1]
                some, heads = sort[stripe[0] : stripe[-1]], sort[stripe[:-1]]
                inner, outer = pa.array(stripe - stripe[0], type=pa.int32()), pa.array(rows - rows[0], type=pa.int32())
                before = [vocabulary.take(pa.array(self.ids[heads, k])) for k in range(self.level - 1)]
                prefixes = pc.binary_join_element_wise(*before, " ") if before else pa.array([""] * len(heads), type=pa.string())
                words = pc.binary_join(pa.ListArray.from_arrays(inner, vocabulary.take(pa.array(self.ids[some, -1]))), " ")
                counts = pc.binary_join(pa.ListArray.from_arrays(inner, pc.cast(pa.array(self.counts[some]), pa.string())), " ")
                lists = [pa.ListArray.from_arrays(outer, x) for x in (langs.take(pa.array(self.lang[heads])), prefixes, words, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(self.bucket[sort[start[rows[:-1]]]]), *lists], names=[x.split()[0] for x in SCHEMA.split(", ")])
            self.clear()
        if len(self.words) >= WORDS:
            self.forget()


class Phrases:
    """The words of a batch of texts, and which of them follow each other within a piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        self.t = t = Tokens(text, fold=LOWER, separator=_APART)
        breaks = np.concatenate(([0], np.cumsum(_BREAK[t.raw])))
        self.follows = (t.doc[1:] == t.doc[:-1]) & (breaks[t.start[1:]] == breaks[t.end[:-1]]) if len(t.h) else np.zeros(0, dtype=bool)
        self.langs = ["und" if x is None else x for x in lang.to_pylist()]
        prints = {x: _lang_print(x) for x in set(self.langs)}
        self.lang_print = np.array([prints[x] for x in self.langs], dtype=np.uint64)[t.doc]

    def valid(self, n: int) -> np.ndarray:
        """Where n words stand in a row within a piece."""
        ok = np.ones(max(0, len(self.t.h) - n + 1), dtype=bool)
        for k in range(n - 1):
            ok &= self.follows[k : k + len(ok)]
        return ok

    def prints(self, n: int) -> np.ndarray:
        """A fingerprint of n words from each word on, language included."""
        m = max(0, len(self.t.h) - n + 1)
        return joined([self.lang_print[:m], *(self.t.h[k : k + m] for k in range(n))])

    def word(self, at: int) -> str:
        return self.t.raw[self.t.start[at] : self.t.end[at]].tobytes().decode()


def _set(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def stripes(docs: DataFrame, level: int, frequent, hot: np.ndarray) -> DataFrame:
    """The stripes of prefixes of level - 1 words, by buckets; frequent: a broadcast table of bits, none at level 1; hot: fingerprints of hot prefixes, in order."""

    def run(batches):
        table = Stripes(level)
        for batch in batches_of(batches, "text", 1 << 20):
            p = Phrases(batch.column(1), batch.column(0))
            t, n = p.t, level - 1
            if not len(t.h):
                continue
            if level == 1:
                prefix, whole = np.arange(len(t.h)), np.ones(len(t.h), dtype=bool)
                prints, prefix_prints = p.prints(1), joined([p.lang_print])
            else:
                bits = np.frombuffer(frequent.value, dtype=np.uint8)
                shorter = p.prints(n)
                good = p.valid(n) & _set(bits, shorter)
                prefix = np.flatnonzero(good)
                ok = np.zeros(len(good), dtype=bool)
                longer = p.valid(level)
                ok[: len(longer)] = longer & good[1 : len(longer) + 1]
                whole, prefix_prints = ok[prefix], shorter[prefix]
                every = np.append(p.prints(level), np.zeros(1, dtype=np.uint64))  # the last prefix has no next word
                prints = np.where(whole, every[prefix], joined([prefix_prints, np.zeros(len(prefix), dtype=np.uint64)]))

            def entries(i, p=p, prefix=prefix, whole=whole, prefix_prints=prefix_prints):
                last = len(p.t.h) - 1
                places = np.minimum(prefix[i][:, None] + np.arange(level), last)
                words = p.t.h[places]
                words[~whole[i], -1] = 0
                split = np.ones(len(i), dtype=bool) if level == 1 else np.isin(prefix_prints[i], hot)
                part = np.where(split, words[:, -1] % np.uint64(PARTS), np.uint64(0))
                bucket = mix(prefix_prints[i] ^ part) % np.uint64(BUCKETS)
                return [p.langs[k] for k in p.t.doc[prefix[i]].tolist()], words, lambda r, c: p.word(places[r, c]), prefix_prints[i], bucket

            table.add(prints, entries)
            if table.full():
                yield from table.rows()
        yield from table.rows()

    return docs.mapInArrow(run, SCHEMA)


def merged(some: DataFrame, least: int) -> DataFrame:
    """Equal prefixes' stripes, elementwise: total, largest extension, and the extensions that are frequent."""
    stripe = lambda s: F.transform(F.arrays_zip(F.split(s["words"], " ").alias("word"), F.split(s["counts"], " ").alias("f")), lambda e: F.struct(s["langs"].alias("lang"), s["prefixes"].alias("prefix"), e["word"].alias("word"), e["f"].cast("long").alias("f")))
    packed = F.arrays_zip("langs", "prefixes", "words", "counts")
    each = some.repartition("bucket").select("bucket", F.explode(F.flatten(F.transform(packed, stripe))).alias("e")).select("bucket", "e.*")
    entries = each.groupBy("bucket", "lang", "prefix", "word").agg(F.sum("f").alias("f"))
    real = F.when((F.col("word") != "") & (F.col("f") >= least), F.struct("word", "f"))
    return entries.groupBy("bucket", "lang", "prefix").agg(F.sum("f").alias("total"), F.max(F.when(F.col("word") != "", F.col("f"))).alias("most"), F.collect_list(real).alias("frequent"))


def _table_of(phrases: DataFrame, words: int) -> bytes | None:
    """The table of bits of these phrases; none if there are none."""

    def places(batches):
        for batch in batches:
            p = Phrases(batch.column(1), batch.column(0))
            at = p.prints(words)[p.t.first[:-1]] & np.uint64(BITS - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(PART)).astype(np.int32)), pa.array((at % np.uint64(PART)).astype(np.int32))], names=["part", "bit"])

    def filled(group):
        bits = np.zeros(PART // 8, dtype=np.uint8)
        at = np.asarray(group.column("bit").combine_chunks())
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"part": group.column("part")[:1], "bits": pa.array([bits.tobytes()])})

    found = phrases.select("lang", "phrase").mapInArrow(places, "part int, bit int").distinct().groupBy("part").applyInArrow(filled, "part int, bits binary")
    out, any_row = bytearray(BITS // 8), False
    for r in found.collect():  # at most BITS / PART rows of PART / 8 bytes
        any_row = True
        out[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = r["bits"]
    return bytes(out) if any_row else None


def levels(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT) -> list[DataFrame]:
    """The merged stripes of prefixes of 0, 1, ... words, written to the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder, bits, hot, out = shared_folder(spark, "stripes"), None, np.zeros(0, dtype=np.uint64), []
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for level in range(1, max_words + 1):
        merged(stripes(texts, level, bits, hot), least).write.parquet(f"{folder}/{level}")
        out.append(spark.read.parquet(f"{folder}/{level}"))
        if level < max_words:
            table = _table_of(phrases(out[-1]), level)
            if table is None:
                break
            bits = spark.sparkContext.broadcast(table)
            n = out[0].agg(F.sum("total")).first()[0]
            often = phrases(out[-1]).where(F.col("a") * HOT >= n).toArrow().combine_chunks()  # HOT rows at most
            if often.num_rows:
                found = Phrases(often.column("phrase").combine_chunks(), often.column("lang").combine_chunks())
                hot = np.sort(found.prints(level)[found.t.first[:-1]])
            else:
                hot = np.zeros(0, dtype=np.uint64)
    return out


def phrases(level: DataFrame) -> DataFrame:
    """(lang, phrase, a): prefixes with their frequent next words."""
    each = level.select("lang", "prefix", F.explode("frequent").alias("e"))
    return each.select("lang", F.when(F.col("prefix") == "", F.col("e.word")).otherwise(F.concat_ws(" ", "prefix", "e.word")).alias("phrase"), F.col("e.f").alias("a"))


def mined(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The first phrases of each language by their lowest-scoring cut."""
    found = levels(docs, max_words, least)
    every = found[1] if len(found) > 1 else found[0].limit(0)
    for x in found[2:]:
        every = every.unionByName(x)
    n = found[0].groupBy("lang").agg(F.sum("total").alias("n"))
    prefixes = every.groupBy("lang", "prefix").agg(F.sum("total").alias("total"), F.max("most").alias("most")).where(F.col("total") >= least)
    grams = phrases(every)
    words = F.split("phrase", " ")
    left = grams.groupBy("lang", F.array_join(F.slice(words, 2, max_words), " ").alias("phrase")).agg(F.max("a").alias("left_most"))
    right = prefixes.select("lang", F.col("prefix").alias("phrase"), F.col("most").alias("right_most"))
    alone = grams.join(right, ["lang", "phrase"], "left").join(left, ["lang", "phrase"], "left")
    alone = alone.where(F.greatest(F.coalesce("right_most", F.lit(0)), F.coalesce("left_most", F.lit(0))) < F.col("a")).select("lang", "phrase", "a")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("head"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("rest"))))
    cuts = alone.select("lang", "phrase", "a", cut.alias("c")).select("lang", "phrase", "a", "c.*")
    f = prefixes.select("lang", F.col("prefix").alias("head"), F.col("total").alias("l"))
    cuts = cuts.join(f, ["lang", "head"]).join(f.withColumnsRenamed({"head": "rest", "l": "r"}), ["lang", "rest"]).join(maybe_broadcast(n, MAX_LANGS), "lang")
    exact = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    scored = cuts.withColumn("up", F.lit(1000).cast("decimal(38,0)") * exact["a"] * exact["n"]).withColumn("low", exact["l"] * exact["r"]).withColumn("score", F.expr("up div low"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
