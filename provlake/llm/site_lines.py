"""Operator 3, line dedup: site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; lines above
the boilerplate ratio go. Lines are compared without outer spaces; lines of spaces alone
are never counted or dropped. A page is a row, or (copies=False) a distinct text: then
pages with one and the same text count once, so that copies of a page do not turn its own
lines into boilerplate.

Counting is by (host, line, page) first and then by (host, line), both with partial sums:
a host with a third of all rows is spread by its lines. The dropped lines of a host go to
its pages as one array. Each dropped line is in more than `ratio` of the host's pages, so
the array has fewer than (mean lines of a page) / ratio entries.

RATIO and MIN_PAGES are those of the SQL of op3_site_relative_lines, which counts rows as
the method says: a line on one page alone is no boilerplate, however few pages the host
has. HOST_RULE, which the pipeline takes, is set from how often lines recur on a host: a
line on more than 1 % of its distinct texts goes. Two texts with one line may be two
versions of a page, so that it takes three. Passages of 50 words or more that recur over
different texts are on one or two pages of each of many hosts, so that no ratio of a host
meets them: they go wherever they stand if they are on at least 10 hosts (near copies of
one page are on up to 9 in 0.5 GB). They are not bounded by host and go to their pages.

Defined results: a null host counts as one of its own (an empty name); a null text stays
null, an empty one empty, with no lines; rows of one doc_id and text are one page, and
each gets its row; a line exactly at the ratio stays; very long texts are split into lines
and no further; an empty table gives no rows; other columns, whatever their names, are
kept by cleaned and ignored by dropped. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import maybe_broadcast
from provlake.plans.session import checkpointed

RATIO = 0.1
MIN_PAGES = 2
PASSAGE_WORDS = 50
HOST_RULE = {"ratio": 0.01, "min_pages": 3, "passage_hosts": 10, "copies": False}
BROADCAST_LINES = 500_000


def key_of(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")), F.length("text"))


def page_of(copies: bool) -> Column:
    """What tells one page of a host from another."""
    return F.xxhash64(text_key(), F.col("doc_id").cast("string")) if copies else text_key()


def host_of(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """host, lines: the hashes of each host's lines that exceed the ratio; hosts without any have no row."""
    pages = docs.select(host_of(host).alias("host"), page_of(copies).alias("page"), F.col("text").alias("text"))
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    lines = pages.select("host", "page", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    counted = lines.select("host", key_of(F.col("line")).alias("line"), "page").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counted.join(totals, "host").where(F.col("n") > F.col("total") * F.lit(ratio)).groupBy("host").agg(F.collect_list("line").alias("lines"))


def passages(docs: DataFrame, hosts: int, host: str = "source") -> DataFrame:
    """key, passages: the hashes of each text's lines of PASSAGE_WORDS words or more that are on so many hosts; texts without any have no row."""
    lines = docs.select(host_of(host).alias("host"), text_key().alias("key"), F.explode(F.split("text", "\n")).alias("line"))
    long = lines.where((F.length("line") >= 2 * PASSAGE_WORDS - 1) & (F.regexp_count("line", F.lit("[^ ]+")) >= PASSAGE_WORDS)).select("host", "key", key_of(F.col("line")).alias("line"))
    found = long.groupBy("line").agg(F.countDistinct("host").alias("n"), F.countDistinct("key").alias("texts")).where(F.least("n", "texts") >= hosts).select("line")
    return long.join(maybe_broadcast(checkpointed(found), BROADCAST_LINES), "line", "left_semi").groupBy("key").agg(F.collect_set("line").alias("passages"))


def _met(rows: DataFrame, found: DataFrame, key: str, lines: str) -> DataFrame:
    """rows with the lines found for their key; they are broadcast if they are few."""
    found = checkpointed(found)
    if (found.agg(F.sum(F.size(lines))).first()[0] or 0) <= BROADCAST_LINES:
        found = F.broadcast(found)
    return rows.join(found, key, "left")


def _judged(docs: DataFrame, host: str, ratio: float, min_pages: int, passage_hosts: int | None, copies: bool) -> DataFrame:
    """row (all columns of docs), text, all (the lines) and kept (those that stay)."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), host_of(host).alias("host"), text_key().alias("key"))
    joined = _met(rows, boilerplate(docs, host, ratio, min_pages, copies), "host", "lines")
    gone = F.col("lines")
    if passage_hosts is not None:
        none = F.array().cast("array<bigint>")
        joined = _met(joined, passages(docs, passage_hosts, host), "key", "passages")
        gone = F.when(F.coalesce("lines", "passages").isNotNull(), F.concat(F.coalesce("lines", none), F.coalesce("passages", none)))
    joined = joined.select("row", "text", gone.alias("gone"), F.split("text", "\n").alias("all"))
    stays = lambda x: (F.trim(x) == "") | ~F.array_contains("gone", key_of(x))
    return joined.withColumn("kept", F.when(F.col("gone").isNotNull(), F.filter("all", stays)).otherwise(F.col("all")))


def cleaned(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, passage_hosts: int | None = None, copies: bool = True) -> DataFrame:
    """docs, the same columns, with text rid of boilerplate lines."""
    return _judged(docs, host, ratio, min_pages, passage_hosts, copies).select(*[F.array_join("kept", "\n").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def dropped(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, passage_hosts: int | None = None, copies: bool = True) -> DataFrame:
    """doc_id, host, text rid of boilerplate lines, n_lines (lines not blank) and n_dropped (of these, lines dropped)."""
    solid = F.coalesce(F.size(F.filter("all", lambda x: F.trim(x) != "")), F.lit(0))
    n = lambda c: F.when(F.col("text").isNull(), 0).otherwise(c).cast("long")
    out = _judged(docs.select("doc_id", host, "text"), host, ratio, min_pages, passage_hosts, copies)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row")[host].alias(host), F.array_join("kept", "\n").alias("text"), n(solid).alias("n_lines"), n(F.size("all") - F.size("kept")).alias("n_dropped"))
