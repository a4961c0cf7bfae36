"""Content acquisition (E): text from HTML, validation, fingerprints, lifecycle."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions import rules
from provlake.functions.text import word_count

ELEMENTS = "|".join(rf"<{e}(?:\s[^>]*)?>.*?</{e}\s*>" for e in rules.DROPPED_ELEMENTS)
DROPPED = rf"(?is)<!--.*?-->|<!doctype[^>]*>|{ELEMENTS}"
TAG = r"(?s)<[^>]*>"
#: named entities that are text
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
MIN_WORDS = 30


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>([^<]*)</title>", 1))


def html_text(html: Column) -> Column:
    """Text of a page: eight kinds of elements dropped, a line for each run of text, no blank ones (E1, native form)."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), DROPPED, ""), TAG, "\n")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = F.regexp_replace(out, r"[ \t\r]*(?:\n|  )[ \t\r\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"^[ \t\r\n]+", ""), r"[ \t\r\n]+$", "")


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in rules.DROPPED_ELEMENTS

    def handle_endtag(self, tag):
        self.depth -= tag in rules.DROPPED_ELEMENTS and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def parsed_text(html: str | None) -> str:
    """The same with an HTML parser, entities and unclosed elements included."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    lines = (p.strip() for line in "\n".join(reader.out).splitlines() for p in line.split("  "))
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, mode: str = "native") -> DataFrame:
    """Adds title (else the url) and content to pages(url, html)."""
    titled = pages.withColumn("title", F.coalesce(F.nullif(html_title(F.col("html")), F.lit("")), F.col("url")))
    if mode == "native":
        return titled.withColumn("content", html_text(F.col("html")))

    @F.pandas_udf("string")
    def read(html: pd.Series) -> pd.Series:
        return html.map(parsed_text)

    return titled.withColumn("content", read("html"))


def validate_content(text: Column, min_words: int = MIN_WORDS) -> Column:
    """struct(valid, reason): empty, too short, an error or login page, or valid."""
    text = F.coalesce(text, F.lit(""))
    n = word_count(text)
    head = F.lower(F.substring(text, 1, 500))
    reason = (
        F.when(n == 0, F.lit("empty_content"))
        .when(n < min_words, F.concat(F.lit("insufficient_content ("), n.cast("string"), F.lit(f" words < {min_words})")))
        .when(head.rlike("|".join(rules.ERROR_PAGE_PHRASES)), "error_or_login_page")
        .otherwise("valid")
    )
    return F.struct((reason == "valid").alias("valid"), reason.alias("reason"))


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds content_hash (SHA-256) and word_count."""
    return df.withColumns({"content_hash": F.sha2(F.coalesce(text, F.lit("")), 256), "word_count": word_count(F.col(text)).cast("long")})


def dup_content(df: DataFrame, ident: str = "doc_id") -> DataFrame:
    """content_hash, first id and number of rows of each content held more than once."""
    return df.groupBy("content_hash").agg(F.min(ident).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def failure_type(http_status: Column, error: Column) -> Column:
    """timeout, connection_error or http_error of a fetch that failed."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return F.when(http_status.isNull() & low.contains("timeout"), "timeout").when(http_status.isNull() & low.contains("connect"), "connection_error").otherwise("http_error")


def retryable(http_status: Column) -> Column:
    """Whether a second attempt is made."""
    return http_status.isNull() | ~http_status.isin(401, 403, 404, 410, 429)


def fetch_outcome(sources: DataFrame, snapshots: DataFrame, key: str = "url") -> DataFrame:
    """Each source with its state: EVIDENCE_ELIGIBLE with content, else FETCH_FAILED with a reason and none (E5).

    snapshots(url, http_status, content, failure_type). A 2xx answer whose content was
    refused is named by its failure type.
    """
    return with_outcome(sources.join(snapshots, key, "left"))


def with_outcome(both: DataFrame) -> DataFrame:
    """The states of sources that have met their snapshots already, in a batch or in a stream (E5)."""
    ok = F.coalesce(F.col("failure_type").isNull() & (F.trim(F.coalesce("content", F.lit(""))) != ""), F.lit(False))
    refused = F.upper(F.coalesce("failure_type", F.lit("empty_content")))
    code = F.col("http_status")
    reason = F.when(ok, F.lit(None)).when(code.isNotNull() & ~code.between(200, 299), F.concat(F.lit("HTTP_"), code.cast("string"))).otherwise(F.concat(F.lit("FETCH_FAILED_"), refused))
    return both.withColumns({"lifecycle_state": F.when(ok, "EVIDENCE_ELIGIBLE").otherwise("FETCH_FAILED"), "state_reason": reason, "content": F.when(ok, F.col("content")).otherwise("")})


def eligible(sources: DataFrame, outcomes: DataFrame, key: str = "url") -> DataFrame:
    """Sources whose fetch gave evidence."""
    return sources.join(outcomes.where("lifecycle_state = 'EVIDENCE_ELIGIBLE'").select(key), key, "left_semi")


def lifecycle_status(state: Column, extraction: Column) -> Column:
    """The state shown for a source: its own, else derived from the extraction."""
    return F.coalesce(F.upper(state), F.when(extraction == "completed", "EVIDENCE_ELIGIBLE").when(extraction == "failed", "FETCH_FAILED").otherwise("DISCOVERED"))


def lifecycle_breakdown(df: DataFrame, key: str, state: str = "lifecycle_state", reason: str = "state_reason") -> DataFrame:
    """Rows by state and reason of each key."""
    return df.groupBy(key, state, reason).agg(F.count("*").alias("n"))
