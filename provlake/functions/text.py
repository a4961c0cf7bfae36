"""Text functions: Column in, Column out, all of them Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlake.functions import rules

WORD = "([a-z0-9]+)"
#: an edge of a word of ASCII letters, digits and _, as engines without look-around have it
START, STOP = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: fixed values: what counts as a number, a range, a percentage, an amount of money or a ratio
NUMBER = r"(?i)(?:\$\s*[\d,.]+(?:\s*(?:billion|million|trillion|k|m|b))?|\b\d+(?:[.,]\d+)?\s*(?:%|percent|x|months?|years?|weeks?|days?|hours?|bps)?)"
PLAIN_NUMBER = r"\b\d+(?:\.\d+)?\b"
RANGE = r"(?i)(\d+(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d+(?:\.\d+)?)\s*(%|percent|x|billion|million|trillion|k|m|b|months?|years?|weeks?|days?|hours?)?"
PERCENTAGE = r"(?i)(\d+(?:\.\d+)?)\s*(%|percent|percentage\s+points?|bps)"
CURRENCY = r"(?i)(\$|€|£|¥)\s*(\d+(?:,\d+)*(?:\.\d+)?)\s*(billion|million|trillion|k|m|b)?"
RATIO = r"(?i)(\d+:\d+)\s*(?:to\s*(\d+:\d+))?"


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)


def tokens(text: Column, more_than: int = 2, stop_words=rules.STOP_WORDS) -> Column:
    """Distinct words in order, without stop words, longer than so many characters."""
    return F.filter(F.array_except(words(F.coalesce(text, F.lit(""))), literal_array(stop_words)), lambda w: F.length(w) > more_than)


def key_concepts(text: Column, n: int = 10) -> Column:
    """Capitalised phrases, acronyms, hyphenated compounds, then content words: distinct, in order, n at most."""
    text = F.coalesce(text, F.lit(""))
    low = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    phrases = F.filter(low(F.regexp_extract_all(text, F.lit(rf"{START}([A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)+){STOP}"), 1)), lambda x: F.length(x) > 3)
    acronyms = F.filter(low(F.regexp_extract_all(text, F.lit(rf"{START}([A-Z]{{2,6}}){STOP}"), 1)), lambda x: ~x.isin(rules.STOP_WORDS))
    compounds = low(F.regexp_extract_all(text, F.lit(rf"{START}([a-zA-Z0-9]+-[a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*){STOP}"), 1))
    return F.slice(F.array_distinct(F.concat(phrases, acronyms, compounds, tokens(text, 2))), 1, n)


def numbers(text: Column) -> Column:
    """Numbers, money, percentages and units: in lower case, without spaces or a trailing point or comma."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), 0)
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", ""), "[.,]+$", ""))


def numeric_claims(text: Column) -> Column:
    """struct of the ranges, percentages, currencies and ratios in a text."""
    return F.struct(*[F.regexp_extract_all(text, F.lit(p), 0).alias(n) for n, p in (("ranges", RANGE), ("percentages", PERCENTAGE), ("currencies", CURRENCY), ("ratios", RATIO))])


#: fixed values: what is cut from a statement's start, the signs that stay in it, and what a token of it is
LEADING = r"^[\s\d\-.*•\"'\[\]()]+"
OTHER_SIGNS = r"[^\p{L}\p{N}_\s%$\-:]"
STATEMENT_TOKEN = r"([a-z0-9%$:\-]+)"


def normalize_statement(text: Column) -> Column:
    """Lower case, without leading bullets and digits, hedging phrases and other signs than % $ - :"""
    out = F.regexp_replace(F.trim(F.lower(text)), LEADING, "")
    for hedge in rules.HEDGES:
        out = F.trim(F.regexp_replace(out, rf"^{hedge}\s+", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, OTHER_SIGNS, " "), r"\s+", " "))


def stem(word: Column) -> Column:
    out = None
    for s in rules.STEM_SUFFIXES:
        cut = F.substring(word, F.lit(1), F.length(word) - len(s))
        test = (F.length(word) > 4) & word.endswith(s)
        out = F.when(test, cut) if out is None else out.when(test, cut)
    return out.otherwise(word)


def statement_tokens(text: Column) -> Column:
    """Distinct stemmed content words of a statement."""
    found = F.regexp_extract_all(normalize_statement(text), F.lit(STATEMENT_TOKEN), 1)
    kept = F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(rules.STOP_WORDS))
    return F.array_distinct(F.transform(kept, stem))


def clean_query(text: Column) -> Column:
    """A question without conversational beginnings, end marks and special signs; 90 characters at most, cut at a word."""
    out = text
    for prefix in rules.QUESTION_PREFIXES:
        out = F.trim(F.regexp_replace(out, rf"(?i)^{prefix}\s+", ""))
        out = F.trim(F.regexp_replace(out, rf"(?i),?\s*{prefix}\s+", " "))
    out = F.trim(F.regexp_replace(out, "[?!]+$", ""))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s\-']", " "), r"\s+", " "))
    out = F.when(F.length(out) > 90, F.regexp_replace(F.substring(out, 1, 90), " [^ ]*$", "")).otherwise(out)
    return F.when(F.length(out) >= 5, out).otherwise(F.substring(text, 1, 90))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^ \t\r\n]+)"), 1))
