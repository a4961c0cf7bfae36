"""Operator 4, quality rules: a decision list learnt by sequential covering.

Statistics of each text are compared with thresholds. Labelled statistics (a bounded
sample, without texts that fail the base rules anyway) are split in two: a rule, a conjunction of thresholds, grows on the first part by
information gain and is pruned on the second by precision; the texts it covers leave, and
the next rule is learnt from the rest. Every value between two others is tried as a
threshold, and a hash of its id says which part a text is in, so that the rules do not
depend on how rows are ordered or dealt. The list is emitted as ordered Spark conditional
expressions, so that judging all texts is one projection.

Defined results: a null or empty text has no words and fails the base rules; null labels
are not learnt from; repeated rows each get their row; without labels of both kinds the
list is empty and the base rules alone decide; of conditions with equal gain the first
counts, of labels of one id the lowest; very long texts are taken whole; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import bounded_batches
from provlake.llm._text import SAME, Tokens, batches_of

MAX_LABELLED = 20_000
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
MIN_PRECISION = 0.8
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_exclaims", "n_stops"]
#: the statistics that rules compare, as Spark expressions over the counts
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaims / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
}
_LINE = np.zeros(256, dtype=bool)
_LINE[10] = True


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_COUNTED = {"n_symbols": _table(SYMBOLS), "n_upper": _table(bytes(range(65, 91))), "n_digits": _table(bytes(range(48, 58))), "n_exclaims": _table(b"!"), "n_stops": _table(b".")}


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    words = Tokens(column, fold=SAME)
    n, raw, offsets = words.docs, words.raw, words.offsets

    def per_text(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out = {k: per_text(t[raw]) for k, t in _COUNTED.items()}
    out["n_words"] = words.n.astype(np.int64)
    white = np.zeros(256, dtype=np.int64)
    white[[9, 10, 11, 12, 13, 32]] = 1
    out["word_chars"] = per_text((raw & 0xC0) != 0x80) - per_text(white[raw])

    lines = Tokens(column, fold=SAME, separator=_LINE)
    solid = np.concatenate(([0], np.cumsum(1 - white[raw])))
    with_word = solid[lines.end] > solid[lines.start]
    doc, h = lines.doc[with_word], lines.h[with_word]
    out["n_lines"] = np.bincount(doc, minlength=n)
    order = np.lexsort((h, doc))
    again = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][again], minlength=n)

    doc, h = words.grams(REPEAT_WINDOW)
    at = words.first[doc] + (np.arange(len(doc)) - np.searchsorted(doc, doc))  # word at which each window begins
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(doc), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.h) + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + REPEAT_WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    out["n_repeat_words"] = np.bincount(words.doc[covered], minlength=n)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches):
        for batch in batches_of(batches, "text"):
            c = counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c[k].astype(np.int64)) for k in COUNTS]], names=["doc_id", *COUNTS])

    return rows.mapInArrow(run, schema)


Condition = tuple[str, str, float]  # statistic, ">=" or "<", threshold


def _matches(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for name, sign, t in rule:
        v = x[:, names.index(name)]
        hit &= v >= t if sign == ">=" else v < t
    return hit


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int) -> list[Condition]:
    """Adds the condition of most information gain until only wanted rows are left."""
    rule: list[Condition] = []
    live = np.ones(len(x), dtype=bool)
    while len(rule) < most and (~y[live]).any():
        p0, n0 = int(y[live].sum()), int((~y[live]).sum())
        if not p0:
            break
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            v, t = x[live, j], y[live]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            below_p, below = np.cumsum(t)[cut - 1], cut
            for sign, p, n in (("<", below_p, below - below_p), (">=", p0 - below_p, n0 - (below - below_p))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                k = int(np.argmax(g))
                if g[k] > gain:
                    gain, best = g[k], (name, sign, float((v[cut[k]] + v[cut[k] - 1]) / 2))
        if best is None:
            break
        rule.append(best)
        live &= _matches(x, names, [best])
    return rule


def _prune(rule: list[Condition], x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Condition]:
    """The beginning of the rule that does best on rows it did not grow on."""

    def worth(k: int) -> float:
        hit = _matches(x, names, rule[:k])
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def learn(x: np.ndarray, low: np.ndarray, names: list[str], deal: np.ndarray, max_rules: int = 16, max_conditions: int = 4, min_precision: float = MIN_PRECISION) -> list[list[Condition]]:
    """Ordered rules, each of which says that a text is of low quality; deal: the third (0 to 2) that each row is in."""
    rules: list[list[Condition]] = []
    live = np.ones(len(x), dtype=bool)
    for k in range(max_rules):
        rows = np.flatnonzero(live)
        growing = deal[rows] != k % 3  # another third is set aside for each rule
        grow, prune = rows[growing], rows[~growing]
        if not low[grow].any() or not (~low[grow]).any():
            break
        rule = _grow(x[grow], low[grow], names, max_conditions)
        if not rule:
            break
        rule = _prune(rule, x[prune], low[prune], names) if len(prune) else rule
        hit = live & _matches(x, names, rule)
        right = int(low[hit].sum())
        aside = _matches(x[prune], names, rule)
        if right < 2 or right < min_precision * hit.sum() or low[prune][aside].sum() < min_precision * aside.sum():
            break
        rules.append(rule)
        live &= ~hit
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """True for texts that no rule calls low: CASE WHEN rule 1 THEN false WHEN rule 2 ... ELSE true."""
    out = None
    for rule in rules:
        test = " and ".join(f"{FEATURES[name]} {sign} {t!r}D" for name, sign, t in rule)
        out = F.when(F.expr(test), False) if out is None else out.when(F.expr(test), False)
    return F.lit(True) if out is None else out.otherwise(True)


BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """Learns from at most max_labelled labelled ids, chosen by a hash, as far as their texts pass the base rules."""
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(4))
    known = labels.where("doc_id is not null and quality is not null")
    n = known.count()
    if n > 2 * max_labelled:  # so that few are ever sorted
        known = known.where(order < -(2**63) + int(2**64 * 1.5 * max_labelled / n))
    chosen = F.broadcast(known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(max_labelled))  # max_labelled rows
    sample = statistics(docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id")).where(~F.expr(BASE_FAILED))
    third = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(3)).alias("third")
    x = sample.join(chosen, "doc_id").select("quality", third, *[F.expr(e).alias(n) for n, e in FEATURES.items()]).toPandas()
    return learn(x[list(FEATURES)].to_numpy(dtype=float), (x.quality == 0).to_numpy(), list(FEATURES), x.third.to_numpy())


def judged(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every text."""
    rules = fit(docs, labels, max_labelled)
    out = statistics(docs).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & expression(rules))
