"""Contradictions and conclusions (G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.functions.text import numbers
from provlake.operators.questions import geographies, years

SEVERITY = {"high": 3, "medium": 2, "low": 1}
#: (category, severity, cue pattern) tried in this order after numbers, regions and years
CUES = [("DEFINITION_DIFFERENCE", "low", "defin|meaning|refers to"), ("METHODOLOGY_DIFFERENCE", "low", "method|survey|sample|measur"), ("FORECAST_DIFFERENCE", "medium", "forecast|project|expect|predict")]


def statement_map(claims: DataFrame, run: str = "run_id") -> DataFrame:
    """run, statement, claim_id: where a statement leads; the latest write wins (G1). claims(run, claim_id, seq, statement, merged_statements)."""
    every = claims.select(run, "claim_id", "seq", F.explode(F.array_distinct(F.concat(F.array("statement"), F.coalesce("merged_statements", F.array().cast("array<string>"))))).alias("statement"))
    return every.groupBy(run, "statement").agg(F.max_by("claim_id", F.struct("seq", "claim_id")).alias("claim_id"))


def link_contradictions(candidates: DataFrame, table: DataFrame, run: str = "run_id") -> DataFrame:
    """Candidates whose two statements lead to different claims, with the claims."""
    side = lambda s: table.select(run, F.col("statement").alias(f"statement_{s}"), F.col("claim_id").alias(f"claim_{s}"))
    found = candidates.join(side("a"), [run, "statement_a"]).join(side("b"), [run, "statement_b"]).where("claim_a <> claim_b")
    return found.withColumns({"category": F.coalesce("category", F.lit("DIRECT_CONTRADICTION")), "severity": F.coalesce("severity", F.lit("medium"))})


def traits(text: Column) -> Column:
    """struct of what conflict() compares of a claim: regions, years, other numbers, and whether each cue is there."""
    plain = F.filter(numbers(text), lambda x: ~x.rlike("^20[2-5][0-9]$"))
    cues = F.array(*[F.lower(text).rlike(pattern) for _, _, pattern in CUES])
    return F.struct(geographies(text).alias("regions"), years(text).alias("years"), plain.alias("numbers"), cues.alias("cues"))


def conflict(a: Column, b: Column, type_a: Column, type_b: Column) -> Column:
    """struct(category, severity) of two claims on one topic, or null: one category, the first that fits."""
    return traits_conflict(traits(a), traits(b), type_a, type_b)


def traits_conflict(a: Column, b: Column, type_a: Column, type_b: Column) -> Column:
    """conflict() of claims by their traits, which are read off a claim once, not once a pair."""
    other = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)) > 0)
    out = (
        F.when(other(a["regions"], b["regions"]), F.struct(F.lit("SCOPE_DIFFERENCE").alias("category"), F.lit("low").alias("severity")))
        .when(other(a["years"], b["years"]), F.struct(F.lit("TIME_PERIOD_DIFFERENCE").alias("category"), F.lit("low").alias("severity")))
        .when(other(a["numbers"], b["numbers"]) & ~F.arrays_overlap(a["numbers"], b["numbers"]), F.struct(F.lit("DIRECT_CONTRADICTION").alias("category"), F.lit("high").alias("severity")))
    )
    for k, (category, severity, _) in enumerate(CUES):
        out = out.when(a["cues"][k] != b["cues"][k], F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    tension = ((type_a == "fact") & (type_b == "risk")) | ((type_a == "risk") & (type_b == "fact"))
    return out.when(tension, F.struct(F.lit("CONTEXTUAL_TENSION").alias("category"), F.lit("medium").alias("severity")))


def detect_contradictions(pairs: DataFrame, claims: DataFrame, run: str = "run_id") -> DataFrame:
    """run, id_a, id_b, category, severity of same-topic pairs(run, id_a, id_b) that conflict (G3). claims(run, claim_id, statement, finding_type)."""
    side = lambda s: claims.select(run, F.col("claim_id").alias(f"id_{s}"), traits(F.col("statement")).alias(f"s_{s}"), F.col("finding_type").alias(f"t_{s}"))
    both = pairs.join(side("a"), [run, "id_a"]).join(side("b"), [run, "id_b"])
    found = both.withColumn("c", traits_conflict(F.col("s_a"), F.col("s_b"), F.col("t_a"), F.col("t_b"))).where("c is not null")
    return found.select(run, "id_a", "id_b", "c.category", "c.severity")


def contradiction_mix(contradictions: DataFrame, run: str = "run_id") -> DataFrame:
    """Contradictions by category of each run."""
    return contradictions.groupBy(run, "category").agg(F.count("*").alias("n"))


def contradiction_view(contradictions: DataFrame, claims: DataFrame) -> DataFrame:
    """Contradictions with both statements, null where a claim is missing."""
    side = lambda s: claims.select(F.col("claim_id").alias(f"id_{s}"), F.col("statement").alias(f"statement_{s}"))
    return contradictions.join(side("a"), "id_a", "left").join(side("b"), "id_b", "left")


def claim_conflict(contradictions: DataFrame) -> DataFrame:
    """claim_id, is_contradicted, severity: the worst a claim is part of."""
    sides = contradictions.select(F.col("id_a").alias("claim_id"), "severity").unionByName(contradictions.select(F.col("id_b").alias("claim_id"), "severity"))
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return sides.groupBy("claim_id").agg(F.lit(True).alias("is_contradicted"), F.max_by("severity", rank).alias("severity"))


def group_conflict(pairs: DataFrame, merged: DataFrame, run: str = "run_id") -> DataFrame:
    """group_id, is_contradicted, severity: the worst that any two claims of one topic bring to their groups (G6 for F17).

    pairs(run, id_a, id_b) of different statements, each named by its smallest claim
    (claim_pairs); merged(run, claim_id, group_id, statement, finding_type). A statement
    counts once for each type it has, so that a fact and a risk in the same words meet too.
    """
    folded = merged.withColumn("folded", F.lower(F.trim("statement")))
    named = folded.groupBy(run, "folded").agg(F.min("claim_id").alias("__rep"))
    typed = folded.groupBy(run, "folded", "finding_type").agg(F.min("claim_id").alias("claim_id"), F.min_by("statement", "claim_id").alias("statement"), F.min("group_id").alias("group_id"))
    said = typed.join(named, [run, "folded"])
    side = lambda s: said.select(run, F.col("__rep").alias(f"id_{s}"), F.col("group_id").alias(f"g_{s}"), F.col("claim_id").alias(f"c_{s}"), traits(F.col("statement")).alias(f"s_{s}"), F.col("finding_type").alias(f"t_{s}"))
    same = named.select(run, F.col("__rep").alias("id_a"), F.col("__rep").alias("id_b"))
    both = pairs.select(run, "id_a", "id_b").unionByName(same).join(side("a"), [run, "id_a"]).join(side("b"), [run, "id_b"]).where("c_a <> c_b")
    found = both.withColumn("c", traits_conflict(F.col("s_a"), F.col("s_b"), F.col("t_a"), F.col("t_b"))).where("c is not null")
    return claim_conflict(found.select(F.col("g_a").alias("id_a"), F.col("g_b").alias("id_b"), "c.severity")).withColumnRenamed("claim_id", "group_id")


def link_conclusions(conclusions: DataFrame, table: DataFrame, claims: DataFrame, run: str = "run_id", fallback: int = 5) -> DataFrame:
    """run, conclusion_id, statement, confidence, claim_ids (sorted): the claims that support each; the run's first five where none do.

    conclusions(run, conclusion_id, statement, confidence, supporting array<string>), claims(run, claim_id, seq).
    """
    named = conclusions.select(run, "conclusion_id", F.explode("supporting").alias("statement")).join(table, [run, "statement"]).groupBy(run, "conclusion_id").agg(F.array_sort(F.collect_set("claim_id")).alias("found"))
    first = Window.partitionBy(run).orderBy("seq", "claim_id")
    firsts = claims.withColumn("n", F.row_number().over(first)).where(F.col("n") <= fallback).groupBy(run).agg(F.array_sort(F.collect_list("claim_id")).alias("first"))
    out = conclusions.join(named, [run, "conclusion_id"], "left").join(firsts, run, "left")
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    return out.select(run, "conclusion_id", "statement", bounded.alias("confidence"), F.coalesce("found", "first").alias("claim_ids"))


def summary_conclusion(runs: DataFrame, claims: DataFrame, run: str = "run_id", n: int = 5) -> DataFrame:
    """One conclusion a run: a summary of its first claims, or a note that evidence is lacking."""
    first = Window.partitionBy(run).orderBy("seq", "claim_id")
    firsts = claims.withColumn("n", F.row_number().over(first)).where(F.col("n") <= n).groupBy(run).agg(F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))
    out = runs.select(run).distinct().join(firsts, run, "left")
    none = F.col("claim_ids").isNull()
    return out.select(
        run,
        F.when(none, "The evidence gathered does not support a conclusion.").otherwise(F.format_string("The evidence supports %d findings.", F.size("claim_ids"))).alias("statement"),
        F.when(none, 0.30).otherwise(0.65).alias("confidence"),
        F.coalesce("claim_ids", F.array().cast(f"array<{claims.schema['claim_id'].dataType.simpleString()}>")).alias("claim_ids"),
    )
