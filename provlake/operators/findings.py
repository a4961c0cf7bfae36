"""From candidate claims to a run's findings (F5 to F20, G6) as one plan, for all runs at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.operators import claims, links

#: a finding has the strongest role of its sources
ROLES = ["PRIMARY", "SECONDARY", "SUPPORTING", "DISCOVERY_ONLY"]


class Findings(NamedTuple):
    """findings: a row for each; evidence: a row for each claim behind them; counts: a row for each run."""

    findings: DataFrame
    evidence: DataFrame
    counts: DataFrame


def judged(candidates: DataFrame, sources: DataFrame, inverted: bool = True) -> DataFrame:
    """candidates with their resolved source_id, numeric_ok, and cause: why a claim is not used, or null.

    A claim is held against the text of the source that it resolves to, which is read for
    that alone. A number that the excerpt lacks is noted, and rejects nothing; so is a range
    whose end is below its start, unless inverted is false (a phone number, 555-0303, reads as one).
    """
    found = claims.resolve_source(candidates, sources.select("batch", "source_id", "url")).drop("source_id", "source_url", "resolved_url").withColumnRenamed("resolved_id", "source_id")
    grounded = claims.ground(found, sources.select("source_id", "content").dropDuplicates(["source_id"]))
    guard = claims.numeric_guard(F.col("statement"), F.col("excerpt"))
    numeric_ok = guard["ok"] if inverted else F.size(guard["ungrounded"]) == 0
    told = grounded.withColumns({"cause": claims.rejection_cause(grounded), "numeric_ok": numeric_ok, "excerpt": F.trim("excerpt")})
    return told.drop("grounded")


def run_findings(candidates: DataFrame, sources: DataFrame, keep, run: str = "run_id", most: int = 40, threshold: float = claims.JACCARD, inverted: bool = True) -> Findings:
    """What a run's candidate claims come to: used ones merged, the first `most` groups kept, conflicts set off against their confidence.

    candidates(run, claim_id, batch, source_id, source_url, statement, excerpt, finding_type,
    importance, confidence, relevance), sources(batch, source_id, url, content, relevance,
    credibility, role); claim ids are unique over runs. A group is named by its smallest
    claim, and groups are kept in that order. Evidence of one source counts as one source; its
    relevance is the claim's, a finding's confidence takes the source's. Conflicts are those
    of all used claims, also with groups beyond the cap. keep cuts lineage: of the judged
    claims, their texts and pairs, and the groups, each of which is used more than once.
    A run without a used claim has a row of counts and no finding. inverted: as in judged.
    """
    every = keep(judged(candidates, sources, inverted))
    used = every.where("cause is null").drop("cause")
    texts = keep(claims.featured(claims.texts_of(used, run)))
    pairs = keep(claims.text_pairs(texts, run, "claim_id", threshold, keep=keep))
    merged = keep(claims.merge_texts(used, texts, pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), keep, run, "claim_id"))
    groups = claims.canonical(merged, run)
    kept = keep(claims.cap_per(groups, run, ["group_id"], most))

    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    known = sources.select("source_id", F.col("relevance").alias("source_relevance"), "credibility", F.when(rank > 0, rank).alias("rank")).dropDuplicates(["source_id"])
    evidence = merged.join(kept.select("group_id"), "group_id", "left_semi").join(known, "source_id", "left")
    rolled = claims.evidence_rollup(evidence.withColumn("relevance", F.col("source_relevance")))
    strongest = evidence.groupBy("group_id").agg(F.count("*").alias("n_evidence"), F.try_element_at(F.array(*[F.lit(r) for r in ROLES]), F.coalesce(F.min("rank"), F.lit(3)).cast("int")).alias("role"))
    conflicts = links.group_conflict(pairs, merged, run)
    out = kept.join(rolled, "group_id").join(strongest, "group_id").join(conflicts, "group_id", "left")
    c = claims.calibrate(F.lit(1.0), F.col("mean_relevance"), F.col("mean_credibility"), F.col("n_sources"), F.col("role"), F.col("is_contradicted"), F.col("severity"))
    found = out.withColumn("c", c).select(run, "group_id", "statement", "finding_type", "importance", "merged_count", "n_sources", "n_evidence", "role", F.coalesce("is_contradicted", F.lit(False)).alias("is_contradicted"), "severity", "c.confidence", "c.corroboration_bonus", "c.contradiction_penalty")

    linked = claims.evidence_links(merged.join(kept.select("group_id"), "group_id", "left_semi"))
    total = every.groupBy(run).agg(F.count("*").alias("candidates"), F.count_if(F.expr("cause is not null")).alias("unsupported"), F.count_if(F.expr("cause is null")).alias("claims"), F.count_if(F.expr("cause is null and not numeric_ok")).alias("numeric_alerts"))
    after = kept.groupBy(run).agg(F.count("*").alias("grounded"), F.sum("merged_count").alias("evidence"))
    merges = merged.groupBy(run).agg((F.count("*") - F.countDistinct("group_id")).alias("merged"))
    counts = total.join(merges, run, "left").join(after, run, "left").fillna(0, ["merged", "grounded", "evidence"])
    return Findings(found, linked, counts)
