"""Retrieval, scoring and selection (D): all questions at once, keyed by query_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.functions import rules
from provlake.functions.text import key_concepts, tokens
from provlake.operators import titles
from provlake.operators.urls import canonical_url, classify_domain, exclusion, host, source_role

WEIGHTS = {"title": 0.35, "snippet": 0.30, "concept": 0.20, "domain": 0.15}
TITLE_BOOST, SNIPPET_BOOST = 1.2, 1.1


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 5, broadcast_tokens: int = 1_000_000, keep=lambda df: df) -> DataFrame:
    """query_id, doc_id, hits, rank: the k documents that share most distinct tokens with each query.

    queries(query_id, query), corpus(doc_id, text). Ties go to the smaller doc_id; a document
    that shares none is no hit; null ids take no part. A document with h hits of a query's n
    tokens has one of any n - h + 1 of them: once k documents with h hits are known, others
    are sought by the query's rarest n - h + 1 tokens alone. Queries of up to
    broadcast_tokens distinct tokens in all are sent to the scan of the corpus; beyond the
    bound both sides meet on tokens (best_by_tokens). keep holds what is used repeatedly there.
    """
    wanted = queries.where("query_id is not null").select("query_id", F.explode(tokens(F.col("query"))).alias("token")).distinct()
    present = corpus.where("doc_id is not null").select("doc_id", tokens(F.col("text")).alias("tokens"))
    best = Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")
    if wanted.limit(broadcast_tokens + 1).count() <= broadcast_tokens:
        hits = best_in_scan(wanted, present, k)
    else:
        hits = best_by_tokens(wanted, present, k, keep)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class _Asked:
    """Query tokens as arrays: entries (word, query) sorted by word, and the words of each query."""

    def __init__(self, rows):
        self.ids, query = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        words, word = np.unique(rows["token"].to_numpy(dtype=str), return_inverse=True)
        self.words = words.tolist()
        by_word = np.lexsort((query, word))
        self.word, self.query = word[by_word], query[by_word]
        self.n = np.bincount(query, minlength=len(self.ids))
        self.first = np.cumsum(self.n) - self.n
        self.of_query = word[np.lexsort((word, query))]

    def places(self, seen: np.ndarray) -> np.ndarray:
        """The place of each entry among its query's tokens, the rarest first."""
        order = np.lexsort((self.word, seen[self.word], self.query))
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.arange(len(order)) - self.first[self.query[order]]
        return out


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., n of them, one run after the other."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


def _slices(sizes: np.ndarray, most: int):
    """Ranges of rows whose sizes add up to about most."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def best_in_scan(wanted: DataFrame, present: DataFrame, k: int, most: int = 2_000_000) -> DataFrame:
    """query_id, doc_id, hits: the k best documents of each query in each task. most: pairs held at a time."""
    asked = present.sparkSession.sparkContext.broadcast(_Asked(wanted.toPandas()))  # bounded by retrieve

    def run(batches):
        q = asked.value
        words, n_words, n_queries = pa.array(q.words, pa.string()), len(q.words), len(q.ids)
        least, seen, ranked_at = np.ones(n_queries, dtype=np.int64), np.zeros(n_words, dtype=np.int64), 0
        best = np.zeros((3, 0), dtype=np.int64)  # query, hits, document
        place = q.places(seen)
        for batch in batches:
            lists, doc = batch.column(1), batch.column(0).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            word = pc.index_in(lists.flatten(), words)
            known = word.is_valid().to_numpy(zero_copy_only=False)
            row, word = row[known], word.drop_null().to_numpy().astype(np.int64)
            every = np.sort(row * n_words + word)
            fan = np.bincount(q.word, minlength=n_words)
            width = np.bincount(row, weights=fan[word], minlength=batch.num_rows).astype(np.int64)
            for lo, hi in _slices(width, most if ranked_at else most // 16):
                a, b = np.searchsorted(row, [lo, hi])
                r, w = row[a:b], word[a:b]
                open_ = place <= q.n[q.query] - least[q.query]
                names, starts = q.query[open_], np.searchsorted(q.word[open_], np.arange(n_words + 1))
                m = starts[w + 1] - starts[w]
                pairs = np.unique(np.repeat(r, m) * n_queries + names[_spread(starts[w], m)])
                r, of = pairs // n_queries, pairs % n_queries
                hits = np.zeros(len(pairs), dtype=np.int64)
                for lower, upper in _slices(q.n[of], most):
                    m = q.n[of[lower:upper]]
                    sought = np.repeat(r[lower:upper], m) * n_words + q.of_query[_spread(q.first[of[lower:upper]], m)]
                    at = np.minimum(np.searchsorted(every, sought), len(every) - 1)
                    hits[lower:upper] = np.add.reduceat((every[at] == sought).astype(np.int64), np.cumsum(m) - m)
                good = hits >= least[of]
                now = np.concatenate((best, np.stack([of[good], hits[good], doc[r[good]]])), axis=1)
                now = now[:, np.lexsort((now[2], -now[1], now[0]))]
                best = now[:, np.arange(now.shape[1]) - np.searchsorted(now[0], now[0]) < k]
                last = np.flatnonzero(np.arange(best.shape[1]) - np.searchsorted(best[0], best[0]) == k - 1)
                least[best[0, last]] = best[1, last]
                seen += np.bincount(w, minlength=n_words)
                if seen.sum() > 2 * ranked_at:
                    place, ranked_at = q.places(seen), int(seen.sum())
        if best.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["query_id", "doc_id", "hits"])

    kind = wanted.schema["query_id"].dataType.simpleString()
    return present.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(run, f"query_id {kind}, doc_id long, hits long")


def best_by_tokens(wanted: DataFrame, present: DataFrame, k: int, keep=lambda df: df, part: int = 1_000_000) -> DataFrame:
    """query_id, doc_id, hits: documents that can be among the k best of each query, all of the k best included.

    First some documents of each query's rarest tokens are counted in full: the k-th of
    these bounds the hits asked of all others. Then documents with one of the rarest
    n - h + 1 tokens are counted in full too. A frequent token's documents are dealt in
    parts of about `part` rows, and its queries go to each of them.
    """
    hits_of = lambda pairs: pairs.join(present, "doc_id").join(asked, "query_id").withColumn("hits", F.size(F.array_intersect("tokens", "words")).cast("long")).select("query_id", "doc_id", "hits")
    asked = keep(wanted.groupBy("query_id").agg(F.collect_list("token").alias("words")))
    met = present.select("doc_id", F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    df = met.groupBy("token").agg(F.count("*").alias("df"))
    ranked = Window.partitionBy("query_id").orderBy("df", "token")
    entries = keep(wanted.join(df, "token").withColumn("parts", F.ceil(F.col("df") / part).cast("int")).withColumns({"place": F.row_number().over(ranked), "n": F.count("*").over(Window.partitionBy("query_id")), "before": F.sum("df").over(ranked.rowsBetween(Window.unboundedPreceding, -1))}))
    dealt = keep(met.join(df, "token").select("token", "doc_id", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / part)).cast("int").alias("part")))
    first = Window.partitionBy("token").orderBy("doc_id")
    some = dealt.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= 4 * k).select("token", "doc_id")  # any documents do for a bound
    seeds = entries.where(F.coalesce("before", F.lit(0)) < 4 * k).select("query_id", "token").join(some, "token").select("query_id", "doc_id").distinct()
    kth = Window.partitionBy("query_id").orderBy(F.desc("hits"))
    bound = hits_of(seeds).withColumn("__n", F.row_number().over(kth)).where(F.col("__n") == k).select("query_id", F.col("hits").alias("least"))
    least = F.coalesce("least", F.lit(1))
    open_ = entries.join(bound, "query_id", "left").where(F.col("place") <= F.col("n") - least + 1)
    sent = open_.select("query_id", "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = keep(sent.join(dealt, ["token", "part"]).select("query_id", "doc_id").distinct())
    return hits_of(near).join(bound, "query_id", "left").where(F.col("hits") >= least).select("query_id", "doc_id", "hits")


def score(df: DataFrame, min_score: float = 0.0, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds the relevance score and its parts to hits(query, sub_question, title, snippet, url)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = df.withColumns({"__q": tokens(text("query"), 2), "__t": tokens(text("title"), 1), "__s": tokens(text("snippet"), 1), "__c": key_concepts(F.concat_ws(" ", text("query"), text("sub_question")))})
    out = out.withColumns({"__text": F.concat_ws(" ", F.lower(text("title")), F.lower(text("snippet"))), "__policy": exclusion(F.col("url")), "__class": classify_domain(F.col("url"))})

    def share(side: str, boost: float) -> Column:
        both = F.size(F.array_intersect("__q", side))
        return F.when((F.size("__q") > 0) & (F.size(side) > 0), F.least(F.lit(1.0), both / F.size("__q") * F.lit(boost))).otherwise(0.0)

    out = out.withColumn("matched_concepts", F.filter("__c", lambda c: F.contains(F.col("__text"), c)))
    concept = F.when(F.size("__c") > 0, F.size("matched_concepts") / F.size("__c")).otherwise(0.0)
    out = out.withColumns({"title_match": share("__t", TITLE_BOOST), "snippet_match": share("__s", SNIPPET_BOOST), "concept_match": concept, "domain_quality": F.col("__class.quality"), "source_type": F.col("__class.source_type")})
    total = sum((F.lit(w) * F.col("domain_quality" if n == "domain" else f"{n}_match") for n, w in weights.items()), F.lit(0.0))
    excluded = F.col("__policy.excluded")
    out = out.withColumns({"is_hard_excluded": excluded, "exclusion_reason": F.when(excluded, F.col("__policy.reason")).otherwise(""), "relevance_score": F.when(excluded, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4))})
    for name in ("title_match", "snippet_match", "concept_match"):
        out = out.withColumn(name, F.when(excluded, 0.0).otherwise(F.round(name, 4)))
    out = out.withColumns({"source_role": F.when(excluded, "DISCOVERY_ONLY").otherwise(source_role(F.col("source_type"), F.col("domain_quality"), F.col("relevance_score"))), "is_relevant": ~excluded & (F.col("relevance_score") >= min_score)})
    reason = F.when(excluded, audit_label(F.col("exclusion_reason"))).when(F.col("is_relevant"), "").otherwise(F.format_string(f"insufficient_relevance (%.3f < {min_score:.2f})", "relevance_score"))
    return out.withColumn("rejection_reason", reason).drop("__q", "__t", "__s", "__c", "__text", "__policy", "__class")


def filter_relevant(scored: DataFrame, min_score: float = 0.15) -> DataFrame:
    """Scored hits that reach the threshold (D3)."""
    return scored.where(~F.col("is_hard_excluded") & (F.col("relevance_score") >= min_score))


def dedup_urls(df: DataFrame, key: str, order: list[str], url: str = "url") -> DataFrame:
    """The first arrival of each canonical url within a key; rows without a url go."""
    first = Window.partitionBy(key, "canonical").orderBy(*order)
    return df.withColumn("canonical", canonical_url(F.col(url))).where("canonical <> ''").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def title_similarity(a: Column, b: Column) -> Column:
    """1 minus the Levenshtein distance over the longer length."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def dedup_titles(df: DataFrame, threshold: float = 0.85, keep=lambda df: df) -> DataFrame:
    """Rows without an earlier row of one publisher with a similar title (D5, native form).

    df(id, publisher, title). Equal titles fall together first. A publisher's titles are
    dealt to cells, and each meets those of every cell in place: a task holds a cell, most
    pairs are told apart by marks of their characters, and a title is done with at the first
    earlier one that is similar. What is shuffled are titles, never pairs.
    """
    base = df.where(F.coalesce("publisher", F.lit("")) != "").select(F.lower("publisher").alias("p"), F.lower(F.trim("title")).alias("t"), "id").groupBy("p", "t").agg(F.min("id").alias("id"))
    cells = base.groupBy("p").agg(F.ceil(F.count("*") / titles.CELL).cast("int").alias("k"))
    dealt = keep(titles.marked(base.join(cells, "p")).withColumn("cell", F.pmod(F.xxhash64("t"), F.col("k")).cast("int")))
    side = lambda s: dealt.select(F.col("p").alias("g"), F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("t", "n", "marks", "cell")], F.sequence(F.lit(0), F.col("k") - 1).alias(f"{s}_cells"))
    near = (F.col("early") < F.col("late")) & titles.may_be_near(threshold, "edits") & titles.near_by_edits(threshold)
    gone = titles.met(side("late"), side("early"), near, "left_semi").select(F.col("g").alias("p"), F.col("late_t").alias("t")).distinct()
    firsts = base.select("p", "t", F.col("id").alias("first_id"))
    keyed = df.withColumns({"p": F.lower(F.coalesce("publisher", F.lit(""))), "t": F.lower(F.trim("title"))})
    kept = keyed.join(gone, ["p", "t"], "left_anti").join(firsts, ["p", "t"], "left").where((F.col("p") == "") | (F.col("id") == F.col("first_id")))
    return kept.select(*df.columns)


def select_sources(scored: DataFrame, key: str, per_domain: int = 2, n: int = 12, order: list | None = None) -> DataFrame:
    """The n best per key with at most per_domain of a host (D6); adds rank.

    A host's rows beyond the cap never affect other hosts, so capping first gives the greedy result.
    """
    order = order or [F.desc("relevance_score"), "ord"]
    capped = scored.withColumn("__host", host(F.col("url"))).withColumn("__n", F.row_number().over(Window.partitionBy(key, "__host").orderBy(*order))).where(F.col("__n") <= per_domain)
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n).drop("__host", "__n")


def diversity_split(df: DataFrame, key: str, order: list, cap: int = 2, ident: str = "page_id") -> DataFrame:
    """Adds accepted and rejection_reason: the first `cap` of a host are accepted (D7). ident is unique within a key.

    Each task finds its first rows of a host before any row moves, so that a large host is
    never gathered; all rows then meet the accepted ids.
    """
    place = F.row_number().over(Window.partitionBy(key, "__host").orderBy(*order))
    first = df.withColumn("__host", host(F.col("url"))).withColumn("__n", place).where(F.col("__n") <= cap).select(key, ident, F.lit(True).alias("__in"))
    out = df.alias("x").join(first.alias("y"), F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")) & (F.col(f"x.{ident}") == F.col(f"y.{ident}")), "left")
    accepted = F.coalesce("__in", F.lit(False))
    return out.select("x.*", accepted.alias("accepted"), F.when(accepted, "").otherwise("DOMAIN_DIVERSITY_CAP").alias("rejection_reason"))


def source_audit(scored: DataFrame, key: str, per_domain: int = 2, n: int = 12) -> DataFrame:
    """Every hit with its state and reason: excluded, below the top n, or selected."""
    open_hits = scored.where("not is_hard_excluded")
    chosen = select_sources(open_hits, key, per_domain, n).select(key, "ord", F.lit(True).alias("__chosen"))
    out = scored.join(chosen, [key, "ord"], "left")
    state = F.when(F.col("__chosen"), "ELIGIBLE").otherwise("REJECTED")
    reason = F.when(F.col("is_hard_excluded"), audit_label(F.col("exclusion_reason"))).when(F.col("__chosen"), "").otherwise("RANK_BELOW_TOP_N")
    return out.withColumns({"lifecycle_state": state, "audit_reason": reason}).drop("__chosen")


def audit_label(reason: Column, labels: dict[str, str] = rules.AUDIT_LABELS) -> Column:
    """The audit label of a rejection reason; unknown ones in capitals."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, reason), F.upper(reason))


def source_mix(df: DataFrame, key: str) -> DataFrame:
    """Hits by source type, and distinct hosts, of each key."""
    hits = df.select(key, classify_domain(F.col("url"))["source_type"].alias("source_type"), host(F.col("url")).alias("host"))
    hosts = hits.groupBy(key).agg(F.countDistinct("host").alias("unique_domains"))
    return hits.groupBy(key, "source_type").agg(F.count("*").alias("n")).join(hosts, key)


def domain_sketches(df: DataFrame, key: str, day: str, lg_k: int = 12) -> DataFrame:
    """key, day, n and a sketch of the hosts of its hits: a few kilobytes however many there are (D10, approximate)."""
    hits = df.select(key, day, host(F.col("url")).alias("host"))
    return hits.groupBy(key, day).agg(F.count("*").alias("n"), F.hll_sketch_agg("host", F.lit(lg_k)).alias("hosts"))


def merged_domains(sketches: DataFrame, key: str | None = None) -> DataFrame:
    """n and unique_domains over the sketches of each key, or over all of them: any choice of runs and days, without the hits."""
    some = sketches.groupBy(key) if key else sketches.groupBy()
    return some.agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("hosts")).alias("unique_domains"))


def search_stats(df: DataFrame, key: str, query: str, error: str) -> DataFrame:
    """Successful and failed searches of each key, with the failures' messages in order."""
    failed = F.col(error).isNotNull()
    warnings = F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct(F.col(query).alias("q"), F.col(error).alias("e"))))), lambda x: F.concat_ws(": ", x["q"].cast("string"), x["e"]))
    return df.groupBy(key).agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), warnings.alias("warnings"))
