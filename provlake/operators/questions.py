"""Question and query preparation (C): constraints, coverage, cleaning, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions import rules
from provlake.functions.text import clean_query, literal_array

YEAR = r"\b(20[2-5][0-9])\b"
TERM = r"([a-z0-9]+(?:-[a-z0-9]+)*)"


def _word(term: str) -> str:
    """A pattern for the term between ASCII word boundaries."""
    escaped = "".join("\\" + c if c in ".-" else c for c in term)
    return rf"(^|[^a-z0-9_]){escaped}($|[^a-z0-9_])"


def _named(low: Column, terms: list[str]) -> Column:
    """Whether a lower-case text names one of the terms; the pattern is tried only where its letters stand."""
    out = F.lit(False)
    for term in terms:
        out = out | (low.contains(term) & low.rlike(_word(term)))
    return out


def _bound(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f names it: predicates on the result that Spark pushes down repeat it as a whole."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(YEAR), 1))


def geographies(text: Column, table=rules.GEOGRAPHIES) -> Column:
    """The regions named in a text, in the table's order."""
    return _bound(F.lower(text), lambda low: F.filter(F.array(*[F.when(_named(low, aliases), F.lit(name)) for name, aliases in table]), lambda x: x.isNotNull()))


def comparisons(text: Column, table=rules.COMPARATIVE_PAIRS) -> Column:
    """Pairs with two keywords in a text, or one and a word of comparison."""

    def held(low, words):
        need = F.when(low.contains("differ") | low.contains("compare"), 1).otherwise(2)
        return sum((_named(low, [w]).cast("int") for w in words), F.lit(0)) >= need

    return _bound(F.lower(text), lambda low: F.filter(F.array(*[F.when(held(low, words), F.lit(name)) for name, words, _ in table]), lambda x: x.isNotNull()))


def extract_constraints(df: DataFrame, text: str = "question") -> DataFrame:
    """Adds temporal (years in order, then relative times), geographic, comparative and is_comparative."""
    c = F.coalesce(F.col(text), F.lit(""))
    relative = F.concat(*[F.regexp_extract_all(F.lower(c), F.lit(p), 0) for p in rules.RELATIVE_TIMES])
    compares = F.lit(False)
    for term in rules.COMPARATIVE_TERMS:
        compares = compares | F.lower(c).contains(term)
    return df.withColumns({"temporal": F.array_distinct(F.concat(years(c), relative)), "geographic": geographies(c), "comparative": comparisons(c), "is_comparative": compares})


def augment_questions(df: DataFrame, cap: int = 5) -> DataFrame:
    """df(run_id, question, sub_questions array<string>) with sub_questions that cover the constraints.

    A missing region or comparative pair adds a question, or takes the last place at the
    cap; forward-looking questions without a listed year get the first year.
    """
    names = [(n, a) for n, a in rules.GEOGRAPHIES]
    head, tail = rules.GEOGRAPHY_QUESTION.split("{regions}{time}")

    def added(array: Column, text: Column) -> Column:
        kept = F.when(F.size(array) >= cap, F.slice(array, 1, cap - 1)).otherwise(array)
        return F.concat(kept, F.array(text))

    def regions(c: Column) -> Column:
        """The question about all regions, null for fewer than two."""
        n, first = F.size(c["geographic"]), F.get(c["temporal"], F.lit(0))
        listed = F.concat(F.array_join(F.slice(c["geographic"], F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(c["geographic"], -1))
        clause = F.when(first.isNotNull(), F.concat(F.lit(" through "), first)).otherwise("")
        return F.when(n >= 2, F.concat(F.lit(head), listed, clause, F.lit(tail)))

    def covering(c: Column) -> Column:
        """The questions, with one about all regions where one is missing."""
        covered = F.filter(F.array(*[F.when(F.exists(literal_array(a), lambda x: F.contains(c["text"], x)), F.lit(n)) for n, a in names]), lambda x: x.isNotNull())
        missing = F.size(F.array_except(c["geographic"], covered)) > 0
        present = lambda a, t: F.exists(a, lambda x: F.lower(x) == F.lower(t))
        return _bound(F.struct(c["subs"].alias("s"), regions(c).alias("q")), lambda x: F.when(x["q"].isNotNull() & missing & ~present(x["s"], x["q"]), added(x["s"], x["q"])).otherwise(x["s"]))

    def paired(c: Column, subs: Column) -> Column:
        cues = sum((F.contains(c["text"], F.lit(x)).cast("int") for x in rules.PAIR_CUES), F.lit(0))
        for name, _, template in rules.COMPARATIVE_PAIRS:
            subs = _bound(subs, lambda a: F.when(F.array_contains(c["comparative"], F.lit(name)) & (cues < 2), added(a, F.lit(template))).otherwise(a))  # noqa: B023
        return subs

    def dated(q: Column, first: Column) -> Column:
        forward = F.lower(q).rlike("|".join(rules.FORWARD_TERMS))
        has_year = q.rlike("|".join(rules.LISTED_YEARS)) | F.contains(q, first)
        return F.when(forward & ~has_year, F.concat(F.regexp_replace(q, r"\?+$", ""), F.lit(" through "), first, F.lit("?"))).otherwise(q)

    def augmented(c: Column) -> Column:
        first = F.get(c["temporal"], F.lit(0))
        return _bound(paired(c, covering(c)), lambda subs: F.when(first.isNotNull(), F.transform(subs, lambda q: dated(q, first))).otherwise(subs))

    c = F.struct("temporal", "geographic", "comparative", F.lower(F.array_join("sub_questions", " ")).alias("text"), F.col("sub_questions").alias("subs"))
    return extract_constraints(df).withColumn("sub_questions", _bound(c, augmented))


def constraint_summary(augmented: DataFrame) -> DataFrame:
    """run_id with what was detected, whether all of it is kept, and the number of questions."""
    text = F.lower(F.array_join("sub_questions", " "))
    times = F.size(F.filter("temporal", lambda t: ~F.contains(text, F.lower(t)))) == 0
    aliases = F.create_map(*[x for n, a in rules.GEOGRAPHIES for x in (F.lit(n), literal_array([n.lower(), *a]))])
    places = F.size(F.filter("geographic", lambda g: ~F.exists(F.try_element_at(aliases, g), lambda x: F.contains(text, x)))) == 0
    return augmented.select("run_id", "temporal", times.alias("temporal_preserved"), "geographic", places.alias("geographic_preserved"), "comparative", "is_comparative", F.size("sub_questions").alias("n_questions"))


def focused_queries(df: DataFrame, n: int = 2, ident: str = "query_id", text: str = "question") -> DataFrame:
    """ident, pos, query: the cleaned question, and its first six key terms where it has four."""
    base = clean_query(F.coalesce(F.col(text), F.lit("")))
    terms = F.filter(F.regexp_extract_all(F.lower("base"), F.lit(TERM), 1), lambda w: (F.length(w) > 2) & ~w.isin(rules.STOP_WORDS))
    variant = F.concat(F.array_join(F.slice("terms", 1, 6), " "), F.lit(" analysis"))
    rows = df.select(ident, base.alias("base")).withColumn("terms", terms)
    both = F.when((F.size("terms") >= 4) & (variant != F.col("base")), F.array(F.col("base"), variant)).otherwise(F.array("base"))
    return rows.select(ident, F.posexplode(F.slice(both, 1, n)).alias("pos", "query"))


def query_plan(subs: DataFrame, n: int = 2) -> DataFrame:
    """run_id, sequence_number, pos, query: the queries of each sub-question."""
    keyed = subs.select(F.struct("run_id", "sequence_number").alias("query_id"), "question")
    return focused_queries(keyed, n).select("query_id.run_id", "query_id.sequence_number", "pos", "query")


TEMPLATES = ["What is the current state of {}?", "What evidence supports or contradicts {}?", "What are the risks and limits of {}?"]


def expand_questions(df: DataFrame, templates: list[str] = TEMPLATES, ident: str = "query_id", text: str = "question") -> DataFrame:
    """ident, sequence_number, question: each question put into each template."""
    subject = F.regexp_replace(F.trim(F.col(text)), r"[?.!]+$", "")
    each = F.array(*[F.concat(F.lit(t.split("{}")[0]), subject, F.lit(t.split("{}")[1])) for t in templates])
    return df.select(ident, F.posexplode(each).alias("pos", "question")).select(ident, (F.col("pos") + 1).alias("sequence_number"), "question")
