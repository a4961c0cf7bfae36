"""Provenance, rollups and history (H), and validation (V)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_counts(runs: DataFrame, children: dict[str, DataFrame], key: str = "run_id") -> DataFrame:
    """A row for each run with the number of each kind of child, 0 if none (H1). Each child is summed before it is joined."""
    out = runs.select(key)
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(f"n_{name}")), key, "left")
    return out.fillna(0, [f"n_{n}" for n in children])


def _listed(child: DataFrame, key: str, name: str) -> DataFrame:
    """key and an ordered array of the child's rows; a run has some tens of them. Rows are moved as they are: lists of the few that a task has of a run take more room."""
    rest = [c for c in child.columns if c != key]
    return child.repartition(key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def _of_run(child: DataFrame, parent: DataFrame, on: str, key: str) -> DataFrame:
    """child with the key of each run that has its parent, unless it names its run itself."""
    if key in child.columns:
        return child
    return child.join(parent.groupBy(on).agg(F.collect_set(key).alias(key)).withColumn(key, F.explode(key)), on)


def _named(rows: Column, field: str, value: Column) -> Column:
    """The rows of an array in order of a field (nulls first) that have a value there, none for null; in long arrays found by halving."""

    def place(before):
        def half(x, _):
            mid = F.shiftright(x["lo"] + x["hi"], 1)
            right = F.coalesce(before(F.get(rows, mid)[field]), F.lit(True))
            return F.when(x["lo"] >= x["hi"], x).when(right, F.struct((mid + 1).alias("lo"), x["hi"].alias("hi"))).otherwise(F.struct(x["lo"].alias("lo"), mid.alias("hi")))

        steps = F.sequence(F.lit(1), F.length(F.bin(F.size(rows))))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(rows).alias("hi")), half, lambda x: x["lo"])

    first = place(lambda x: x < value)
    return F.when(F.size(rows) > 32, F.slice(rows, first + 1, place(lambda x: x <= value) - first)).otherwise(F.filter(rows, lambda x: x[field] == value))


#: fixed values: what a document shows of the children of a run, and what it looks up by id
CHILDREN = {
    "sources": ["source_id", "title", "url"],
    "findings": ["finding_id", "statement"],
    "sub_questions": ["sequence_number", "question"],
    "contradictions": ["contradiction_id", "id_a", "id_b", "severity", "category"],
    "conclusions": ["conclusion_id", "statement", "confidence"],
    "evidence": ["finding_id", "evidence_id", "source_id", "excerpt"],
    "conclusion_findings": ["conclusion_id", "finding_id"],
}


def run_detail(
    runs: DataFrame, sources: DataFrame, findings: DataFrame | None = None, evidence: DataFrame | None = None, key: str = "run_id", *,
    sub_questions: DataFrame | None = None, contents: DataFrame | None = None, contradictions: DataFrame | None = None,
    conclusions: DataFrame | None = None, conclusion_findings: DataFrame | None = None, questions: DataFrame | None = None, projects: DataFrame | None = None,
    gathered: DataFrame | None = None,
) -> DataFrame:
    """A nested document for each run (H2): its sources, and its findings with their evidence, in order.

    sources(run_id, source_id, title, url), findings(run_id, finding_id, statement),
    evidence(finding_id, evidence_id, source_id, excerpt). What else is given is added:
    sub_questions(run_id, sequence_number, question) in order; the first of
    contents(source_id, content_id, content) to each source; contradictions(run_id,
    contradiction_id, id_a, id_b, severity, category) with both statements, null where a
    finding is missing; conclusions(run_id, conclusion_id, statement, confidence) with the
    finding_ids of conclusion_findings(conclusion_id, finding_id); question_text and
    project_name by runs.question_id, questions(question_id, question_text, project_id) and
    projects(project_id, project_name), "Unknown ..." where there is none; and counts.
    Children that a run lacks are null, but counted as 0.

    Titles and statements are those of the run's own sources and findings. Each child goes
    to its run once, and ids are looked up there, in the run's lists; evidence and
    conclusion_findings that have run_id too need not meet their parents for that.
    gathered(run_id, a list of rows for each child, named like it) takes the place of the
    tables of children that lie together already, sources aside.
    """
    own = [] if gathered is None else [c for c in gathered.columns if c != key]
    if contents is not None:
        first = contents.groupBy("source_id").agg(F.min(F.struct("content_id", "content")).alias("content"))
        sources = sources.join(first, "source_id", "left")
    tables = {"sources": sources, "findings": findings, "sub_questions": sub_questions, "contradictions": contradictions, "conclusions": conclusions}
    if evidence is not None:
        tables["evidence"] = _of_run(evidence, findings, "finding_id", key)
    if conclusion_findings is not None:
        tables["conclusion_findings"] = _of_run(conclusion_findings, conclusions, "conclusion_id", key)
    fields = CHILDREN | {"sources": CHILDREN["sources"] + ["content"] * (contents is not None)}
    out, names = runs, []
    if questions is not None:  # before the lists, which would move with the names
        named = questions if projects is None else questions.join(projects, "project_id", "left")
        names = [c for c in named.columns if c != "question_id"]
        out = out.join(named, "question_id", "left").withColumn("question_text", F.coalesce("question_text", F.lit("Unknown Question")))
        if projects is not None:
            out = out.withColumn("project_name", F.coalesce("project_name", F.lit("Unknown Project")))
    if own:
        row = lambda c: lambda x: F.struct(*[x[f].alias(f) for f in fields[c]])
        out = out.join(gathered.select(key, *[F.when(F.size(c) > 0, F.sort_array(F.transform(c, row(c)))).alias(f"__{c}") for c in own]), key, "left")
    for c, child in tables.items():
        if child is not None and c not in own:
            out = out.join(_listed(child.select(key, *fields[c]), key, f"__{c}"), key, "left")

    children = [c for c in CHILDREN if f"__{c}" in out.columns]
    rows = {c: F.coalesce(f"__{c}", F.array().cast(out.schema[f"__{c}"].dataType)) for c in children}
    one = lambda c, field, x: F.get(_named(rows[c], field, x), F.lit(0))
    kept = lambda c, x: [x[f].alias(f) for f in CHILDREN[c]]

    def titled(e):
        with_source = lambda s: F.struct(e["evidence_id"].alias("evidence_id"), e["source_id"].alias("source_id"), s["title"].alias("title"), s["url"].alias("url"), e["excerpt"].alias("excerpt"))
        return F.get(F.transform(F.array(one("sources", "source_id", e["source_id"])), with_source), F.lit(0))

    def told(x):
        statement = lambda s: one("findings", "finding_id", x[f"id_{s}"])["statement"].alias(f"statement_{s}")
        return F.struct(*kept("contradictions", x)[:3], statement("a"), statement("b"), *kept("contradictions", x)[3:])

    def chosen(x):
        ids = F.transform(_named(rows["conclusion_findings"], "conclusion_id", x["conclusion_id"]), lambda y: y["finding_id"])
        return F.struct(*kept("conclusions", x), F.array_distinct(F.filter(ids, lambda y: y.isNotNull())).alias("finding_ids"))

    def evident(x):
        return F.struct(*kept("findings", x), F.transform(_named(rows["evidence"], "finding_id", x["finding_id"]), titled).alias("evidence"))

    full = {"findings": evident, "contradictions": told, "conclusions": chosen}
    shown = [c for c in children if c not in ("evidence", "conclusion_findings")]
    lists = [(F.transform(f"__{c}", full[c]) if c in full else F.col(f"__{c}")).alias(c) for c in shown]
    asked = ["question_id"] if questions is not None else []
    out = out.select(*asked, key, *[c for c in runs.columns if c not in (key, *asked)], *lists, *names)
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    counted = [F.when(F.col(c).isNull(), 0).otherwise(n(F.col(c))).alias(c) for c in shown]
    held = F.when(F.col("findings").isNull(), 0).otherwise(F.aggregate("findings", F.lit(0), lambda total, f: total + F.size(f["evidence"])))
    return out.withColumn("counts", F.struct(*counted, held.alias("evidence")))


def provenance(conclusion_findings: DataFrame, evidence: DataFrame, contents: DataFrame) -> DataFrame:
    """conclusion_id, finding_id, evidence_id, source_id, content_id: every path of the graph as a row (H3)."""
    return conclusion_findings.join(evidence.select("finding_id", "evidence_id", "source_id"), "finding_id", "left").join(contents.select("source_id", "content_id"), "source_id", "left").select("conclusion_id", "finding_id", "evidence_id", "source_id", "content_id")


def provenance_graph(conclusions: DataFrame, conclusion_findings: DataFrame, findings: DataFrame, evidence: DataFrame, sources: DataFrame, contents: DataFrame, run: str = "run_id") -> DataFrame:
    """run, graph: the nested view of provenance (H3), conclusion > findings > evidence > source > contents.

    conclusions(run, conclusion_id, statement, confidence), conclusion_findings(conclusion_id,
    finding_id), findings(finding_id, statement, confidence), evidence(finding_id,
    evidence_id, source_id, excerpt), sources(source_id, title, url), contents(source_id,
    content_id). Lists are in the order of ids. A link to a finding that is not there is
    left out, repeated links count once, a source that is not there is null, and lists
    without members are empty. Each level is gathered by its own id before it moves up.
    """
    listed = lambda df, key, name, *columns: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    none = lambda df, name: F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
    held = listed(contents.where("content_id is not null"), "source_id", "contents", "content_id")
    told = sources.join(held, "source_id", "left").select("source_id", F.struct("source_id", "title", "url", none(held, "contents")).alias("source"))
    shown = listed(evidence.join(told, "source_id", "left"), "finding_id", "evidence", "evidence_id", "excerpt", "source")
    full = findings.join(shown, "finding_id", "left").select("finding_id", "statement", "confidence", none(shown, "evidence"))
    linked = listed(conclusion_findings.select("conclusion_id", "finding_id").distinct().join(full, "finding_id"), "conclusion_id", "findings", "finding_id", "statement", "confidence", "evidence")
    nodes = conclusions.join(linked, "conclusion_id", "left").select(run, "conclusion_id", "statement", "confidence", none(linked, "findings"))
    return listed(nodes, run, "graph", "conclusion_id", "statement", "confidence", "findings")


def _rate(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)


def quality_metrics(counters: DataFrame) -> DataFrame:
    """Adds coverage and rates to a run's counters (H4), the like-for-like evidence coverage too."""
    return counters.withColumns(
        {
            "source_coverage": _rate("fetched", "discovered"),
            "evidence_coverage": _rate("grounded", "findings"),
            "successful_fetch_rate": _rate("fetched", "selected"),
            "evidence_eligibility_rate": _rate("eligible", "fetched"),
            "conclusion_traceability": (F.col("conclusions") > 0) & (F.col("conclusions") == F.col("linked_conclusions")),
        }
    )


def metric_checks(counters: DataFrame) -> DataFrame:
    """Adds violations: the inequalities between counters that do not hold (H5)."""
    tests = [("fetched > selected", "fetched<=selected"), ("selected > discovered", "selected<=discovered"), ("eligible > fetched", "eligible<=fetched"), ("grounded > findings", "grounded<=findings")]
    return counters.withColumn("violations", F.filter(F.array(*[F.when(F.expr(t), F.lit(n)) for t, n in tests]), lambda x: x.isNotNull()))


def run_telemetry(telemetry: DataFrame, existing: DataFrame, key: str = "run_id") -> DataFrame:
    """key, metadata: the new keys of a run over its existing ones (H6). Both have metadata map<string, string>."""
    both = existing.select(key, F.col("metadata").alias("old")).join(telemetry.select(key, F.col("metadata").alias("new")), key, "full")
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("old", empty), F.coalesce("new", empty)
    return both.select(key, F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new).alias("metadata"))


#: fixed values: the names of a run's counters in its record; some counters have several
TELEMETRY = {
    "sub_questions": ["subquestions_count"],
    "queries": ["search_query_count"],
    "search_successes": ["search_success_count"],
    "search_failures": ["search_failure_count"],
    "batches": ["extraction_batch_count"],
    "discovered": ["discovered_sources"],
    "selected": ["selected_sources", "relevant_sources"],
    "rejected": ["rejected_sources_count", "rejected_irrelevant_count"],
    "fetched": ["successful_sources_count"],
    "failed": ["failed_sources_count"],
    "eligible": ["evidence_eligible_count", "extraction_source_count"],
    "claims": ["findings_before_deduplication"],
    "merged": ["duplicate_findings_merged"],
    "grounded": ["findings_after_deduplication", "finding_count", "findings_count", "grounded_findings_count"],
    "unsupported": ["unsupported_findings_count"],
    "evidence": ["evidence_count"],
    "contradictions": ["contradiction_count", "contradictions_count"],
    "conclusions": ["conclusions_count"],
    "seconds": ["duration_seconds", "total_runtime"],
}


def telemetry_record(counters: DataFrame, nested: dict[str, DataFrame] | None = None, settings: dict[str, str] | None = None, key: str = "run_id") -> DataFrame:
    """key, metadata map<string, string>: a run's record from its counters (H6).

    counters: key and any columns named in TELEMETRY. nested: name to (key, name, value)
    rows, such as contradictions by category, source types or seconds of stages, each kept
    as a JSON object. settings: values that all runs share, such as parallelism and models.
    """
    names = [(column, name) for column, many in TELEMETRY.items() if column in counters.columns for name in many]
    out = counters.select(key, F.create_map(*[x for column, name in names for x in (F.lit(name), F.col(column).cast("string"))], *[F.lit(x) for kv in (settings or {}).items() for x in kv]).alias("metadata"))
    for name, rows in (nested or {}).items():
        as_json = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name"), F.col("value"))))))
        out = out.join(rows.groupBy(key).agg(as_json.alias("__json")), key, "left")
        out = out.select(key, F.map_concat("metadata", F.create_map(F.lit(name), F.coalesce("__json", F.lit("{}")))).alias("metadata"))
    return out


def stage_timing(events: DataFrame, run: str, stage: str, ts: str) -> DataFrame:
    """run, stage, n, seconds from first to last event (H7)."""
    return events.groupBy(run, stage).agg(F.count("*").alias("n"), (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))).alias("micros"))


def by_id(df: DataFrame, key: str, ident) -> DataFrame:
    """The row with an id (H8)."""
    return df.where(F.col(key) == ident)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of a list in a total order (H9)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def merge_updates(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the patch's values where they are not null."""
    new = patch.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(new, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in base.columns])


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str, chain: list[tuple[str, str, str]], nulled: list[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    """Tables without the ids and all that hang on them.

    chain: (table, its foreign key, key its own children use), parents first; nulled:
    (table, column) that lose the reference only.
    """
    gone = ids.select(F.col(key).alias("__id"))
    out = dict(tables)
    for name, column in nulled:
        out[name] = out[name].join(gone.withColumn("__gone", F.lit(True)), F.col(column) == F.col("__id"), "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__id", "__gone")
    for name, foreign, own in chain:
        dropped = out[name].join(gone, F.col(foreign) == F.col("__id"), "left_semi")
        out[name] = out[name].join(gone, F.col(foreign) == F.col("__id"), "left_anti")
        gone = dropped.select(F.col(own).alias("__id"))
    return out


class ForeignKey(NamedTuple):
    """child.column names a row of parent; own: what the child's own children name (None: nothing does)."""

    child: str
    column: str
    own: str | None
    parent: str
    on_delete: str = "cascade"


def reachable(edges: DataFrame, roots: DataFrame, keep) -> DataFrame:
    """kind, id of the roots and of all that edges(parent_kind, parent_id, kind, id) reach from them, at any depth and over cycles.

    A round follows the edges of what the last one found; there are as many rounds as levels.
    """
    found = front = keep(roots.select("kind", "id").distinct())
    while not front.isEmpty():
        below = edges.join(front.select(F.col("kind").alias("parent_kind"), F.col("id").alias("parent_id")), ["parent_kind", "parent_id"], "left_semi")
        front = keep(below.select("kind", "id").distinct().join(found, ["kind", "id"], "left_anti"))
        found = keep(found.unionByName(front))
    return found


def cascade_graph(tables: dict[str, DataFrame], keys: list[ForeignKey], own: dict[str, str], roots: DataFrame, keep) -> dict[str, DataFrame]:
    """Tables without the roots(kind, id) and all that hang on them by any of the keys (H11); keys with on_delete "null" lose the name alone.

    own: the own keys of tables that are nobody's child. Ids are compared as strings; a null
    key names nothing. Only tables that are parents themselves are followed row by row.
    """
    own = own | {k.child: k.own for k in keys if k.own}
    name = lambda c: F.col(c).cast("string")
    edges = [tables[k.child].select(F.lit(k.parent).alias("parent_kind"), name(k.column).alias("parent_id"), F.lit(k.child).alias("kind"), name(k.own).alias("id")) for k in keys if k.own and k.on_delete == "cascade"]
    gone = reachable(reduce(DataFrame.unionByName, edges), roots, keep) if edges else keep(roots.select("kind", "id").distinct())
    of = lambda ids, kind: ids.where(F.col("kind") == kind).select(F.col("id").alias("__id")).distinct()
    out = dict(tables)
    for kind, column in own.items():
        out[kind] = out[kind].join(of(roots, kind), name(column) == F.col("__id"), "left_anti")
    for k in keys:
        rows, at = out[k.child], name(k.column) == F.col("__id")
        if k.on_delete == "null":
            lost = rows.join(of(gone, k.parent), at, "left").withColumn(k.column, F.when(F.col("__id").isNull(), F.col(k.column)))
            out[k.child] = lost.select(*tables[k.child].columns)
        else:
            out[k.child] = rows.join(of(gone, k.parent), at, "left_anti")
    return out


def folded(name: str) -> Column:
    return F.lower(F.trim(name))


def consolidate(projects: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept projects with their number of merged ones, questions pointing to them): one project a name, the newest.

    projects(id, name, created_at), questions(question_id, project_id).
    """
    chosen = projects.groupBy(folded("name").alias("__name")).agg(F.max_by("id", F.struct("created_at", "id")).alias("primary_id"), (F.count("*") - 1).alias("merged"))
    named = projects.join(chosen, folded("name").eqNullSafe(F.col("__name"))).drop("__name")
    moved = questions.join(named.select(F.col("id").alias("project_id"), "primary_id"), "project_id", "left").select("question_id", F.coalesce("primary_id", "project_id").alias("project_id"))
    return named.where("id = primary_id").drop("primary_id"), moved


def unique_names(df: DataFrame, order: list) -> DataFrame:
    """The first row of each name, case and outer spaces aside."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(folded("name")).orderBy(*order))).where("__n = 1").drop("__n")


def search(df: DataFrame, term: str, columns: list[str], children: DataFrame | None = None, key: str = "id", child_column: str = "question") -> DataFrame:
    """Rows with the term in a column, or in a child's text, whatever the case."""
    low = term.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    if children is None:
        return df.where(hit)
    found = children.where(F.contains(F.lower(child_column), F.lit(low))).select(key).distinct().withColumn("__hit", F.lit(True))
    return df.join(found, key, "left").where(hit | F.col("__hit")).drop("__hit")


def audit_history(questions: DataFrame, runs: DataFrame) -> DataFrame:
    """workspace_id, latest, n_questions, n_runs, with a total row whose workspace_id is null.

    questions(question_id, workspace_id, created_at), runs(question_id, started, completed).
    """
    of_question = runs.groupBy("question_id").agg(F.max(F.coalesce("completed", "started")).alias("last"), F.count("*").alias("n_runs"))
    joined = questions.join(of_question, "question_id", "left")
    return joined.rollup("workspace_id").agg(F.max(F.greatest("created_at", F.coalesce("last", "created_at"))).alias("latest"), F.count("*").alias("n_questions"), F.coalesce(F.sum("n_runs"), F.lit(0)).alias("n_runs"))


def start_state(status: Column) -> Column:
    """What starting a run leads to."""
    return F.when(status.isNull(), "not_found").when(status == "running", "conflict").when(status == "completed", "already_done").otherwise("may_start")


def relative_age(ts: Column, now: Column) -> Column:
    """Just now, seconds, minutes, hours, Yesterday, days, or the date."""
    s = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000)
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return (
        F.when(s < 15, "Just now").when(s < 60, text(s, "s ago")).when(s < 3600, text(s / 60, "m ago")).when(s < 86400, text(s / 3600, "h ago"))
        .when(s < 172800, "Yesterday").when(s < 7 * 86400, text(s / 86400, "d ago")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def compare_runs(summaries: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, metric, value: one row for each number of a run, to lay runs side by side."""
    return summaries.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(key, "x.metric", "x.value")


def comparison(key: str, **summaries: DataFrame) -> DataFrame:
    """key, kind, metric, value: all numbers of several summaries of runs, as rows, to lay runs side by side.

    A summary has the key and columns of numbers or truth values (counts, metrics), or the
    key, name and value (seconds of stages). Pivot on metric for a table of one row a run.
    """
    out = None
    for kind, df in summaries.items():
        if set(df.columns) == {key, "name", "value"}:
            part = df.select(key, F.lit(kind).alias("kind"), F.col("name").alias("metric"), F.col("value").cast("double").alias("value"))
        else:
            part = compare_runs(df, key, [c for c in df.columns if c != key]).select(key, F.lit(kind).alias("kind"), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def execution_mode(provider: Column, fallback: Column) -> Column:
    """real, fallback or mock."""
    return F.when(provider == "mock", "mock").when(F.coalesce(fallback, F.lit(False)), "fallback").otherwise("real")


def validate_fields(df: DataFrame, limits: dict[str, tuple[int, int, bool]]) -> DataFrame:
    """Adds violations: fields too short, too long or missing. limits: field to (least, most, required) (V1)."""
    tests = []
    for c, (least, most, required) in limits.items():
        n = F.length(F.trim(c))
        tests.append(F.when(F.col(c).isNull() & F.lit(required), F.lit(f"{c}:missing")).when(n < least, F.lit(f"{c}:short")).when(n > most, F.lit(f"{c}:long")))
    return df.withColumn("violations", F.filter(F.array(*tests), lambda x: x.isNotNull()))


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows whose foreign key, not null, has no parent (V2)."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias("__key")).distinct(), F.col(foreign) == F.col("__key"), "left_anti")


def bad_values(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """column, value, n: values not allowed (V3)."""
    out = None
    for c, values in allowed.items():
        part = df.where(F.col(c).isNotNull() & ~F.col(c).isin(values)).groupBy(F.lit(c).alias("column"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
