"""A run's document against a loop over its tables, and what it moves."""

import random

import pytest

from provlake.operators import provenance
from provlake.plans import catalog

SCHEMAS = {
    "runs": "run_id int, question_id int, note string",
    "sources": "run_id int, source_id int, title string, url string",
    "contents": "source_id int, content_id string, content string",
    "findings": "run_id int, finding_id string, statement string",
    "evidence": "finding_id string, evidence_id int, source_id int, excerpt string",
    "sub_questions": "run_id int, sequence_number int, question string",
    "contradictions": "run_id int, contradiction_id int, id_a string, id_b string, severity string, category string",
    "conclusions": "run_id int, conclusion_id int, statement string, confidence double",
    "conclusion_findings": "conclusion_id int, finding_id string",
    "questions": "question_id int, question_text string, project_id int",
    "projects": "project_id int, project_name string",
}


def rows(seed):
    """Run 0 has hundreds of children, run 4 none; some ids are null, missing, or another run's."""
    rnd = random.Random(seed)
    out = {k: [] for k in SCHEMAS}
    out["runs"] = [(r, rnd.choice([1, 2, 9, None]), f"n{r}") for r in range(5)]
    for r, n in enumerate((300, 40, 7, 1)):
        names = [f"{r}-{i}" for i in range(n)]
        out["sources"] += [(r, 1000 * r + i, rnd.choice(["t", "u", None]), f"w{i}") for i in range(n)]
        out["findings"] += [(r, x, rnd.choice(["a", "b", None])) for x in names]
        some = lambda own: rnd.choice([own, own, own, "0-1", "none", None])  # noqa: E731, B023
        for i in range(2 * n):
            source = rnd.choice([1000 * r + rnd.randrange(n), 1000 * r + rnd.randrange(n), 3, 77777, None])
            out["evidence"].append((some(rnd.choice(names)), 10_000 * r + i, source, rnd.choice(["x", None])))
            out["contradictions"].append((r, 10_000 * r + i, some(rnd.choice(names)), some(rnd.choice(names)), "low", "c"))
        out["sub_questions"] += [(r, i, f"q{i}") for i in range(n)]
        out["conclusions"] += [(r, 100 * r + i, "s", 0.5) for i in range(min(n, 50))]
        out["conclusion_findings"] += [(100 * r + rnd.randrange(min(n, 50) + 1), some(rnd.choice(names))) for _ in range(2 * n)]
    out["contents"] = [(s[1], c, f"text {c}") for s in out["sources"] for c in rnd.sample("abcd", rnd.randrange(3))]
    out["questions"] = [(1, "one", 5), (2, "two", 6)]
    out["projects"] = [(5, "five")]
    for k in SCHEMAS:
        rnd.shuffle(out[k])
    return out


def least(values):
    """None first, as Spark orders the fields of rows."""
    return sorted(values, key=lambda row: [(x is not None, x if x is not None else 0) for x in row])


def looped(t, run):
    """The document as the maps of a run's own sources and findings give it."""
    r, question, note = run
    of = lambda k: [x[1:] for x in t[k] if x[0] == r]
    first = {s: min((c for c in t["contents"] if c[0] == s), default=(None, None, None))[1:] for s, *_ in of("sources")}
    source = {s[0]: s for s in of("sources")}
    statement = dict(of("findings"))
    sources = [(*s, None if first[s[0]][0] is None else first[s[0]]) for s in least(of("sources"))]
    shown = lambda f: [(e[1], e[2], *source.get(e[2], (0, None, None))[1:], e[3]) for e in least(x for x in t["evidence"] if x[0] == f)]
    findings = [(f, s, shown(f)) for f, s in least(of("findings"))]
    contradictions = [(i, a, b, statement.get(a), statement.get(b), s, c) for i, a, b, s, c in least(of("contradictions"))]
    conclusions = [(*c, sorted({f for x, f in t["conclusion_findings"] if x == c[0] and f is not None})) for c in least(of("conclusions"))]
    asked = {q[0]: q[1:] for q in t["questions"]}.get(question, ("Unknown Question", None))
    lists = [sources, findings, least(of("sub_questions")), contradictions, conclusions]
    counts = (*map(len, lists), sum(len(f[2]) for f in findings))
    return (question, r, note, *[x or None for x in lists], *asked, dict(t["projects"]).get(asked[1], "Unknown Project"), counts)


def plain(x):
    return [plain(y) for y in x] if isinstance(x, list) else tuple(plain(y) for y in x) if isinstance(x, tuple) else x


SHOWN = ["question_id", "run_id", "note", "sources", "findings", "sub_questions", "contradictions", "conclusions", "question_text", "project_id", "project_name", "counts"]


@pytest.mark.parametrize("keyed", [False, True])
def test_document_is_that_of_a_loop(spark, keyed):
    t = rows(7)
    df = {k: spark.createDataFrame(t[k], schema) for k, schema in SCHEMAS.items()}
    if keyed:  # a link to another run's finding is then not among the run's links
        df["evidence"] = df["evidence"].join(df["findings"].select("finding_id", "run_id"), "finding_id")
        df["conclusion_findings"] = df["conclusion_findings"].join(df["conclusions"].select("conclusion_id", "run_id"), "conclusion_id")
    got = provenance.run_detail(df.pop("runs"), df.pop("sources"), df.pop("findings"), df.pop("evidence"), **df)
    assert got.columns == ["question_id", "run_id", "note", "sources", "findings", "sub_questions", "contradictions", "conclusions", *[c for c in got.columns if c in ("project_id", "question_text", "project_name")], "counts"]
    assert plain(sorted((tuple(x) for x in got.select(*SHOWN).collect()), key=lambda x: x[1])) == [looped(t, run) for run in sorted(t["runs"])]


def test_lists_that_lie_together_give_the_same(spark):
    t = rows(8)
    df = {k: spark.createDataFrame(t[k], schema) for k, schema in SCHEMAS.items()}
    lists = df["runs"].select("run_id")
    together = {"findings": df["findings"], "sub_questions": df["sub_questions"], "contradictions": df["contradictions"]}
    together["evidence"] = df["evidence"].join(df["findings"].select("finding_id", "run_id"), "finding_id")
    for name, child in together.items():
        lists = lists.join(child.selectExpr("run_id", f"struct({', '.join(reversed([c for c in child.columns if c != 'run_id']))}) AS x").groupBy("run_id").agg({"x": "collect_list"}).withColumnRenamed("collect_list(x)", name), "run_id", "left")
    rest = {k: df[k] for k in ("contents", "conclusions", "conclusion_findings", "questions", "projects")}
    got = provenance.run_detail(df["runs"], df["sources"], gathered=lists, **rest)
    assert plain(sorted((tuple(x) for x in got.select(*SHOWN).collect()), key=lambda x: x[1])) == [looped(t, run) for run in sorted(t["runs"])]


def moved(df):
    """Rows that the shuffles of a query write, each shuffle once."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "ReusedExchangeExec":
            return 0
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(map(walk, inner))

    return walk(plan)


@pytest.mark.parametrize(("name", "most"), [("h02_run_document", 5), ("h02_run_detail", 4)])
def test_lines_are_moved_a_few_times_at_most(spark, name, most):
    """Each line to its run, each source to its title and back; the number of children of a run does not count."""
    d, old = "/root/testdata/sf0.01", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows, n = moved(catalog.QUERIES[name](spark, d)), spark.read.parquet(f"{d}/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert n < rows <= most * n, rows / n
