"""Rules on rows written for them: the given tables rarely trigger these."""

import pytest
from pyspark.sql import functions as F

from provlake.functions import text
from provlake.operators import claims, content, links, questions, retrieval, titles, urls


def each(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_canonical_url(spark):
    same = ["HTTPS://Example.org/Report?utm_source=a&id=3#top", "https://example.org:443/Report/?id=3&fbclid=x", "https://example.org/Report?gclid=1&id=3&blank="]
    assert set(each(spark, same, urls.canonical_url)) == {"https://example.org/Report?id=3"}
    assert each(spark, [None, "", "nothing", "http://a.b:80/"], urls.canonical_url) == ["", "", "", "http://a.b"]
    once = each(spark, same + ["http://x.y/a?b=c&d"], urls.canonical_url)
    assert each(spark, once, urls.canonical_url) == once


@pytest.mark.parametrize(
    ("url", "safe"),
    [("http://127.0.0.1/a", False), ("http://10.1.2.3", False), ("http://192.168.0.9:80/", False), ("http://169.254.169.254/x", False), ("http://localhost/", False), ("http://a.internal/", False), ("file:///etc", False), ("ftp://a.b", False), ("http://[::1]/", False), ("http://[fe80::1]/", False), ("https://example.org", True), ("http://8.8.8.8/", True), ("http://172.32.0.1/", True), ("https://sub.example.com/a?b", True)],
)
def test_url_safety(spark, url, safe):
    assert each(spark, [url], lambda c: urls.url_safety(c)["safe"]) == [safe]


def test_policy_and_classes(spark):
    got = each(spark, ["https://m.facebook.com/a", "https://www.quora.com", "https://github.com/a/b/issues/1", "https://github.com/a", "https://github.com/a/b", "https://www.investopedia.com/terms/x", "https://example.org", None], lambda c: urls.exclusion(c)["reason"])
    assert got == ["hard_excluded_social_media", "hard_excluded_community_forum", "hard_excluded_github_issue_or_pull", "hard_excluded_github_user_profile", "allowed", "hard_excluded_dictionary_reference", "allowed", "empty_url"]
    kinds = each(spark, ["https://www.nih.gov/a", "https://cs.stanford.edu", "https://www.ox.ac.uk", "https://www.reuters.com", "https://microsoft.com", "https://en.wikipedia.org", "https://example.com"], lambda c: urls.classify_domain(c)["source_type"])
    assert kinds == ["government", "academic", "academic", "news", "enterprise", "reference_dictionary", "general_web"]


def test_constraints_and_augmentation(spark):
    df = spark.createDataFrame([("r", "How do the US, EU, China and India compare in demand through 2030?", ["What is the demand trend?", "What about cost?", "And supply?"])], "run_id string, question string, sub_questions array<string>")
    out = questions.augment_questions(df, 5)
    row = out.first()
    assert row.geographic == ["United States", "European Union", "China", "India"] and row.temporal[0] == "2030"
    assert row.sub_questions[0] == "What is the demand trend through 2030?" and len(row.sub_questions) == 4
    assert all(x in row.sub_questions[3] for x in row.geographic)
    kept = questions.constraint_summary(out).first()
    assert kept.geographic_preserved and kept.temporal_preserved
    assert len(questions.augment_questions(df, 3).first().sub_questions) == 3


def test_clean_query(spark):
    assert each(spark, ["What are the current trends in steel?!", "How is it", "In what ways does x-ray's use grow; now?"], text.clean_query) == ["trends in steel", "How is it", "does x-ray's use grow now"]


def test_relevance_orders_hits(spark):
    rows = [("solar power storage cost", "Solar power storage cost falls", "Cost of storage for solar power", "https://reuters.com/a", 0), ("solar power storage cost", "Definition of word", "A dictionary entry", "https://www.dictionary.com/a", 1), ("solar power storage cost", "Best games", "Play now", "https://games.example.com", 2)]
    got = {r.ord: r for r in retrieval.score(spark.createDataFrame(rows, "query string, title string, snippet string, url string, ord int").withColumn("sub_question", F.lit(""))).collect()}
    assert got[0].relevance_score > 0.8 and got[0].source_role == "PRIMARY"
    assert got[1].relevance_score == 0 and got[1].rejection_reason == "DICTIONARY_REFERENCE_DOMAIN" and got[2].relevance_score < 0.35


def test_similar_titles(spark):
    rows = [(1, "a.b", "Annual report on water use"), (2, "a.b", "Annual report on water uses"), (3, "c.d", "Annual report on water use"), (4, "", "Annual report on water use"), (5, "A.B", "annual report on water use "), (6, "a.b", "Other")]
    out = retrieval.dedup_titles(spark.createDataFrame(rows, "id int, publisher string, title string"))
    assert sorted(r.id for r in out.collect()) == [1, 3, 4, 6]
    ordered = titles.dedup_titles_ordered(spark.createDataFrame(rows, "id int, publisher string, title string").withColumn("run", F.lit(1)), "run", "id")
    assert sorted(r.id for r in ordered.collect()) == [1, 3, 4, 6]


def test_similar_titles_match_brute_force(spark):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randrange(0, 40))) for _ in range(25)]
    rows = []
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("abx")
        rows.append((i, rng.choice(["p", "q"]), "".join(t)))
    df = spark.createDataFrame(rows, "id int, publisher string, title string")
    kept = {r.id for r in retrieval.dedup_titles(df).collect()}
    pairs = df.alias("a").join(df.alias("b"), (F.col("a.publisher") == F.col("b.publisher")) & (F.col("a.id") < F.col("b.id")))
    gone = {r.id for r in pairs.where(retrieval.title_similarity(F.col("a.title"), F.col("b.title")) >= 0.85).select("b.id").collect()}
    assert kept == {r[0] for r in rows} - gone


def test_html_text_native_and_parser_agree(spark):
    html = "<html><head><title>T &amp; U</title><script>x('</p>')</script></head><body><nav>menu</nav><p>One <b>two</b></p><!-- no --><p>three  four</p><form>no</form></body></html>"
    df = spark.createDataFrame([("u", html), ("v", None)], "url string, html string")
    native, parsed = ({r.url: r for r in content.extract_text(df, m).collect()} for m in ("native", "parser"))
    assert native["u"].content == parsed["u"].content == "T & U\nOne\ntwo\nthree\nfour" and native["v"].title == "v"


def test_content_validation(spark):
    good = " ".join(f"word{i}" for i in range(40))
    got = each(spark, [None, " ", "too short", "Please log in " + good, good], lambda c: content.validate_content(c)["reason"])
    assert got == ["empty_content", "empty_content", "insufficient_content (2 words < 30)", "error_or_login_page", "valid"]


def test_claims_rules(spark):
    assert each(spark, ["Global industry report 2024", "", "Steel output rose 4% in 2023"], claims.is_template) == [True, True, False]
    df = spark.createDataFrame([("from 30 to 50 percent", "30 and 50"), ("from 50 to 30 percent", "30 and 50"), ("it grew 900", "it grew"), ("in 3 steps", "")], "s string, e string")
    assert [r.ok for r in df.select(claims.numeric_guard(F.col("s"), F.col("e"))["ok"].alias("ok")).collect()] == [True, False, False, True]
    long = "x" * 90 + " tail " + "y" * 60
    g = spark.createDataFrame([(long, long[:110] + "other"), ("invented", "text"), (None, "text")], "e string, c string")
    assert [r.g for r in g.select(claims.is_grounded(F.col("e"), F.col("c")).alias("g")).collect()] == [True, False, False]


def test_merging_and_confidence(spark, tmp_path):
    rows = [("r", 1, "Data centers will use 390 TWh of electricity by 2030", "a"), ("r", 2, "Studies show that data centers will use 390 TWh electricity by 2030", "b"), ("r", 3, "Water demand falls in dry regions", "c"), ("r", 4, "Data centers will use 120 TWh of electricity by 2031", "d")]
    df = spark.createDataFrame(rows, "run_id string, claim_id long, statement string, source_id string").withColumns({"finding_type": F.lit("fact"), "importance": F.lit("high"), "confidence": F.lit(0.8), "seq": F.col("claim_id")})
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    merged = claims.merge_claims(df, lambda d: d.checkpoint())
    assert {r.claim_id: r.group_id for r in merged.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.claim_id: r.group_id for r in claims.merge_ordered(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    one = claims.canonical(merged).where("group_id = 1").first()
    assert one.merged_count == 2 and one.distinct_sources == 2 and one.statement == rows[1][2]
    c = lambda *a: spark.range(1).select(claims.calibrate(*[F.lit(x) for x in a])["confidence"].alias("c")).first().c
    assert c(1.0, 1.0, 1.0, 5, "PRIMARY", False, "none") <= 0.95 and c(1.0, 1.0, 1.0, 1, "DISCOVERY_ONLY", False, "none") <= 0.5
    assert c(1.0, 0.7, 0.7, 3, "SUPPORTING", False, "none") > c(1.0, 0.7, 0.7, 1, "SUPPORTING", False, "none") > c(1.0, 0.7, 0.7, 1, "SUPPORTING", True, "high")


def test_conflicts(spark):
    rows = [("Output rose 40% in 2030", "Output rose 20% in 2030", "DIRECT_CONTRADICTION"), ("Output rises in China", "Output rises in India", "SCOPE_DIFFERENCE"), ("Output rises by 2030", "Output rises by 2040", "TIME_PERIOD_DIFFERENCE"), ("Output is forecast to rise", "Output rises", "FORECAST_DIFFERENCE"), ("Output rises", "Output rises fast", "CONTEXTUAL_TENSION")]
    df = spark.createDataFrame([(*r, "fact", "risk" if i == 4 else "fact") for i, r in enumerate(rows)], "a string, b string, want string, ta string, tb string")
    got = df.select("want", links.conflict(F.col("a"), F.col("b"), F.col("ta"), F.col("tb"))["category"].alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
