"""Functions called from SQL against their Column forms."""

from provlake.functions import sql, text
from provlake.operators import urls

TEXTS = ["Could you please tell me, what is the impact of AI?!", "  - 3. According to the study, costs rose 40% -- fast", "it's well-known 'x'", "", "a" * 120 + " b", "What is \\d+ and C:\\n?", None]
URLS = ["HTTP://www.Example.org:80/a/?utm_source=x&b=2&c=&ref=q#f", "https://a.b/", "//x.org/p?q=1", "", None, "nonsense", "http://h?s=1&t='"]


def test_functions_in_sql(spark):
    assert sql.register(spark) == ["canonical_url", "url_host", "clean_query", "normalize_statement"]
    forms = {"canonical_url": (urls.canonical_url, URLS), "url_host": (urls.host, URLS), "clean_query": (text.clean_query, TEXTS), "normalize_statement": (text.normalize_statement, TEXTS)}
    for name, (form, values) in forms.items():
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        got = spark.sql(f"SELECT i, {name}(v) AS x FROM {{df}} ORDER BY i", df=df)
        assert [r.x for r in got.collect()] == [r.x for r in df.select("i", form(df.v).alias("x")).orderBy("i").collect()], name
        assert name not in got._jdf.queryExecution().optimizedPlan().toString()  # inlined
