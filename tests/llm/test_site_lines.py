"""Boilerplate of hosts: planted lines and passages, and the query against its SQL."""

import duckdb
import pytest
from tests.test_catalog import normal

import corpus_pipeline
from provlake.llm import queries

PASSAGE, COPIED = (" ".join(f"{w}{i}" for i in range(60)) for w in ("long", "copied"))


def planted():
    """12 hosts of 150 pages; the menu is on 3 pages of host 0 (2 %), a pair on 2, the passage on a page of each host, the copied one on 9."""
    rows = []
    for h in range(12):
        for i in range(150):
            own = [f"own line {h} {i}"]
            own += ["Menu of the site"] * (h == 0 and i < 3) + ["On two pages"] * (h == 0 and i < 2)
            own += [PASSAGE] * (i == 7) + [COPIED] * (i == 8 and h < 9)
            rows.append((h * 1000 + i, f"host{h}", "\n".join(own)))
    rows += [(99_000 + k, "host1", "A page\nits copies") for k in range(9)]
    rows += [(98_000 + h, f"host{h}", COPIED.replace("copied", "same")) for h in range(12)]
    return rows


def test_planted_boilerplate_goes(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, source string, text string")
    out = [x for r in corpus_pipeline.lines(spark, docs, "").select("text").collect() for x in r.text.split("\n")]
    assert out.count("Menu of the site") == 0 and out.count(PASSAGE) == 0
    assert out.count("On two pages") == 2 and out.count(COPIED) == 9 and out.count("its copies") == 9
    assert out.count(COPIED.replace("copied", "same")) == 12  # one text on all hosts
    assert len([x for x in out if x.startswith("own line")]) == 1800


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op3_site_relative_lines", "op3_host_rule_lines"])
def test_matches_sql(spark, size, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{size}/documents.parquet'")
    assert normal(queries.QUERIES[name](spark, f"/root/testdata/{size}").toPandas()) == normal(con.execute(queries.ORACLE_SQL[name]).df())
