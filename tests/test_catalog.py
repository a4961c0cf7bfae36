"""Every query of the catalogue against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from provlake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(df):
    """Rows as sorted text, columns by name, floats to nine digits."""

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if str(v) in ("NaT", "<NA>"):
            return "null"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:26]
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, int) or type(v).__name__.startswith("int"):
            return str(int(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return str(int(v)) if float(v).is_integer() else f"{v:.9g}"
        return str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = normal(catalog.QUERIES[name](spark, DATA).toPandas())
    want = normal(duck.execute(catalog.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
