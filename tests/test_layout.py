"""Lists and lookups by layout: the rows, and the files that are read for them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from provlake.sources import layout

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module", params=[True, False], ids=["newest first", "oldest first"])
def laid(request, spark, tmp_path_factory):
    """20,000 rows in files of about 500; a third of them of one day, some without one."""
    i = F.col("id")
    day = F.when(i % 101 == 0, None).when(i % 3 == 0, F.lit(DAY)).otherwise(F.date_add(F.lit(DAY), (i * 7919 % 900).cast("int")))
    df = spark.range(20_000).select(day.alias("day"), (i * 31 % 20_000).alias("ident"), F.concat(F.lit("u"), i.cast("string")).alias("name")).repartition(7)
    at = f"{tmp_path_factory.mktemp('laid')}/t"
    layout.write_sorted(df, at, ["day", "ident"], request.param, ("name", "ident"), 500)
    rows = [(r.day, r.ident, r.name) for r in df.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or DAY, r[1]), reverse=request.param)
    return at, rows, request.param


def listed(df):
    return [(r.day, r.ident, r.name) for r in df.collect()]


@pytest.mark.parametrize("offset", [0, 490, 13_333, 19_990, 20_000])
def test_page(spark, laid, offset):
    at, rows, newest = laid
    out = layout.page_of(spark, at, ["day", "ident"], 20, offset, newest)
    assert listed(out) == rows[offset : offset + 20]
    assert len(out.inputFiles()) <= 2


def test_page_1000_opens_a_file_or_two(spark, laid):
    at, rows, newest = laid
    out = layout.page_of(spark, at, ["day", "ident"], 20, 999 * 20, newest)
    assert listed(out) == rows[19_980:] and len(out.inputFiles()) <= 2
    assert len(spark.read.parquet(f"{at}/data").inputFiles()) >= 30


@pytest.mark.parametrize("at_row", [0, 700, 9_000, 15_000])
def test_next_page(spark, laid, at_row):
    at, rows, newest = laid
    while rows[at_row][0] is None:
        at_row += 1
    out = layout.page_after(spark, at, ["day", "ident"], 20, rows[at_row][:2], newest)
    assert listed(out) == rows[at_row + 1 : at_row + 21]


def test_pages_follow_each_other_to_the_end_of_days(spark, laid):
    at, rows, newest = laid
    last = max(i for i, r in enumerate(rows) if r[0] is not None)
    out = layout.page_after(spark, at, ["day", "ident"], 7, rows[last - 3][:2], newest)
    assert listed(out) == rows[last - 2 : last + 5]


def test_lookup(spark, laid):
    at, rows, _ = laid
    for column, place in (("name", 2), ("ident", 1)):
        value = rows[777][place]
        assert listed(layout.lookup(spark, at, column, value)) == [r for r in rows if r[place] == value]
    assert layout.lookup(spark, at, "ident", -5).count() == 0 and layout.lookup(spark, at, "ident", -5).inputFiles() == []


def test_lookup_by_the_sorted_column_opens_one_file(spark, tmp_path):
    layout.write_sorted(spark.range(10_000).repartition(5), f"{tmp_path}/t", ["id"], False, ("id",), 500)
    out = layout.lookup(spark, f"{tmp_path}/t", "id", 4321)
    assert out.count() == 1 and len(out.inputFiles()) == 1


def test_empty_table(spark, tmp_path):
    layout.write_sorted(spark.range(0), f"{tmp_path}/t", ["id"], True, ("id",))
    assert layout.page_of(spark, f"{tmp_path}/t", ["id"], 5).count() == layout.lookup(spark, f"{tmp_path}/t", "id", 1).count() == 0
    assert layout.page_after(spark, f"{tmp_path}/t", ["id"], 5, (3,)).count() == 0
