"""Streams over several batches and restarts, and hits that meet their answers."""

import pytest
from pyspark.sql import functions as F

from provlake.streaming import streams

EVENT = "run string, ts timestamp, status string"


def batch(spark, at, n, rows):
    """One more file of events: (run, minute, status)."""
    df = spark.createDataFrame(rows, "run string, m int, status string").select("run", F.timestamp_seconds(F.col("m") * 60 + 86400).alias("ts"), "status")
    df.coalesce(1).write.mode("append").parquet(f"{at}/in")
    return df


def tracked(spark, at, **more):
    sdf = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    rows = streams.drained(streams.run_tracker(sdf, "run", "ts", "status", 3_600_000, **more), "update", f"{at}/stream")
    minute = ((F.unix_seconds("last_seen") - 86400) / 60).cast("int").alias("m")
    return sorted((r.key, r.m, r.status, r.n, r.kinds) for r in rows.where("stalled").select("key", minute, "status", "n", "kinds").collect())


def test_each_stall_once_over_restarts(spark, tmp_path):
    at = str(tmp_path)
    batch(spark, at, 1, [("a", 0, "start"), ("a", 10, "fetch"), ("b", 0, "start"), ("b", 200, "end"), ("c", 190, None)])
    first = tracked(spark, at)  # a is silent since minute 10; b was between 0 and 200
    assert first == [("a", 10, "fetch", 2, 2), ("b", 0, "start", 1, 2)]
    assert tracked(spark, at) == first  # nothing new: nothing more
    batch(spark, at, 2, [("a", 205, "fetch"), ("d", 300, "start")])
    second = tracked(spark, at)
    assert second == [("a", 10, "fetch", 2, 2), ("a", 205, "fetch", 3, 2), ("b", 0, "start", 1, 2), ("b", 200, "end", 2, 2), ("c", 190, "", 1, 1)]
    batch(spark, at, 3, [("d", 320, "end"), ("a", 500, "end")])
    assert tracked(spark, at) == sorted([*second, ("d", 320, "end", 2, 2)])


def test_silent_runs_are_forgotten(spark, tmp_path):
    at = str(tmp_path)
    batch(spark, at, 1, [("a", 0, "start"), ("b", 0, "start")])
    batch(spark, at, 2, [("b", 100, "go")])
    assert tracked(spark, at, forget_ms=7_200_000) == [("a", 0, "start", 1, 1), ("b", 0, "start", 1, 2)]
    batch(spark, at, 3, [("b", 600, "go")])
    tracked(spark, at, forget_ms=7_200_000)
    batch(spark, at, 4, [("a", 610, "again"), ("b", 900, "end")])
    got = tracked(spark, at, forget_ms=7_200_000)
    assert ("a", 610, "again", 1, 1) in got  # counted anew: what was known of it is gone


@pytest.fixture
def asked(spark, tmp_path):
    seconds = lambda df, c: df.withColumn(c, F.timestamp_seconds(F.col(c) + 86400))
    hits = seconds(spark.createDataFrame([("x", 0), ("y", 10), ("z", 20), ("late", 5000), ("new", 9000)], "url string, hit_ts long"), "hit_ts")
    answers = seconds(spark.createDataFrame([("x", 60, 200), ("y", 700, 200), ("z", 10, 200), ("new", 9030, 404), ("w", 9000, 200)], "url string, answer_ts long, http_status int"), "answer_ts")
    for name, df in (("hits", hits), ("answers", answers)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return [spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}") for name, df in (("hits", hits), ("answers", answers))]


def test_hits_meet_answers_or_fail(spark, asked):
    """In time, too late, before the hit, and never; the newest hit without an answer would wait."""
    met = streams.drained(streams.fetched(*asked, "url", "10 minutes", "1 minute", "1 minute"))
    assert sorted((r.url, r.http_status) for r in met.collect()) == [("late", None), ("new", 404), ("x", 200), ("y", None), ("z", None)]


def test_state_is_one_value_of_a_run():
    """A batch of a run reads its state once and writes it once, whatever its statuses."""
    import pandas as pd

    calls = []

    class Value:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return value

        def registerTimer(self, due):
            pass

        def deleteTimer(self, due):
            pass

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    value, tracker = Value(), streams._Tracker("ts", "status", 3_600_000, None)
    tracker.init(Handle())
    day = pd.Timestamp("2024-01-01")
    (out,) = tracker.handleInputRows(("a",), iter([pd.DataFrame({"ts": [day, day + pd.Timedelta("2h")], "status": [None, "end"]}), pd.DataFrame({"ts": [day + pd.Timedelta("1min")], "status": ["go"]})]), Times())
    assert out[["status", "n", "kinds", "stalled"]].values.tolist() == [["go", 2, 3, True], ["end", 3, 3, False]]
    assert calls == ["get", "update"]
    assert value.held[-1] == {"": 1, "go": 1, "end": 1}
