"""Deletes over graphs of foreign keys."""

from provlake.operators.provenance import ForeignKey, cascade_graph
from provlake.plans.session import written


def test_cascade_follows_cycles_and_diamonds(spark):
    parts = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "d"), (5, 4, "e"), (6, None, "f"), (None, 3, "g")], "id int, above int, text string")
    notes = spark.createDataFrame([(1, 3, 6), (2, 6, 3), (3, None, 1), (4, 6, None)], "n int, part int, seen int")
    keys = [ForeignKey("parts", "above", "id", "parts"), ForeignKey("notes", "part", None, "parts"), ForeignKey("notes", "seen", None, "parts", "null")]

    def left(*ids):
        roots = spark.createDataFrame([("parts", str(i)) for i in ids], "kind string, id string")
        out = cascade_graph({"parts": parts, "notes": notes}, keys, {}, roots, written)
        assert out["notes"].columns == notes.columns and out["parts"].columns == parts.columns
        return {r.text for r in out["parts"].collect()}, {tuple(r) for r in out["notes"].collect()}

    assert left(1) == ({"d", "e", "f"}, {(2, 6, None), (3, None, None), (4, 6, None)})
    assert left(4) == ({"a", "b", "c", "f", "g"}, {(1, 3, 6), (2, 6, 3), (3, None, 1), (4, 6, None)})
    assert left() == ({"a", "b", "c", "d", "e", "f", "g"}, {(1, 3, 6), (2, 6, 3), (3, None, 1), (4, 6, None)})
