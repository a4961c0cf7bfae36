"""Questions that cover the constraints, as one expression that stays small."""

from pyspark.sql import functions as F

from provlake.operators import questions


def test_augmented_questions_are_worked_out_once(spark):
    """A predicate on the questions, as explode adds it, is pushed down with one copy of what they are made of."""
    rows = [("r1", "Compare pharma and biotech in the US, China and India through 2030"), ("r2", "large banks and fintechs in Europe"), ("r3", None)]
    df = spark.createDataFrame(rows, "run_id string, question string").withColumn("sub_questions", F.array(F.lit("What is the demand?"), F.lit("How do costs develop in China?")))
    out = questions.augment_questions(df, 4).select("run_id", F.posexplode("sub_questions").alias("pos", "question"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.run_id, r.pos)):
        got.setdefault(r.run_id, []).append(r.question)
    assert [len(got[k]) for k in ("r1", "r2", "r3")] == [4, 3, 2]
    assert got["r1"][0] == "What is the demand through 2030?" and "China, and India through 2030" in got["r1"][2] and "biotech" in got["r1"][3]
    assert "large institutions" in got["r2"][2] and got["r3"] == ["What is the demand?", "How do costs develop in China?"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regional banks") <= 6
