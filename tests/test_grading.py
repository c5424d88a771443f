import pytest
from pyspark.sql import functions as F

from proofset.functions import grading as g
from proofset.operators import sets


def one(df, name):
    return [r[name] for r in df.collect()]


def entry(spark, grade="PASS", reasons=(), output="a.jpg", **metrics):
    row = {"grade": grade, "reasons": list(reasons), "output": output} | metrics
    cols = ", ".join(["grade string", "reasons array<string>", "output string", *[f"{k} double" for k in metrics]])
    return spark.createDataFrame([tuple(row.values())], cols)


def decided(df):
    return g.decide(df).select("decide.*").first()


def test_local_decisions(spark):
    for grade, reasons, expected in (("PASS", [], ("PASS", 0.95)), ("REVIEW", ["x"], ("REVIEW", 0.8)), ("REVIEW", list("abcde"), ("REVIEW", 0.95)), ("FAIL", ["x"], ("FAIL", 1.0))):
        d = decided(entry(spark, grade, reasons))
        assert (d.grade, d.confidence) == expected


def test_near_misses(spark):
    d = decided(entry(spark, eye_sharpness=0.61))
    assert (d.grade, d.confidence, d.note) == ("REVIEW", 0.55, "close to the line: eye sharpness 0.61")
    assert decided(entry(spark, eye_sharpness=0.60)).grade == "REVIEW"
    assert decided(entry(spark, eye_sharpness=0.65)).grade == "PASS"
    assert decided(entry(spark, face_blown=0.028)).grade == "REVIEW"
    assert decided(entry(spark, face_blown=0.01)).grade == "PASS"
    assert decided(entry(spark, head_size=1.09)).grade == "PASS"


def test_given_looks(spark):
    rows = entry(spark)
    for look, expected in ((0.39, ("jev", "PASS", 0.61)), (0.40, ("jev", "REVIEW", 0.4)), (1.5, ("local", "PASS", 0.95)), (float("nan"), ("local", "PASS", 0.95))):
        d = g.decide(rows, F.lit(look), by="jev").select("decide.*").first()
        assert (d.by, d.grade, d.confidence) == expected
        assert d.requested == (None if d.by == "jev" else "jev")


def test_saved_decision_is_taken_again_only_on_an_equal_basis(spark):
    rows = entry(spark)
    first = g.decide(rows, F.lit(0.7), by="jev").withColumn("old", F.col("decide")).drop("decide")
    again = g.decide(first, F.lit(0.1), by="jev", saved=F.col("old")).select("decide.*").first()
    assert again.confidence == 0.7
    changed = g.decide(first.withColumn("reasons", F.array(F.lit("new"))), F.lit(0.1), by="jev", saved=F.col("old")).select("decide.*").first()
    assert changed.confidence == 0.9


def test_final_grades_and_remarks(spark):
    rows = entry(spark).unionByName(entry(spark, output=None)).withColumn("set_reasons", F.array(F.lit("x")))
    assert one(rows.withColumn("f", g.final_grade(F.col("set_reasons"))), "f") == ["REVIEW", "SKIPPED"]
    assert one(g.decide(entry(spark, "REVIEW", ["x"])).withColumn("r", g.remark(F.col("decide"))), "r") == ["80% sure"]
    assert one(g.decide(entry(spark)).withColumn("r", g.remark(F.col("decide"))), "r") == [""]
    assert g.decide(entry(spark, output=None)).first().decide is None


def test_judge_stops_without_a_face_and_skips_null_checks(spark):
    m = spark.createDataFrame([(1600, 2000, True, 0, 1, 0.42, 1.0), (1600, 1999, True, 0, 1, 0.70, None), (1600, 2000, True, 0, 0, 0.9, 9.0)], "width int, height int, srgb boolean, metadata_tags int, face int, eye_line double, head_size double")
    rows = g.judge(m).collect()
    assert [(r.grade, len(r.reasons)) for r in rows] == [("PASS", 0), ("FAIL", 2), ("FAIL", 1)]
    assert rows[1].reasons == ["size 1600x1999, expected 1600x2000", "eyes at 70% from the top, not 42%"]
    assert rows[2].reasons == ["no face found in the output"]


def test_bands(spark):
    rows = spark.createDataFrame([(0.9,), (1.2,), (2.0,), (float("nan"),)], "x double")
    assert one(rows.withColumn("b", g.band(F.col("x"), (0.9, 1.1), (0.75, 1.3))), "b") == [0, 1, 2, 2]


def test_looks_in_answers(spark):
    texts = ["0.25", '{"look": 0.5}', '{"noul": 1}', '{"answers": {"look": {"noul": 0.125}}}', '{"answers": {"look": 0.75}}', '{"look": 7}', "none"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert one(rows.withColumn("l", g.find_look(F.col("t"))), "l") == [0.25, 0.5, 1.0, 0.125, 0.75, None, None]


def test_set_checks(spark):
    rows = [("s", 1.0, 100.0, "a"), ("s", 1.0, 150.0, "b"), ("s", 1.1, 100.0, "c"), ("s", 9.0, 0.0, None), ("t", 1.0, 0.0, "a"), ("t", 2.0, 0.0, "b")]
    photos = spark.createDataFrame(rows, "set_id string, head_size double, backdrop_luma double, output string")
    got = {(r.set_id, r.head_size): r.set_reasons for r in sets.judge_set(photos).collect()}
    assert got[("s", 1.1)] == ["head 10% larger than the rest of the set"]
    assert got[("t", 2.0)] == [] and got[("s", 9.0)] == []
    notes = {r.set_id: r.set_note for r in sets.set_note(sets.set_medians(photos)).collect()}
    assert notes == {"s": "backdrop brightness varies a lot across the set (100-150 of 255): shoot everyone in one spot", "t": None}


def test_a_sharpness_that_is_no_number_is_looked_at(spark):
    m = spark.createDataFrame([(1600, 2000, True, 0, 1, x) for x in (float("nan"), 0.6, 0.59, None)], "width int, height int, srgb boolean, metadata_tags int, face int, eye_sharpness double")
    assert [r.grade for r in g.judge(m).collect()] == ["REVIEW", "PASS", "REVIEW", "PASS"]


def test_deciders_by_name(spark):
    rows = spark.createDataFrame([(1, "PASS", "a.jpg", 0.9), (2, "PASS", "b.jpg", 0.1), (3, "FAIL", "c.jpg", 0.1), (4, "PASS", None, 0.9)], "photo_id int, grade string, output string, score double").withColumn("reasons", F.array().cast("array<string>"))
    g.register_decider("own", lambda df: df["score"])
    got = {r.photo_id: r.decide for r in g.decide_by(rows, "own").collect()}
    assert [(got[k]["by"], got[k]["grade"]) for k in (1, 2, 3)] == [("own", "REVIEW"), ("own", "PASS"), ("own", "FAIL")] and got[4] is None
    for name in ("local", "nobody", None, ""):  # a name that nobody has is the local decider
        got = {r.photo_id: r.decide for r in g.decide_by(rows, name).collect()}
        assert all(got[k]["by"] == "local" and got[k]["requested"] is None for k in (1, 2, 3))
    for name in ("local", ""):
        with pytest.raises(ValueError):
            g.register_decider(name, lambda df: df["score"])
