"""Each set by its own settings: one call equals a call for each."""

import numpy as np
from pyspark.sql import functions as F

from proofset.functions import framing, grading
from proofset.plans import passes
from test_passes import LISTING, measured, nothing, photos

OWN = {"a": (0.8, 1600, 1.0, 0.42, False), "b": (1.0, 900, 0.7, 0.5, True)}
SETTINGS = "set_id string, ratio double, width int, zoom double, eye_line double, bw boolean"


def settings(spark):
    return spark.createDataFrame([(s, *v) for s, v in OWN.items()], SETTINGS)


def test_judging_by_set_equals_a_call_for_each(spark):
    r = np.random.default_rng(1)
    rows = [(s, k, [1600, 900][k % 2], [2000, 900][k % 2], float(r.uniform(0.3, 0.7)), float(r.uniform(0, 0.4)), float(r.uniform(0, 90)), float(r.uniform(0, 70))) for s in ("a", "b", "c") for k in range(40)]
    m = spark.createDataFrame(rows, "set_id string, photo_id int, width int, height int, eye_line double, headroom double, skin_hue double, skin_chroma double")
    got = {(x.set_id, x.photo_id): (x.grade, x.reasons) for x in grading.judge_sets(m, settings(spark)).collect()}
    for s in ("a", "b", "c"):
        ratio, width, zoom, line, bw = OWN.get(s, OWN["a"])  # c has none: the defaults
        alone = grading.judge(m.filter(F.col("set_id") == s), (width, round(width / ratio)), line, zoom, bw).collect()
        assert all(got[s, x.photo_id] == (x.grade, x.reasons) for x in alone) and len(alone) == 40
    assert grading.judge_sets(m, settings(spark)).columns == [*m.columns, "grade", "reasons"]


def test_crops_by_set_equal_a_call_for_each(spark):
    r = np.random.default_rng(2)
    faces = []
    for k in range(60):
        x, y, d = float(r.uniform(300, 3700)), float(r.uniform(300, 2600)), float(r.uniform(40, 150))
        faces.append((["a", "b"][k % 2], k, [x - d, y - 0.9 * d, 2 * d, 2.6 * d], [[x - d / 2, y], [x + d / 2, y], [x, y + d / 2], [x - 0.35 * d, y + 0.9 * d], [x + 0.35 * d, y + 0.9 * d]], 4032, 3024, y - 1.2 * d if k % 3 else None))
    rows = spark.createDataFrame(faces, "set_id string, photo_id int, box array<double>, lm array<array<double>>, w int, h int, crown double")
    own, how = grading.with_settings(rows, settings(spark))
    together = grading.without_settings(framing.plan_crops(own, F.col("_set_ratio"), how["zoom"], how["eye_line"])).collect()
    for s, (ratio, _, zoom, line, _) in OWN.items():
        alone = framing.plan_crops(rows.filter(F.col("set_id") == s), ratio, zoom, line).collect()
        assert sorted(alone, key=lambda x: x.photo_id) == sorted((x for x in together if x.set_id == s), key=lambda x: x.photo_id)


def test_a_pass_judges_by_set(spark):
    rows = photos("a", "b")
    m = measured(spark, rows).withColumns({"eye_line": F.lit(0.5), "width": F.lit(900), "height": F.lit(900)})
    out = passes.run_sets(spark.createDataFrame(rows, LISTING), nothing(spark), m, F.lit("k"), settings=settings(spark))
    texts = {}
    for x in out.photos.filter("output is not null").collect():
        texts.setdefault(x.set_id, set()).update(x.reasons)
    assert "size 900x900, expected 1600x2000" in texts["a"] and not any(t.startswith("size") for t in texts["b"])
