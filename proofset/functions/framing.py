"""Faces and crop plans. Faces are rows (set_id, photo_id, box array[4], lm array[5][2], score)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofset.functions.grading import as_column, percent

HEAD_TO_FRAME = 3.4
# Fixed values of the crop search.
MOST_SLIDE, EASY_ZOOM, EASY_DRIFT, LEAST_ROOM, GOOD_ROOM, TOLERANCE = 0.12, 0.12, 0.10, 0.03, 0.06, 0.03


def output_size(width: Column, ratio: Column) -> Column:
    return F.array(width.cast("long"), F.bround(width / ratio).cast("long"))


def _xy(i: int, axis: int) -> Column:
    return F.col("lm")[i][axis]


def eye_middle() -> tuple[Column, Column]:
    return (_xy(0, 0) + _xy(1, 0)) / 2, (_xy(0, 1) + _xy(1, 1)) / 2


def eye_distance() -> Column:
    return F.hypot(_xy(1, 0) - _xy(0, 0), _xy(1, 1) - _xy(0, 1))


def face_scale() -> Column:
    ex, ey = eye_middle()
    mouth = F.hypot((_xy(3, 0) + _xy(4, 0)) / 2 - ex, (_xy(3, 1) + _xy(4, 1)) / 2 - ey)
    return F.greatest(2.0 * eye_distance(), 1.8 * mouth)


def moved(lm: Column, left: Column, top: Column, k: Column) -> Column:
    """Landmarks in the coordinates of a crop that begins at (left, top) and is scaled by k."""
    return F.transform(lm, lambda p: F.array((p[0] - left) * k, (p[1] - top) * k))


def head_share(scale: Column, zoom: Column, height: Column) -> Column:
    return HEAD_TO_FRAME * scale / zoom / height


def subject(faces: DataFrame, by: str = "scale", order: tuple[str, ...] = ()) -> DataFrame:
    """Each photo's largest face, with n_faces, second_scale, other_faces (scale above 0.4 of the subject's) and the
    note on more people. by: scale, or area of the box; order: columns that break ties."""
    sized = faces.withColumns({"scale": face_scale(), "area": F.col("box")[2] * F.col("box")[3]})
    w = Window.partitionBy("set_id", "photo_id")
    key = w.orderBy(F.desc("scale" if by == "scale" else "area"), *order)
    ranked = sized.withColumns({"_n": F.row_number().over(key), "n_faces": F.count(F.lit(1)).over(w), "_top": F.max("scale").over(w)})
    first = ranked.withColumns({"_second": F.lead("scale").over(key), "_others": F.sum(F.when((F.col("_n") > 1) & (F.col("scale") > 0.4 * F.col("_top")), 1).otherwise(0)).over(w)}).filter("_n = 1")
    note = F.when(F.col("_second") > 0.6 * F.col("scale"), F.concat(F.col("n_faces").cast("string"), F.lit(" people, framed the largest face")))
    return first.select(*faces.columns, "scale", "area", "n_faces", F.col("_second").alias("second_scale"), F.col("_others").alias("other_faces"), note.alias("people_note"))


def confident(faces: DataFrame, tiers: tuple[float, ...] = (0.8, 0.5, 0.3)) -> DataFrame:
    """Faces at the first tier at which their photo has any, with that tier as detect_threshold."""
    best = F.max("score").over(Window.partitionBy("set_id", "photo_id"))
    tier = F.lit(None).cast("double")
    for t in reversed(tiers):
        tier = F.when(F.col("_best") >= t, t).otherwise(tier)
    return faces.withColumn("_best", best).withColumn("detect_threshold", tier).filter(F.col("score") >= F.col("detect_threshold")).drop("_best")


def cut_side(w: Column, h: Column) -> Column:
    """The first side (left, right, top, bottom) of the photo that cuts the face off; NULL for none."""
    box = F.col("box")
    xs = F.concat(F.transform("lm", lambda p: p[0]), F.array(box[0], box[0] + box[2]))
    ys = F.concat(F.transform("lm", lambda p: p[1]), F.array(box[1], box[1] + box[3]))
    slack = TOLERANCE * box[2]
    return F.when(F.array_min(xs) < -slack, "left").when(F.array_max(xs) > w + slack, "right").when(F.array_min(ys) < -slack, "top").when(F.array_max(ys) > h + slack, "bottom")


def skip_reason(w: Column, h: Column) -> Column:
    side = cut_side(w, h)
    return F.when(side.isNotNull(), F.concat(F.lit("face is cut off at the "), side, F.lit(" edge of the photo")))


def search_boxes(cx, ey, scale, w, h, crown, ratio: float, zoom: float, eye_line: float) -> np.ndarray:
    """Least-cost crop of each face: columns left, top, right, bottom, zoom_in, drift, slide, fallback. All
    candidates of a face are one row of arrays; ties go to the tallest crop, then to the smallest drift."""
    ideal = HEAD_TO_FRAME * scale / zoom
    lifted = crown - 0.03 * scale
    known = np.isfinite(crown)
    steps = np.arange(0, 0.35 + 1e-9, 0.01)
    drifts = np.arange(-0.08, 0.25 + 1e-9, 0.005)
    tall = np.minimum(np.minimum(ideal[:, None] * (1 - steps), h[:, None]), w[:, None] / ratio)  # falls along the row
    wide = tall * ratio
    want = cx[:, None] - wide / 2
    left = np.clip(want, 0, w[:, None] - wide)
    slide = np.abs(left - want) / wide
    zoomed = 1 - tall / ideal[:, None]
    top = ey[:, None, None] - (eye_line + drifts) * tall[:, :, None]
    with np.errstate(invalid="ignore"):
        room = (lifted[:, None, None] - top) / tall[:, :, None]
        bad = (slide > MOST_SLIDE + 1e-6)[:, :, None] | (top < -0.5) | (top + tall[:, :, None] > h[:, None, None] + 0.5) | (known[:, None, None] & (room < LEAST_ROOM))
        tight = np.where(known[:, None, None], 3 * np.maximum(0, GOOD_ROOM - room), 0)
    cost = (3 * zoomed + 10 * np.maximum(0, zoomed - EASY_ZOOM) + slide)[:, :, None] + 4 * np.abs(drifts) + 20 * np.maximum(0, drifts - EASY_DRIFT) + tight
    cost[bad] = np.inf
    flat = cost.reshape(len(cx), -1)
    best = flat.argmin(1)
    i, d = np.divmod(best, len(drifts))
    row = np.arange(len(cx))
    none = ~np.isfinite(flat[row, best])
    high = np.where(none, np.minimum(np.minimum(ideal * (1 - EASY_ZOOM), h), w / ratio), tall[row, i])
    broad = high * ratio
    lefts = np.clip(cx - broad / 2, 0, w - broad)
    tops = np.where(none, np.clip(ey - eye_line * high, 0, np.maximum(0, h - high)), np.maximum(0.0, top[row, i, d]))
    drift = np.where(none, (ey - tops) / high - eye_line, drifts[d])
    return np.stack([lefts, tops, lefts + broad, tops + high, 1 - high / ideal, drift, np.abs(lefts - (cx - broad / 2)) / broad, none.astype(float)], 1)


def plan_crops(faces: DataFrame, ratio: float | Column = 0.8, zoom: float | Column = 1.0, eye_line: float | Column = 0.42, batch: int = 256) -> DataFrame:
    """faces (one per photo, with w, h and crown or NULL) plus crop (struct), planned_head and notes; a face that
    the photo cuts off gets skip_reason and no crop. The 2,412 candidates of a face never become rows. Settings may be
    columns: faces of equal settings are searched together."""
    ex, ey = eye_middle()
    rows = faces.withColumns({"skip_reason": skip_reason(F.col("w"), F.col("h")), "_s": face_scale(), "_x": ex, "_y": ey})
    rows = rows.withColumns({"_w": F.col("w").cast("double"), "_h": F.col("h").cast("double"), "_c": F.col("crown").cast("double")})
    rows = rows.withColumns({k: as_column(v).cast("double") for k, v in (("_ratio", ratio), ("_zoom", zoom), ("_line", eye_line))})
    names = ["left", "top", "right", "bottom", "zoom_in", "drift", "slide", "fallback"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                col = lambda n, b=b: b.column(n).to_numpy(zero_copy_only=False).astype(float)
                how, which = np.unique(np.stack([col("_ratio"), col("_zoom"), col("_line")], 1), axis=0, return_inverse=True)
                face, found = np.stack([col(n) for n in ("_x", "_y", "_s", "_w", "_h", "_c")]), np.zeros((b.num_rows, len(names)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    for k, (r, z, line) in enumerate(how.tolist()):
                        own = which.ravel() == k
                        found[own] = search_boxes(*face[:, own], r, z, line)
                plan = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(8)], names)
                yield pa.record_batch([*b.columns, plan], names=[*b.schema.names, "crop"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", crop struct<" + ",".join(f"{n}:double" for n in names) + ">"
    out = rows.mapInArrow(search, ddl)
    crop = F.col("crop")
    notes = F.array(
        F.when(crop["fallback"] > 0, "the photo doesn't leave room for the standard framing"),
        F.when(crop["zoom_in"] > 0.01, F.concat(F.lit("framed "), percent(crop["zoom_in"]), F.lit(" tighter to fit the photo"))),
        F.when(crop["drift"] > 0.01, F.concat(F.lit("eyes "), percent(crop["drift"]), F.lit(" lower than standard, to keep the whole head in"))).when(crop["drift"] < -0.01, F.concat(F.lit("eyes "), percent(-crop["drift"]), F.lit(" higher than standard (subject sits high in the photo)"))),
        F.when(crop["slide"] > 0.05, F.concat(percent(crop["slide"]), F.lit(" off-center (subject near the edge)"))),
    )
    kept = F.col("skip_reason").isNull()
    head = F.bround(HEAD_TO_FRAME * F.col("_s") / F.col("_zoom") / (crop["bottom"] - crop["top"]), 3)
    return out.withColumns({"planned_head": F.when(kept, head), "notes": F.when(kept, F.filter(notes, lambda n: n.isNotNull())), "crop": F.when(kept, crop)}).drop("_s", "_x", "_y", "_w", "_h", "_c", "_ratio", "_zoom", "_line")


def report_boxes() -> dict[str, Column]:
    """face_box in whole pixels as corners; box (of the crop) to one decimal."""
    b, c = F.col("box"), F.col("crop")
    return {"face_box": F.transform(F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]), lambda v: F.bround(v).cast("long")), "crop_box": F.transform(F.array(c["left"], c["top"], c["right"], c["bottom"]), lambda v: F.bround(v, 1))}


def upscale(width: Column) -> Column:
    return width / (F.col("crop")["right"] - F.col("crop")["left"])
