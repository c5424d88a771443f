"""Grades, decisions and near-misses as Column expressions over a table of measures.

A NULL measure means that its check did not run. Grades are compared on raw values; what is stored is rounded
half to even."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADES = ("PASS", "REVIEW", "FAIL")
# One-sided checks (metric, line, slack, whether the pass side is above).
NEAR = (("eye_sharpness", 0.6, 0.05, True), ("face_blown", 0.03, 0.005, False), ("clipping_added", 0.005, 0.001, False), ("crushing_added", 0.005, 0.001, False), ("sharpen_gain", 1.6, 0.05, False), ("upscale", 1.5, 0.05, False))
ROUNDED = {"eye_line": 3, "headroom": 3, "center": 3, "head_size": 3, "planned_head": 3, "face_blown": 4, "skin_hue": 1, "skin_chroma": 1, "eye_sharpness": 2, "fidelity_ssim": 3, "clipping_added": 4, "crushing_added": 4, "face_lightness_change": 1, "sharpen_gain": 2, "upscale": 2}
LOOK_AT, SURE, NEAR_LOOK = 0.4, 0.9, 0.55


def percent(x: Column) -> Column:
    """'12%', rounded half to even."""
    return F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))


def fixed(x: Column, digits: int) -> Column:
    return F.bround(x, digits).cast(f"decimal(20,{digits})").cast("string")


def rank_of(grade: Column) -> Column:
    return F.when(grade == "FAIL", 2).when(grade == "REVIEW", 1).otherwise(0)


def grade_of(rank: Column) -> Column:
    return F.when(rank == 2, "FAIL").when(rank == 1, "REVIEW").otherwise("PASS")


def band(x: Column, ok: tuple[float, float], review: tuple[float, float]) -> Column:
    """0, 1 or 2 for PASS, REVIEW or FAIL; both ends belong to a band; NaN is FAIL."""
    return F.when(x.between(*ok), 0).when(x.between(*review), 1).otherwise(2)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def judge(measures: DataFrame, size: tuple = (1600, 2000), eye_line: float | Column = 0.42, zoom: float | Column = 1.0, bw: bool | Column = False) -> DataFrame:
    """measures plus grade and reasons (array, in the order of the checks). Columns that are missing count as
    checks that did not run; without a face only the first four checks run. Any of the settings may be a column, so
    that every set is judged by its own; see with_settings()."""
    have = set(measures.columns)
    width, height, line, zoom, bw = (as_column(v) for v in (*size, eye_line, zoom, bw))
    c = lambda name: F.col(name) if name in have else F.lit(None).cast("double")
    hit = lambda when, rank, why: F.when(when, F.struct(F.lit(rank).alias("rank"), why.alias("why")))
    graded = lambda x, r, why: F.when(x.isNotNull() & (r > 0), F.struct(r.alias("rank"), why.alias("why")))
    text = F.lit
    eye, centre, head, plan = c("eye_line"), c("center") - 0.5, c("head_size"), c("planned_head")
    room, hue, chroma, change = c("headroom"), c("skin_hue"), c("skin_chroma"), F.abs(c("face_lightness_change"))
    roomy = 0.2 + 0.4 * F.greatest(F.lit(0.0), 1 - zoom)
    face = F.coalesce(c("face"), F.lit(1)) > 0
    first = [
        hit((c("width") != width) | (c("height") != height), 2, F.concat(text("size "), c("width").cast("long").cast("string"), text("x"), c("height").cast("long").cast("string"), text(", expected "), width.cast("long").cast("string"), text("x"), height.cast("long").cast("string"))),
        hit(~c("srgb").cast("boolean"), 2, text("no sRGB color profile")),
        hit(c("metadata_tags") > 0, 2, text("metadata (EXIF/GPS) not stripped")),
        hit(~face, 2, text("no face found in the output")),
    ]
    rest = [
        graded(eye, band(eye - line, (-0.03, 0.11), (-0.10, 0.16)), F.concat(text("eyes at "), percent(eye), text(" from the top, not "), percent(line))),
        hit(~room.between(0.02, roomy), 1, F.when(room < 0.005, "top of the head is cut off").when(room < 0.02, "top of the head is tight to the edge").otherwise("a lot of empty space above the head")),
        graded(centre, band(centre, (-0.04, 0.04), (-0.15, 0.15)), F.concat(text("face "), percent(F.abs(centre)), text(" off-center"))),
        graded(head, F.when(plan.isNull(), band(head, (0.9, 1.1), (0.75, 1.3))).otherwise(band(head / plan, (0.92, 1.08), (0.8, 1.25))), F.when(plan.isNull(), F.concat(text("head "), fixed(head, 2), text("x the standard size"))).otherwise(F.concat(text("head "), fixed(head, 2), text("x the requested size, but the crop planned "), fixed(plan, 2), text("x")))),
        hit(c("other_faces") > 0, 1, text("someone else's face is in the frame")),
        hit(c("face_blown") > 0.03, 1, F.concat(percent(c("face_blown")), text(" of the face is blown out (harsh light or shine)"))),
        hit(~bw & hue.isNotNull() & ~((chroma < 6) | (hue.between(28, 77) & (chroma <= 57))), 1, F.concat(text("skin color looks off (hue "), F.bround(hue).cast("int").cast("string"), text(", chroma "), F.bround(chroma).cast("int").cast("string"), text(")"))),
        hit(F.isnan(c("eye_sharpness")) | (c("eye_sharpness") < 0.6), 1, text("eyes look soft (focus miss or motion?)")),
        graded(c("fidelity_ssim"), band(c("fidelity_ssim"), (0.9, 1.0), (0.8, 1.0)), F.concat(text("edit changed the photo a lot (SSIM "), fixed(c("fidelity_ssim"), 2), text(")"))),
        hit(c("clipping_added") > 0.005, 1, F.concat(text("the edit blew out "), fixed(c("clipping_added") * 100, 1), text("% of the face"))),
        hit(c("crushing_added") > 0.005, 1, F.concat(text("the edit crushed "), fixed(c("crushing_added") * 100, 1), text("% of the face to black"))),
        graded(change, band(change, (0.0, 8.0), (0.0, 20.0)), F.concat(text("the edit changed face brightness a lot ("), F.when(c("face_lightness_change") >= 0, "+").otherwise(""), F.bround(c("face_lightness_change")).cast("int").cast("string"), text(" L*)"))),
        hit(c("sharpen_gain") > 1.6, 1, text("looks over-sharpened")),
        hit(c("upscale") > 1.5, 1, F.concat(text("low resolution: enlarged "), fixed(c("upscale"), 1), text("x (face small in the photo)"))),
    ]
    hits = F.filter(F.array(*first, *[F.when(face, x) for x in rest]), lambda x: x.isNotNull())
    out = measures.withColumn("_hits", hits)
    return out.withColumns({"grade": grade_of(F.coalesce(F.array_max(F.transform("_hits", lambda x: x["rank"])), F.lit(0))), "reasons": F.transform("_hits", lambda x: x["why"])}).drop("_hits")


def with_settings(rows: DataFrame, settings: DataFrame) -> tuple[DataFrame, dict]:
    """rows joined with their set's settings (set_id, ratio, width, zoom, eye_line, bw; the defaults where a set has
    none), under names that begin with _set_, and what judge() takes for them. One row of settings for each set."""
    names = {"ratio": 0.8, "width": 1600, "zoom": 1.0, "eye_line": 0.42, "bw": False}
    own = settings.select(F.col("set_id").alias("_set_id"), *[F.col(c).alias(f"_set_{c}") for c in names])
    out = rows.join(own, F.col("set_id").eqNullSafe(F.col("_set_id")), "left").drop("_set_id")
    out = out.withColumns({f"_set_{c}": F.coalesce(f"_set_{c}", F.lit(v)) for c, v in names.items()})
    size = (F.col("_set_width"), F.bround(F.col("_set_width") / F.col("_set_ratio")).cast("long"))
    return out, {"size": size, "eye_line": F.col("_set_eye_line"), "zoom": F.col("_set_zoom"), "bw": F.col("_set_bw")}


def without_settings(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_set_")])


def judge_sets(measures: DataFrame, settings: DataFrame) -> DataFrame:
    """judge() with each set's own settings."""
    rows, how = with_settings(measures, settings)
    return without_settings(judge(rows, **how))


def stored(measures: DataFrame) -> DataFrame:
    """The measures as the report keeps them: rounded half to even."""
    return measures.withColumns({k: F.bround(F.col(k), n) for k, n in ROUNDED.items() if k in measures.columns})


def rejudged(rows: DataFrame, note: str = "edited by hand; kept your version", **settings) -> DataFrame:
    """Rows edited by hand: judged anew without the upscale check, the fixed note moved to the end of `notes`."""
    again = judge(rows.drop("upscale", "grade", "reasons"), **settings)
    return again.withColumns({"notes": F.concat(F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda n: n != note), F.array(F.lit(note))), "hand_edited": F.lit(True)})


def near_hits(have: set[str]) -> Column:
    """Stored metrics just inside their line, in rule order: array of (name, value)."""
    rules = []
    for name, line, slack, above in NEAR:
        if name in have:
            v = F.col(name).cast("double")
            close = (v >= line) & (v < line + slack) if above else (v > line - slack) & (v <= line)
            rules.append(F.when(close & ~F.isnan(v), F.struct(F.lit(name).alias("name"), v.alias("value"))))
    if not rules:
        return F.expr("cast(array() as array<struct<name:string,value:double>>)")
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def local_look(grade: Column, reasons: Column, hits: Column) -> Column:
    base = F.when(grade == "REVIEW", F.least(F.lit(0.95), 0.75 + 0.05 * F.least(F.size(reasons), F.lit(4)))).when(grade == "PASS", 0.05).otherwise(1.0)
    return F.bround(F.when(F.size(hits) > 0, F.greatest(base, F.lit(NEAR_LOOK))).otherwise(base), 2)


def settled(look: Column, grade: Column) -> tuple[Column, Column]:
    """Grade and confidence for a look; never lowers REVIEW or FAIL."""
    sane = F.when(look.isNull() | F.isnan(look) | (F.abs(look) == float("inf")), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), look)))
    final = F.when((grade == "PASS") & (sane >= LOOK_AT), "REVIEW").otherwise(grade)
    return final, F.bround(F.when(final == "PASS", 1.0 - sane).otherwise(sane), 2)


def near_note(hits: Column) -> Column:
    shown = F.transform(F.slice(hits, 1, 2), lambda h: F.concat(F.replace(h["name"], F.lit("_"), F.lit(" ")), F.lit(" "), F.regexp_replace(h["value"].cast("string"), r"\.0$", "")))
    return F.when(F.size(hits) > 0, F.concat(F.lit("close to the line: "), F.array_join(shown, ", "))).otherwise("")


def basis_of(by: Column, grade: Column, reasons: Column, have: set[str]) -> Column:
    """16 hex digits that change when anything that a decision rests on changes."""
    metrics = [F.col(k).alias(k) for k in sorted(have & set(ROUNDED))]
    return F.substring(F.sha2(F.to_json(F.struct(by.alias("by"), grade.alias("grade"), F.struct(*metrics).alias("metrics"), F.when(by == "local", "local").otherwise("remote").alias("model"), reasons.alias("reasons"))), 256), 1, 16)


def decide(rows: DataFrame, look: Column | None = None, by: str = "local", saved: Column | None = None) -> DataFrame:
    """rows plus `decide` (by, grade, confidence, note, basis, requested); NULL where there is no output or the
    grade is SKIPPED. look: scores from elsewhere, used when finite and within 0..1, else the local look is. saved:
    an earlier `decide` struct, taken again if it was made by the same decider on an equal basis."""
    have = set(rows.columns)
    grade, reasons = F.col("grade"), F.coalesce("reasons", F.array().cast("array<string>"))
    # each step reads the one before as a column, so that nothing is computed again for every place that needs it
    steps = rows.withColumn("_near", near_hits(have)).withColumn("_local", local_look(grade, reasons, F.col("_near")))
    hits, local = F.col("_near"), F.col("_local")
    given = look if look is not None else F.lit(None).cast("double")
    steps = steps.withColumn("_given", F.when(given.between(0.0, 1.0) & ~F.isnan(given), given))
    usable = F.col("_given").isNotNull()
    steps = steps.withColumn("_look", F.coalesce("_given", local))
    final, confidence = settled(F.col("_look"), grade)
    maker = F.when(usable, by).otherwise("local")
    note = F.when(~usable & (grade == "PASS") & (local >= LOOK_AT), near_note(hits)).otherwise("")
    made = F.struct(maker.alias("by"), final.alias("grade"), confidence.alias("confidence"), note.alias("note"), basis_of(maker, grade, reasons, have).alias("basis"), F.when(~usable & F.lit(by != "local"), F.lit(by)).alias("requested"))
    if saved is not None:
        same = (saved["by"] == by) & (saved["basis"] == basis_of(F.lit(by), grade, reasons, have)) & saved["grade"].isin(*GRADES) & saved["confidence"].isNotNull() & ~F.isnan(saved["confidence"]) & (F.lit(by) != "local")
        made = F.when(F.coalesce(same, F.lit(False)), saved).otherwise(made)
    return steps.withColumn("decide", F.when(F.col("output").isNotNull() & (grade != "SKIPPED"), made)).drop("_near", "_local", "_given", "_look")


@dataclass(frozen=True)
class Decider:
    """Where the looks of a decision come from. look: makes a column of scores (built-in functions or a pandas UDF) from
    the rows; none for the local look."""

    name: str
    look: Callable[[DataFrame], Column] | None = None


DECIDERS = {"local": Decider("local")}


def register_decider(name: str, look: Callable[[DataFrame], Column]) -> Decider:
    """Make a decider known by name; `local` cannot be replaced."""
    if name == "local" or not name:
        raise ValueError(f"{name!r} cannot name a decider of one's own")
    DECIDERS[name] = Decider(name, look)
    return DECIDERS[name]


def chosen(name: str | None) -> Decider:
    """The decider of that name; the local one if there is none."""
    return DECIDERS.get(name or "local", DECIDERS["local"])


def decide_by(rows: DataFrame, name: str | None, saved: Column | None = None) -> DataFrame:
    """decide() by the decider of that name. Whoever gives the look, grades only ever rise, as decide() settles them."""
    known = chosen(name)
    return decide(rows, known.look(rows) if known.look else None, known.name, saved if known.look else None)


def final_grade(set_reasons: Column, decided: Column | None = None) -> Column:
    """SKIPPED without output; the decision's grade if it is valid; at least REVIEW with reasons of the set."""
    grade = F.col("grade") if decided is None else F.when(decided.isin(*GRADES), decided).otherwise(F.col("grade"))
    least = F.when(F.size(F.coalesce(set_reasons, F.array().cast("array<string>"))) > 0, 1).otherwise(0)
    return F.when(F.col("output").isNull(), "SKIPPED").otherwise(grade_of(F.greatest(rank_of(grade), least)))


def remark(decided: Column) -> Column:
    sure = F.concat(percent(decided["confidence"]), F.lit(" sure"))
    text = F.concat(sure, F.when(F.coalesce(decided["note"], F.lit("")) != "", F.concat(F.lit(", "), decided["note"])).otherwise(""))
    quiet = decided.isNull() | decided["confidence"].isNull() | F.isnan(decided["confidence"]) | ((decided["grade"] == "PASS") & (decided["confidence"] >= SURE))
    return F.when(quiet, "").otherwise(text)


def find_look(answer: Column) -> Column:
    """The probability in a scorer's JSON answer, wherever it stands; NULL if there is none within 0..1."""
    tries = [answer, *[F.get_json_object(answer, p) for p in ("$.look", "$.noul", "$.answers.look.noul", "$.answers.look")]]
    found = F.coalesce(*[F.when(t.rlike(r"^\s*-?[0-9.]+([eE][-+]?[0-9]+)?\s*$"), t.try_cast("double")) for t in tries])
    return F.when(found.between(0.0, 1.0), found)


def compact(numbers: Column, texts: Column | None = None) -> list[Column]:
    """Metric maps that may leave the house: no keys with slashes, finite numbers, short texts without slashes."""
    plain = lambda k: ~k.contains("/") & ~k.contains("\\")
    out = [F.map_filter(numbers, lambda k, v: plain(k) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))]
    if texts is not None:
        out.append(F.map_filter(texts, lambda k, v: plain(k) & plain(v) & (F.char_length(v) <= 80)))
    return out


def compact_array(values: Column) -> Column:
    fine = (F.size(values) <= 8) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, values)
