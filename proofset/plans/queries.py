"""The registered queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.functions import color, framing, grading, paths
from proofset.operators import grouping, inventory, sets
from proofset.plans import tables
from proofset.session import computed_once
from proofset.sources.report import read_events
from proofset.streaming.watch import grade_progress, latest, progress, quiet_sessions


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.judge(tables.measures(spark, sf_dir))


def grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.grade_counts(sets.with_final_grade(sets.judge_set(graded(spark, sf_dir))))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("photo_id", "grade", F.size("reasons").alias("n_reasons"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grading.decide(grading.stored(graded(spark, sf_dir)))
    d = F.col("decide")
    return rows.select("photo_id", "grade", d["grade"].alias("decided"), d["confidence"].alias("confidence"), F.coalesce(grading.remark(d), F.lit("")).alias("remark"))


def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.measures(spark, sf_dir)
    stats = sets.set_note(sets.set_medians(m))
    flagged = sets.judge_set(m).groupBy("set_id").agg(F.count_if(F.size("set_reasons") > 0).alias("n_flagged"))
    return stats.join(flagged, "set_id").select("set_id", F.round("head_median", 6).alias("head_median"), "n_heads", "set_note", "n_flagged")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sets.with_final_grade(sets.judge_set(graded(spark, sf_dir))).withColumn("reused", F.col("photo_id") % 3 == 0)
    return sets.run_summary(rows).select("set_id", "processed", "unchanged", "pages", "n_pass", "n_review", "n_fail", "n_skipped")


def picked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.pick_sources(tables.listing(spark, sf_dir).dropDuplicates(["set_id", "source"]).select("set_id", "source"))


def incremental_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A listing and a saved report."""
    o = tables.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    files = o.select(F.col("o_custkey").alias("set_id"), k.cast("string").alias("source"), k.alias("size"), (k * 1000).alias("mtime_ns"))
    report = o.filter(k % 11 != 0).select(F.col("o_custkey").alias("set_id"), k.cast("string").alias("source"), F.when(k % 13 == 0, "old").otherwise("key").alias("key"), (k + (k % 17 == 0).cast("int")).alias("size"), (k * 1000).alias("mtime_ns"), F.when(k % 23 > 0, "out.jpg").alias("output"), (k * 7).alias("out_mtime_ns"), (k % 19 == 0).alias("hand_edited"), F.when((k % 23 > 0) & (k % 31 > 0), k * 7 + (k % 37 == 0).cast("int")).alias("now_mtime_ns"))
    return files, report


def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, report = incremental_inputs(spark, sf_dir)
    return inventory.classify(files, report, F.lit("key")).groupBy("set_id", "class").agg(F.count(F.lit(1)).alias("n"))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "pages")
    name = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".JPG", "/a.webp", "/.hidden", "/IMG_12.tar.gz", "/")]), (F.col("page_id") % 5 + 1).cast("int")))
    rows = p.select("page_id", name.alias("p"))
    return rows.select("page_id", paths.extension_of(F.col("p")).alias("ext"), paths.parent_of(F.col("p")).alias("parent"), paths.is_supported(F.col("p")).alias("supported"), paths.shot_number(paths.file_name(F.col("p"))).cast("long").alias("shot"))


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "pages")
    k = F.col("page_id")
    path = F.concat(F.lit("/drop/"), ((k * 7) % 3).cast("string"), F.lit("/f"), k.cast("string"), F.when(k % 4 == 0, ".mov").otherwise(".jpg"))
    return inventory.resolve_drop(p.select((k % 90).alias("request_id"), path.alias("path"), (k % 13 == 0).alias("is_dir")))


def subject_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = framing.subject(tables.faces(spark, sf_dir), "area", ("l_partkey", "l_suppkey", "l_linenumber", "q"))
    return f.select("photo_id", F.round("scale", 6).alias("scale"), "n_faces", "other_faces", "people_note")


def crop_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = framing.subject(tables.faces(spark, sf_dir), "area", ("l_partkey", "l_suppkey", "l_linenumber", "q"))
    return framing.plan_crops(f).select("photo_id", "skip_reason", "planned_head", F.array_join("notes", "; ").alias("notes"), *[F.round(F.col("crop")[c], 3).alias(c) for c in ("left", "top", "right", "bottom")])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = tables.read(spark, sf_dir, "lineitem")
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return i.select(s.alias("photo_id"), k.alias("x"), F.col("l_orderkey").alias("y"), n.alias("n"), F.col("l_quantity").cast("int").alias("q"), (k * 5 % 256).cast("int").alias("r"), (k * 3 % 256).cast("int").alias("g"), ((k + s) % 256).cast("int").alias("b"))


def pixel_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    dim = lambda c: F.floor(F.col(c) / 2).cast("int").alias(f"{c}0")
    m = color.pixel_measures(p.select("photo_id", "x", "y", "r", "g", "b", dim("r"), dim("g"), dim("b")))
    backdrop = color.backdrop_luma(p)
    return m.join(backdrop, "photo_id").select("photo_id", *[F.round(c, 6).alias(c) for c in ("face_blown", "clipping_added", "crushing_added", "black_point", "white_point", "backdrop_luma")])


def skin_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = color.skin_lab(pixels(spark, sf_dir))
    gains, cast = color.cast_fix(F.col("skin_L"), F.col("skin_a"), F.col("skin_b"))
    hue, chroma = color.hue_chroma(F.col("skin_a"), F.col("skin_b"))
    return s.select("photo_id", *[F.round(c, 4).alias(c) for c in ("skin_L", "skin_a", "skin_b")], F.round(hue, 3).alias("hue"), F.round(chroma, 4).alias("chroma"), *[F.round(gains[i], 4).alias(f"gain_{c}") for i, c in enumerate("rgb")], cast.alias("cast"))


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kept, _, _ = grouping.intake(tables.fingerprints(spark, sf_dir))
    return kept, kept.select("set_id", "idx", "photo_id", "name", (F.col("photo_id") % 7).alias("group_no"))


def pair_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, members = _members(spark, sf_dir)
    links = computed_once(grouping.group_links(kept, members))
    apart = grouping.separation(grouping.weakest_inside(links), grouping.group_pairs(links))
    return apart.select("set_id", *[F.round(c, 6).alias(c) for c in ("weakest", "weakest_median", "closest", "closest_median", "gap")], "n_pairs")


def lonely_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, members = _members(spark, sf_dir)
    return grouping.loneliest(grouping.best_other(kept), members).select("set_id", "place", "photo_id", "group_no", F.round("best_other", 6).alias("best_other"))


def group_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = _members(spark, sf_dir)
    return grouping.spans(members).join(grouping.broken_runs(members, most=100), ["set_id", "group_no"], "left").select("set_id", "group_no", "first", "last", "shots", "span", "one_run", "skipping")


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = _members(spark, sf_dir)
    k = F.col("photo_id")
    report = members.filter(k % 5 > 0).select("set_id", F.col("name").alias("output"), F.concat(F.lit("src"), k.cast("string")).alias("source"), F.when(k % 3 == 0, "FAIL").otherwise("PASS").alias("grade"), F.when(k % 2 == 0, F.array(F.lit("why"))).otherwise(F.array().cast("array<string>")).alias("reasons"), ((k % 11) / 10).alias("eye_sharpness"), (0.9 + (k % 7) / 20).alias("head_size"))
    return grouping.picks(grouping.frames(grouping.with_report(members, report))).select("set_id", "photo_id", "group_no", "frame_of", "source", "pick")


def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each set at its own most stable cut."""
    kept, _, _ = grouping.intake(tables.fingerprints(spark, sf_dir))
    history = computed_once(grouping.histories(kept))
    cut = grouping.operating_cut(kept, grouping.plateau(grouping.sweep(history, kept)))
    return grouping.assign(history, kept, cut).select("set_id", "idx", "group_no", "student")


def cut_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _, _ = grouping.intake(tables.fingerprints(spark, sf_dir))
    return grouping.change_points(grouping.sweep(grouping.histories(kept), kept))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    k = F.col("event_id")
    grade = F.element_at(F.array(*[F.lit(g) for g in ("PASS", "REVIEW", "FAIL", "SKIPPED")]), (k % 4 + 1).cast("int"))
    line = F.when(k % 10 == 0, "{broken").when(k % 10 == 1, '{"event":"other"}').otherwise(F.to_json(F.struct(F.lit("photo").alias("event"), F.concat(F.lit("s"), (k % 20).cast("string")).alias("source"), grade.alias("grade"), F.array().cast("array<string>").alias("reasons"), F.array().cast("array<string>").alias("notes"))))
    return read_events(e.select(F.col("user_id").alias("set_id"), "event_id", F.col("ts").alias("seen_at"), line.alias("value")), "photo")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_progress(_events(spark, sf_dir))


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_events(spark, sf_dir).select("set_id", "source", "event_id", "grade"), "event_id").select("set_id", "source", "event_id", "grade")


def event_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return progress(e, e.groupBy("set_id").agg(F.count(F.lit(1)).alias("total")), "event_id").select("set_id", "event_id", "done", "total", "percent")


def folder_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("set_id"), F.col("ts").alias("seen_at"))
    return quiet_sessions(e, "2 hours").select("set_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "changes")


QUERIES = {f.__name__: f for f in (grade_counts, judged, decisions, set_checks, run_summary, picked_sources, incremental_plan, path_functions, intake, subject_faces, crop_plans, pixel_shares, skin_colour, pair_diagnostics, lonely_photos, group_runs, picks, clustering, cut_sweep, event_counts, latest_events, event_progress, folder_sessions)}
