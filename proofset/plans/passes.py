"""Whole passes over many sets, each one call: grading what is new in every set, and grouping every set by person."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofset.functions import grading
from proofset.operators import grouping, inventory, sets
from proofset.session import computed_once, stored_once
from proofset.sources import report as reports


@dataclass(frozen=True)
class SetRun:
    photos: DataFrame  # every entry of the new report, with class, set_reasons and final_grade
    summary: DataFrame  # one row per set
    events: DataFrame  # set_id, value: the event log's lines

    def documents(self, settings: DataFrame) -> DataFrame:
        """Report documents of the sets of this pass, for write_reports(). settings: set_id, settings (struct)."""
        notes = settings.select("set_id", "settings").join(self.summary.select("set_id", "set_note"), "set_id")
        return reports.report_documents(reports.nested(self.photos), notes)


NO_MEASURES = "couldn't process (no measures)"
_TEXTS = "array<string>"
# What the measures of a photo may hold besides what is judged; all of it is taken into the report.
_MEASURED = ["planned_head", "width", "height", *[c for c in reports.METRIC_TYPES if c not in ("size", "planned_head_size")]]
_FRAMED = ["src_wh", "face_box", "box"]


def with_output_times(report: DataFrame, outputs: DataFrame) -> DataFrame:
    """The report's rows with now_mtime_ns, the time that their output file has now. outputs: a listing of the polished
    files (set_id, source, mtime_ns)."""
    now = outputs.select("set_id", F.col("source").alias("output"), F.col("mtime_ns").alias("now_mtime_ns"))
    return report.drop("now_mtime_ns").join(now, ["set_id", "output"], "left")


def run_sets(listing: DataFrame, report: DataFrame, measures: DataFrame, key: Column, sidecars: DataFrame | None = None, force: bool = False, look: str | None = None, by: str = "local", settings: DataFrame | None = None) -> SetRun:
    """One grading pass. listing: set_id, source, size, mtime_ns. report: the saved rows (see classify(); with grade,
    reasons, notes, decide and a column for each metric, as far as they are known, see flat()). measures: set_id,
    source, output and any metrics, or skip_reason for a photo that has no output.

    Unchanged rows are taken over; those edited by hand keep their entry and notes and are judged anew, without the
    upscale check; all others are judged. All are decided, taken over or not. A listed photo without measures is an
    entry too, SKIPPED with its reason; edited by hand, it keeps its metrics and time until there are new ones. look:
    the column of measures with scores of another decider, whose saved decisions are taken again on an equal basis.
    settings: each set's own (see with_settings()), by which its photos are judged; key should tell them apart.
    The classes, and the rows that the checks over the set, the summary and the events all need, are stored once, at the
    call (see stored_once())."""
    none = F.lit(None)
    classified = stored_once(inventory.classify(inventory.pick_sources(listing, sidecars), report, key, force).withColumn("_key", key))
    kinds = {r["class"] for r in classified.select("class").distinct().collect()}  # three at most
    empty = lambda df: df.filter(F.lit(False))  # noqa: E731  so that nothing is moved for a class without photos
    report = report if kinds & {"reuse", "hand_edited"} else empty(report)
    measures = measures if kinds & {"todo", "hand_edited"} else empty(measures)
    known = [c for c in ("size", "mtime_ns", "key", "output", "out_mtime_ns", "hand_edited", "grade", "reasons", "notes", "decide", *_MEASURED, *_FRAMED) if c in report.columns]
    old = report.select("set_id", "source", *known, "now_mtime_ns")
    of_class = lambda kind: classified.filter(F.col("class") == kind) if kind in kinds else empty(classified)
    listed = lambda kind: of_class(kind).select("set_id", "source", "class")
    texts = lambda df, c: F.coalesce(F.col(c).cast(_TEXTS) if c in df.columns else none.cast(_TEXTS), F.array().cast(_TEXTS))

    reused = old.join(listed("reuse"), ["set_id", "source"]).drop("now_mtime_ns")
    reused = reused.withColumns({"reasons": texts(reused, "reasons"), "notes": texts(reused, "notes")})

    kept = [c for c in (*_MEASURED, *_FRAMED, "skip_reason", "output", "out_mtime_ns", *([look] if look else [])) if c in measures.columns]
    given = measures.select("set_id", "source", *kept, F.lit(True).alias("_measured"), *([F.col("notes").alias("_more")] if "notes" in measures.columns else []))
    todo = of_class("todo")
    todo = todo.withColumn("notes", texts(todo, "notes")).select("set_id", "source", "class", "size", "mtime_ns", F.col("_key").alias("key"), "notes").join(given, ["set_id", "source"], "left")
    todo = todo.withColumn("notes", F.concat("notes", texts(todo, "_more"))).drop("_more")
    how: dict = {}
    if settings is not None:
        todo, how = grading.with_settings(todo, settings)
    judged = grading.without_settings(grading.stored(grading.judge(todo, **how)))
    why = F.coalesce(F.col("skip_reason") if "skip_reason" in todo.columns else none.cast("string"), F.when(F.col("_measured").isNull(), F.lit(NO_MEASURES)))
    lost = F.col("output").isNull()
    fresh = judged.withColumns({"reasons": F.when(lost, F.filter(F.concat(F.array(why), F.when(why.isNull(), F.col("reasons")).otherwise(F.array().cast(_TEXTS))), lambda r: r.isNotNull())).otherwise(F.col("reasons")), "grade": F.when(lost, "SKIPPED").otherwise(F.col("grade"))}).drop("skip_reason", "_measured")

    edited = old.join(listed("hand_edited"), ["set_id", "source"])
    edited = edited.withColumn("notes", texts(edited, "notes"))
    metrics = [c for c in (*_MEASURED, *([look] if look else [])) if c in measures.columns and c != "planned_head"]
    seen = edited.drop(*metrics, "grade", "reasons").join(given.select("set_id", "source", *metrics), ["set_id", "source"])
    if settings is not None:
        seen, how = grading.with_settings(seen, settings)
    again = grading.without_settings(grading.stored(grading.rejudged(seen, **how))).withColumn("out_mtime_ns", F.col("now_mtime_ns")).drop("now_mtime_ns")
    unseen = edited.join(given.select("set_id", "source"), ["set_id", "source"], "left_anti").drop("now_mtime_ns")
    unseen = unseen.withColumn("reasons", texts(unseen, "reasons"))

    photos = fresh
    for part in (again, unseen, reused):
        photos = inventory.merged_report(photos, part)
    saved = "decide" in photos.columns
    if saved:
        photos = photos.withColumnRenamed("decide", "_saved")
    score = F.col(look).cast("double") if look else None
    photos = grading.decide(photos, score, by, F.col("_saved") if saved and by != "local" else None).drop("_saved")
    photos = stored_once(photos.withColumn("reused", F.col("class") == "reuse"))
    photos = sets.with_final_grade(sets.judge_set(photos))
    summary = sets.run_summary(photos)
    told = F.when(~F.col("reused"), F.col("decide"))
    event = reports.event_line("photo", F.col("source"), F.col("final_grade").alias("grade"), F.col("reasons"), F.col("notes"), F.col("output"), told["confidence"].alias("confidence"), told.alias("decide"))
    start = inventory.start_totals(classified).select("set_id", reports.event_line("start", F.col("total"), F.col("unchanged")).alias("value"))
    counts = F.create_map(*[x for g in (*grading.GRADES, "SKIPPED") for x in (F.lit(g), F.col(f"n_{g.lower()}"))])
    done = summary.select("set_id", reports.event_line("polished", F.col("processed"), F.col("unchanged"), counts.alias("counts"), F.col("n_flagged").alias("flagged"), F.col("set_note"), F.col("pages")).alias("value"))
    return SetRun(photos, summary, start.unionByName(photos.select("set_id", event.alias("value"))).unionByName(done))


@dataclass(frozen=True)
class SetAnalysis:
    members: DataFrame  # set_id, idx, name, group_no, student, frame_of, source, grade, fit, pick
    result: DataFrame  # one nested row per set
    lines: DataFrame  # the text summary


def analyze_sets(prints: DataFrame, report: DataFrame, asked: float | None = None) -> SetAnalysis:
    """From fingerprints (set_id, photo_id, name, vec, detect_threshold) and the report's rows by output: groups at the
    asked cut or each set's own most stable one, picks, fits, and what to doubt. Vectors stay inside their set. What
    several results need (merges, members, weakest and closest pairs of groups; never vectors) is computed once, at the call."""
    kept, skipped, weak = grouping.intake(prints)
    history = computed_once(grouping.histories(kept))
    counts = computed_once(grouping.sweep(history, kept))
    cut = grouping.operating_cut(kept, grouping.plateau(counts), asked)
    groups = grouping.assign(history, kept, cut)
    members = grouping.frames(groups.join(kept.select("set_id", "idx", "photo_id", "name"), ["set_id", "idx"]))
    members = computed_once(grouping.picks(grouping.with_report(members, report)).join(grouping.fit_to_group(kept, members), ["set_id", "idx"]))
    inside = computed_once(grouping.weakest_pairs(kept, members))
    between, closest = grouping.between_groups(kept, members)
    name = lambda i, as_: members.select("set_id", F.col("idx").alias(i), F.col("name").alias(as_))
    weakest = grouping.weakest_groups(inside).join(name("i", "first_name"), ["set_id", "i"]).join(name("j", "second_name"), ["set_id", "j"])
    lines = reports.summary_lines(grouping.totals(members), cut, grouping.change_points(counts), grouping.separation(inside, between), grouping.group_sizes(members), closest, members, grouping.broken_runs(members), weakest, grouping.loneliest(grouping.best_other(kept), members), weak, skipped)
    return SetAnalysis(members, grouping.grouped_result(members, cut, counts), lines)
