"""Checks and counts over whole sets. Every shuffle is on set_id and carries counts or a few numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofset.functions.grading import GRADES, final_grade, percent


def _graded() -> Column:
    return F.col("output").isNotNull() & F.col("head_size").isNotNull()


def _spread() -> list[Column]:
    backdrop = F.when(_graded(), F.col("backdrop_luma"))
    return [F.min(backdrop).alias("low"), F.max(backdrop).alias("high"), F.count(backdrop).alias("n_backdrops")]


def set_medians(photos: DataFrame) -> DataFrame:
    """set_id, head_median, n_heads, lowest and highest backdrop, n_backdrops: of photos with output and head size."""
    return photos.groupBy("set_id").agg(F.median(F.when(_graded(), F.col("head_size"))).alias("head_median"), F.count(F.when(_graded(), 1)).alias("n_heads"), *_spread())


def set_note(stats: DataFrame) -> DataFrame:
    far = (F.col("n_backdrops") >= 2) & (F.col("high") - F.col("low") > 40)
    whole = lambda c: F.bround(F.col(c)).cast("int").cast("string")
    note = F.concat(F.lit("backdrop brightness varies a lot across the set ("), whole("low"), F.lit("-"), whole("high"), F.lit(" of 255): shoot everyone in one spot"))
    return stats.withColumn("set_note", F.when(far, note))


def judge_set(photos: DataFrame) -> DataFrame:
    """photos plus set_reasons: head sizes more than 8 % from the set's median, in sets of three or more."""
    stats = set_medians(photos).filter("n_heads >= 3").select("set_id", "head_median")
    off = F.col("head_size") / F.col("head_median") - 1
    flagged = F.col("output").isNotNull() & (F.abs(off) > 0.08)
    why = F.concat(F.lit("head "), percent(F.abs(off)), F.when(off > 0, " larger").otherwise(" smaller"), F.lit(" than the rest of the set"))
    none = F.array().cast("array<string>")
    return photos.join(stats, "set_id", "left").withColumn("set_reasons", F.when(flagged, F.array(why)).otherwise(none)).drop("head_median")


def with_final_grade(photos: DataFrame) -> DataFrame:
    decided = F.col("decide.grade") if "decide" in photos.columns else None
    return photos.withColumn("final_grade", final_grade(F.col("set_reasons"), decided))


def _counts() -> list[Column]:
    counts = [F.count_if(F.col("final_grade") == g).alias(f"n_{g.lower()}") for g in (*GRADES, "SKIPPED")]
    return [*counts, F.count_if(F.size("set_reasons") > 0).alias("n_flagged"), F.max(F.col("final_grade") == "FAIL").alias("failed")]


def grade_counts(photos: DataFrame, totals: bool = False) -> DataFrame:
    """Photos of each shown grade per set, zeros included; totals adds a row with a NULL set_id for all sets."""
    groups = photos.rollup("set_id") if totals else photos.groupBy("set_id")
    return groups.agg(*_counts())


def run_summary(photos: DataFrame, page: int = 30) -> DataFrame:
    """One row per set: processed, unchanged, counts, flagged, note and pages, all in one aggregation. `reused` marks
    unchanged rows."""
    pages = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / page)).cast("long").alias("pages")
    more = [F.count_if(~F.col("reused")).alias("processed"), F.count_if("reused").alias("unchanged"), pages]
    return set_note(photos.groupBy("set_id").agg(*_counts(), *more, *_spread())).drop("low", "high", "n_backdrops")


def paged(rows: DataFrame, page: int = 30, key: str = "set_id", order: str = "source") -> DataFrame:
    """rows plus page (from 1) and place on it."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w)
    return rows.withColumns({"page": (F.floor((n - 1) / page) + 1).cast("long"), "place": ((n - 1) % page + 1).cast("long")})


def sheets(members: DataFrame, groups: int = 12, shots: int = 12) -> DataFrame:
    """One row per group of (set_id, group_no, idx, name): its sheet and row there, the names of its first shots in
    order, and `more`: how many it has beyond those, as "+n" (empty without any)."""
    rows = members.groupBy("set_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("idx", "name"))).alias("_all"))
    n = F.row_number().over(Window.partitionBy("set_id").orderBy("group_no"))
    over = F.size("_all") - shots
    return rows.withColumns({"sheet": (F.floor((n - 1) / groups) + 1).cast("long"), "row": ((n - 1) % groups + 1).cast("long"), "shown": F.transform(F.slice("_all", 1, shots), lambda x: x["name"]), "more": F.when(over > 0, F.concat(F.lit("+"), over.cast("string"))).otherwise("")}).drop("_all")


def gallery(photos: DataFrame, which: str = "all") -> DataFrame:
    return photos if which == "all" else photos.filter(F.col("final_grade") == which.upper())
