"""Watched folders and event logs as Structured Streaming queries; the same functions take static frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def quiet_sessions(changes: DataFrame, every: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """set_id, started, ended, changes: bursts of changes (set_id, seen_at) that were quiet for `every` afterwards.
    On a stream the last burst stays open until a later event moves the watermark."""
    rows = changes.withWatermark("seen_at", late) if changes.isStreaming else changes
    out = rows.groupBy(F.session_window("seen_at", every).alias("w"), "set_id").agg(F.count(F.lit(1)).alias("changes"))
    return out.select("set_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes")


def watch(changes: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", late: str = "10 seconds", **trigger) -> StreamingQuery:
    """Call run(sets, batch id) with the sets whose folders have settled. A later change comes in a later batch; the
    incremental pass may see a set twice without harm."""
    settled = quiet_sessions(changes, every, late)
    once = lambda batch, n: run(batch.select("set_id").distinct(), n)
    return settled.writeStream.outputMode("append").foreachBatch(once).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def grade_progress(photos: DataFrame) -> DataFrame:
    """Photos done and of each grade per set, from photo events (set_id, grade); for update or complete mode."""
    counts = [F.count_if(F.col("grade") == g).alias(f"n_{g.lower()}") for g in ("PASS", "REVIEW", "FAIL", "SKIPPED")]
    return photos.groupBy("set_id").agg(F.count(F.lit(1)).alias("done"), *counts)


def latest(photos: DataFrame, order: str = "seen_at") -> DataFrame:
    """The latest event of each (set_id, source), however late an older one arrives. A stream keeps one row for each
    photo (update or complete mode); no watermark would drop any, as the time is not part of the key."""
    rest = [c for c in photos.columns if c not in ("set_id", "source")]
    return photos.groupBy("set_id", "source").agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("e")).select("set_id", "source", "e.*")


def progress(photos: DataFrame, totals: DataFrame, order: str = "seen_at") -> DataFrame:
    """Each event with done so far, total and percent (half away from zero), in order of the events."""
    done = F.row_number().over(Window.partitionBy("set_id").orderBy(order, "source"))
    rows = photos.join(totals.select("set_id", "total"), "set_id").withColumn("done", done.cast("long"))
    return rows.withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("done") * 100 / F.col("total"))).otherwise(0).cast("int"))
