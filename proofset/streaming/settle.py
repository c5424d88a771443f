"""Folders that have settled: two listings in a row that are equal, and differ from what was last run.

A stream keeps two digests for each set, never names of files, and has no watermark: a change that comes late is a
change like any other, and its set settles again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from proofset.sources import listing

SETTLED = "set_id string, taken long, files long, digest string"


def _settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, ran = state.get if state.exists else (None, None)
    fired = []
    for row in pd.concat(list(frames)).sort_values("taken").itertuples(index=False):
        if row.digest == last and row.digest != ran:
            fired.append((key[0], row.taken, row.files, row.digest))
            ran = row.digest
        last = row.digest
    state.update((last, ran))
    yield pd.DataFrame(fired, columns=["set_id", "taken", "files", "digest"])


def settled(snapshots: DataFrame) -> DataFrame:
    """set_id, taken, files, digest of the listings (set_id, taken, files, digest; one row for a set at a time) at
    which a set had settled: equal to the one before, and not to the last at which it had settled. On a stream the
    listings of a set come in the order of `taken`, however they are cut into batches; the same rows come from a
    static frame. A null set_id is a set; a null digest never settles. Other columns are ignored."""
    rows = snapshots.select(F.col("set_id").cast("string").alias("set_id"), "taken", "files", "digest").filter(F.col("digest").isNotNull())
    if rows.isStreaming:
        return rows.groupBy("set_id").applyInPandasWithState(_settle, SETTLED, "last string, ran string", "append", GroupStateTimeout.NoTimeout)
    w = Window.partitionBy("set_id").orderBy("taken")
    before, second = F.lag("digest").over(w), F.lag("digest", 2).over(w)
    # the second listing of a run of equal ones: it settles there unless the run before that settled was the same
    again = rows.withColumns({"_b": before, "_s": second}).filter((F.col("digest") == F.col("_b")) & ~F.col("digest").eqNullSafe(F.col("_s")))
    ran = F.lag("digest").over(w)
    return again.withColumn("_r", ran).filter(~F.col("digest").eqNullSafe(F.col("_r"))).select("set_id", "taken", "files", "digest")


def watch_folders(spark: SparkSession, root: str, run: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", folders_per_task: int = 16, **trigger) -> StreamingQuery:
    """Look at all folders of a root every so often and call run(sets, batch id) with the sets that have settled
    (settled()'s rows). A set is run once for each state that it settles in; one whose run was cut off is run again
    after a restart, as its state is kept with the batch. New folders are found by themselves."""
    listing.register(spark)
    seen = spark.readStream.format("folder_snapshots").option("folders_per_task", folders_per_task).load(root)

    def once(batch: DataFrame, number: int) -> None:
        batch.persist()  # run() may read it more than once, and a new look could differ
        try:
            if not batch.isEmpty():
                run(batch, number)
        finally:
            batch.unpersist()

    return settled(seen).writeStream.outputMode("append").foreachBatch(once).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": every})).start()
