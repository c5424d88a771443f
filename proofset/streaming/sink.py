"""What a stream of photo events leaves behind: the latest event of each photo, and each event's number and percent.

Both are written batch by batch into a store of generations, so that the stream itself keeps no state. A batch that
comes again, as after a crash, finds its mark and does nothing; one that was cut off anywhere before its mark finds the
store as it was, or merges the same rows into it once more, with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from proofset.sources import store
from proofset.streaming.watch import latest


def once(root: str, work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """work(batch, id) for each batch that has no mark yet; the mark is set when it is done."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number not in store.marked(spark, f"{root}/batches"):
            work(batch, number)
            store.mark(spark, f"{root}/batches/{number}")

    return run


def _schema(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)


def _known(touched: DataFrame, root: str, schema: str) -> DataFrame:
    """Rows of the touched sets (_s) as the store has them."""
    spark = touched.sparkSession
    return store.load(spark, root, "parquet", schema, folders=False).join(touched, F.col("set_id").eqNullSafe(F.col("_s")), "left_semi")


def upsert_latest(root: str, order: str = "seen_at", keep: int = 50) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, on photo events (set_id, source, ...): the store's row of a photo is its latest event, whatever
    the order in which they come. Only sets that a batch names are written anew. Beyond `keep` generations all are
    written as one."""

    def work(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        events = batch.withColumn("set_id", F.col("set_id").cast("string"))
        touched = events.select(F.col("set_id").alias("_s")).distinct()
        schema = _schema(events, "set_id")
        old = _known(touched, root, schema)
        store.save(latest(old.select(*events.columns).unionByName(events), order).select(*events.columns), root, "parquet", touched.withColumnRenamed("_s", "set_id"), folders=False)
        store.vacuum(spark, root)
        if len(store.generations(spark, root)) > keep:
            store.compact(spark, root, "parquet", schema, folders=False)

    return once(root, work)


def latest_photos(spark, root: str, schema: str) -> DataFrame:
    return store.load(spark, root, "parquet", schema, folders=False)


def running_progress(totals: DataFrame, root: str, out: str, order: str = "seen_at") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each event with done (its number in its set), total and percent (half away from zero), written
    to out/batch=N. The store keeps how many events each set has had. totals: set_id, total."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = batch.withColumn("set_id", F.col("set_id").cast("string"))
        touched = events.select(F.col("set_id").alias("_s")).distinct()
        before = _known(touched, root, "done long").select(F.col("set_id").alias("_k"), F.col("done").alias("_before"))
        place = F.row_number().over(Window.partitionBy("set_id").orderBy(order, "source"))
        rows = events.join(before, F.col("set_id").eqNullSafe(F.col("_k")), "left").withColumn("done", F.coalesce("_before", F.lit(0).cast("long")) + place).drop("_k", "_before")
        own = totals.select(F.col("set_id").cast("string").alias("_t"), "total")
        rows = rows.join(own, F.col("set_id").eqNullSafe(F.col("_t")), "left").drop("_t")
        percent = F.when(F.col("total") > 0, F.round(F.col("done") * 100 / F.col("total"))).otherwise(0).cast("int")
        rows.withColumn("percent", percent).write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen = spark.read.parquet(f"{out}/batch={number}").groupBy("set_id").agg(F.max("done").alias("done"))
        store.save(seen, root, "parquet", folders=False)
        store.vacuum(spark, root)

    return once(root, work)


def start(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    return events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
