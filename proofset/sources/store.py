"""Saved results by set that survive a pass over other sets, and a pass that is killed.

A pass writes a new generation: the rows of the sets it covered, and which sets these were. Nothing older is touched.
The generation counts once an empty file of its number stands among the commits, which appears in one step after all
rows are there. Readers take each set from the last committed generation that covered it, so a set that was covered
and has no rows any more is empty, and a generation without a commit was never there. Two passes at once get numbers
of their own; of a set that both cover, the higher number counts.

Layout: rows/generation=N/set_id=S/..., sets/generation=N/..., claims/N, commits/N, and own/N if a generation covers the
sets of its rows and no others, so that while it is the last, its rows need not be looked up. A null or empty set_id is read back
as null. Without folders for sets, which suits a great many small ones, set_id is a column of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


NULL_SET = "__HIVE_DEFAULT_PARTITION__"  # as Spark names the folder of nulls


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def marked(spark: SparkSession, path: str) -> list[int]:
    """The numbers that mark() has set in a folder, in order."""
    fs, at = _files(spark, path)
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


def mark(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already."""
    fs, at = _files(spark, path)
    if fs.exists(at):
        return False
    try:
        fs.create(at, False).close()
    except Exception as e:  # another pass was faster
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def generations(spark: SparkSession, root: str) -> list[int]:
    """Committed generations, oldest first."""
    return marked(spark, f"{root}/commits")


def save(rows: DataFrame, root: str, fmt: str, sets: DataFrame | None = None, order: tuple[str, ...] = (), folders: bool = True, deal: bool = True, **options) -> int:
    """Rows (with set_id) as the newest generation of the sets that they, or `sets` (set_id), name. order: within a
    set's file. Without deal, which is for sets of one row each, rows stay where they are. Returns the generation."""
    spark = rows.sparkSession
    number = max([0, *marked(spark, f"{root}/claims")]) + 1
    while not mark(spark, f"{root}/claims/{number}"):
        number += 1
    named = (rows if sets is None else sets).select(F.col("set_id").cast("string")).distinct()
    named.write.parquet(f"{root}/sets/generation={number}")
    # a set_id that cannot be null keeps the order of rows: Spark would sort anew to make empty ones null
    dealt = rows.withColumn("set_id", F.coalesce(F.col("set_id").cast("string"), F.lit(NULL_SET)))
    dealt = dealt.repartition("set_id").sortWithinPartitions("set_id", *order) if deal else dealt
    dealt = dealt.drop(*[c for c in order if c.startswith("_")])
    (dealt.write.partitionBy("set_id") if folders else dealt.write).format(fmt).options(**options).save(f"{root}/rows/generation={number}")
    if sets is None:
        mark(spark, f"{root}/own/{number}")
    if not mark(spark, f"{root}/commits/{number}"):
        raise RuntimeError(f"generation {number} was committed by someone else")
    return number


def covered(spark: SparkSession, root: str) -> DataFrame:
    """set_id, generation: where each set is to be read."""
    found = generations(spark, root)
    if not found:
        return spark.createDataFrame([], "set_id string, generation long")
    rows = spark.read.schema("set_id string, generation long").option("basePath", f"{root}/sets").parquet(*[f"{root}/sets/generation={n}" for n in found])
    return rows.withColumn("set_id", F.nullif("set_id", F.lit(""))).groupBy("set_id").agg(F.max("generation").alias("generation"))


def load(spark: SparkSession, root: str, fmt: str, schema: str, folders: bool = True, **options) -> DataFrame:
    """set_id and the columns of schema, of every set's last committed generation."""
    latest = covered(spark, root).select(F.col("set_id").alias("_s"), F.col("generation").alias("_g"))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    kept = [n for n in generations(spark, root) if _files(spark, f"{root}/rows/generation={n}")[0].exists(_files(spark, f"{root}/rows/generation={n}")[1])]
    if not kept:
        return spark.createDataFrame([], f"set_id string, {schema}")
    whole = f"{schema}, generation long, set_id string" if folders else f"set_id string, {schema}, generation long"
    rows = spark.read.format(fmt).schema(whole).options(**options).option("basePath", f"{root}/rows").load([f"{root}/rows/generation={n}" for n in kept])
    rows = rows if folders else rows.withColumn("set_id", F.nullif(F.nullif("set_id", F.lit(NULL_SET)), F.lit("")))
    met = (F.col("generation") == F.col("_g")) & F.col("set_id").eqNullSafe(F.col("_s"))
    last = generations(spark, root)[-1]
    if last not in marked(spark, f"{root}/own"):
        return rows.join(latest, met).select("set_id", *names)
    found = rows.filter(F.col("generation") == last).select("set_id", *names)
    return found if kept == [last] else found.unionByName(rows.filter(F.col("generation") < last).join(latest, met).select("set_id", *names))


def vacuum(spark: SparkSession, root: str) -> list[int]:
    """Delete committed generations that no set is read from any more; returns their numbers. To be called while no
    reader of them is at work."""
    live = {r.generation for r in covered(spark, root).select("generation").distinct().collect()}  # one row a generation
    gone = [n for n in generations(spark, root) if n not in live]
    for n in gone:
        for part in (f"commits/{n}", f"rows/generation={n}", f"sets/generation={n}", f"own/{n}"):
            fs, at = _files(spark, f"{root}/{part}")
            fs.delete(at, True)
    return gone


def compact(spark: SparkSession, root: str, fmt: str, schema: str, folders: bool = True, **options) -> int:
    """All sets as one new generation; the older ones go."""
    rows = load(spark, root, fmt, schema, folders, **options)
    number = save(rows, root, fmt, covered(spark, root), folders=folders, **options)
    vacuum(spark, root)
    return number
