"""The roles of the library's inputs, derived from the test tables with integer arithmetic (so that SQL can derive
the same rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MEASURES_SQL = """
    SELECT o_custkey AS set_id, o_orderkey AS photo_id, 1600 AS width, CASE WHEN o_orderkey % 41 = 0 THEN 1999 ELSE 2000 END AS height,
        o_orderkey % 53 <> 0 AS srgb, CASE WHEN o_orderkey % 59 = 0 THEN 3 ELSE 0 END AS metadata_tags,
        CASE WHEN o_orderkey % 67 = 0 THEN 0 ELSE 1 END AS face,
        (360 + o_orderkey % 230) / 1000.0e0 AS eye_line, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 250) / 1000.0e0 END AS headroom,
        (430 + o_orderkey % 140) / 1000.0e0 AS center, (700 + o_orderkey % 610) / 1000.0e0 AS head_size,
        CASE WHEN o_orderkey % 5 > 0 THEN (900 + o_orderkey % 300) / 1000.0e0 END AS planned_head,
        CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS other_faces, (o_orderkey % 43) / 1000.0e0 AS face_blown,
        (o_orderkey % 97) * 1.0e0 AS skin_hue, (o_orderkey % 61) * 1.0e0 AS skin_chroma, (400 + (o_orderkey % 97) * 10) / 1000.0e0 AS eye_sharpness,
        (780 + o_orderkey % 221) / 1000.0e0 AS fidelity_ssim, (o_orderkey % 71) / 10000.0e0 AS clipping_added, (o_orderkey % 73) / 10000.0e0 AS crushing_added,
        (o_orderkey % 47) - 23.0e0 AS face_lightness_change, (900 + o_orderkey % 790) / 1000.0e0 AS sharpen_gain, (600 + o_orderkey % 950) / 1000.0e0 AS upscale,
        (o_orderkey % 89) * 2.0e0 AS backdrop_luma, CASE WHEN o_orderkey % 23 > 0 THEN concat('P', CAST(o_orderkey AS VARCHAR(20)), '.jpg') END AS output
    FROM orders
"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MEASURES_SQL.replace("VARCHAR(20)", "STRING").replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("set_id"), F.col("vec_id").alias("photo_id"), F.concat(F.lit("IMG_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("name"), F.col("embedding").cast("array<double>").alias("vec"), F.lit(0.9).alias("detect_threshold"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: an order is a photo whose stem repeats within its set, with an extension by its priority."""
    o = read(spark, sf_dir, "orders")
    stem = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "IMG_E").otherwise("IMG_"), (F.col("o_orderkey") % 50).cast("string"))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".HEIC", ".jpg", ".png", ".tiff", ".txt")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("set_id"), F.concat(stem, ext).alias("source"), F.col("o_orderkey").alias("size"), (F.col("o_orderkey") * 1000).alias("mtime_ns"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as faces: an order is a photo; the eyes' distance and place come from part, supplier and line."""
    i = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    cx, cy = (600 + F.col("l_partkey") % 2800).cast("double"), (500 + F.col("l_suppkey") * 37 % 2000).cast("double")
    d = (40 + F.col("q") + F.col("l_linenumber") * 10).cast("double")
    p = lambda dx, dy: F.array(cx + dx * d, cy + dy * d)
    return i.select(
        (F.col("l_orderkey") % 100).alias("set_id"), F.col("l_orderkey").alias("photo_id"), "l_partkey", "l_suppkey", "l_linenumber", "q",
        F.array(cx - d, cy - 0.875 * d, 2 * d, 2.625 * d).alias("box"), F.array(p(-0.5, 0.0), p(0.5, 0.0), p(0.0, 0.5), p(-0.375, 0.875), p(0.375, 0.875)).alias("lm"),
        F.lit(0.99).alias("score"), F.lit(4032).alias("w"), F.lit(3024).alias("h"), F.when(F.col("l_linenumber") % 2 == 0, cy - 1.25 * d).alias("crown"),
    )
