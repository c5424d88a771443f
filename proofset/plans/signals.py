"""Registered queries of settled folders, images, deciders and single signals, each beside its SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.functions import framing, grading
from proofset.operators import inventory, pixels
from proofset.plans import tables
from proofset.plans.oracle import _GRADE, _JUDGED
from proofset.plans.queries import graded
from proofset.plans.views import _LIN, _LUMA, _NEAR_SQL, registering
from proofset.session import computed_once
from proofset.streaming.settle import settled

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registering(QUERIES, ORACLE_SQL)


@query("""WITH e AS (SELECT user_id AS set_id, event_id AS taken, event_type AS digest, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    i AS (SELECT *, sum(CASE WHEN digest IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY set_id ORDER BY taken ROWS UNBOUNDED PRECEDING) AS run FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY set_id, run ORDER BY taken) AS place FROM i), s AS (SELECT *, lag(digest) OVER (PARTITION BY set_id ORDER BY taken) AS ran FROM n WHERE place = 2)
    SELECT CAST(set_id AS VARCHAR) AS set_id, taken, taken % 50 AS files, digest FROM s WHERE ran IS DISTINCT FROM digest""")
def settled_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings of a user's folder, and the listings at which it had settled."""
    e = tables.read(spark, sf_dir, "events")
    return settled(e.select(F.col("user_id").alias("set_id"), F.col("event_id").alias("taken"), (F.col("event_id") % 50).alias("files"), F.col("event_type").alias("digest")))


_LM = [[6.0, 16.0], [14.0, 16.0], [10.0, 19.0], [7.0, 23.0], [13.0, 23.0]]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels: 200 order keys are a photo of 20 x 40; a pixel's first three bytes come from its largest
    line item, and are halved before the edit. Pixels without one are black."""
    i = tables.read(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    at = (F.floor(k / 20) % 10 * 4 + (F.col("l_linenumber") - 1) % 4) * 20 + k % 20
    p = F.col("l_partkey")
    rgb = (p * 5 % 256) * 65536 + (p * 3 % 256) * 256 + (p + F.col("l_suppkey")) % 256
    spots = i.groupBy(F.floor(k / 200).alias("photo_id"), at.cast("int").alias("at")).agg(F.max(rgb).alias("rgb"))  # at most 800 a photo
    shots = spots.groupBy("photo_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "rgb"))).alias("spots"))

    def image(dim: int):
        channel = lambda v, k: F.lpad(F.hex(F.shiftright(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)), dim)), 2, "0")
        pixel = lambda at: F.coalesce(F.try_element_at("spots", at), F.lit(0).cast("long"))
        text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(799)), lambda at: F.concat(*[channel(pixel(at), k) for k in (0, 1, 2)])), "")
        return F.struct(F.lit(20).alias("width"), F.lit(40).alias("height"), F.lit(3).alias("nChannels"), F.unhex(text).alias("data"))

    return shots.select("photo_id", image(0).alias("image"), image(1).alias("plain"), F.array(*[F.array(*[F.lit(v) for v in q]) for q in _LM]).alias("lm"))


_Y = "0.2126729e0 * {0} + 0.7151522e0 * {1} + 0.0721750e0 * {2}"
_STAR = lambda y: f"CASE WHEN {y} > 216.0e0 / 24389 THEN 116 * cbrt({y}) - 16 ELSE 24389.0e0 / 27 * {y} END"
_SIDES = " AND ".join(f"({bx} - {ax}) * (y - {ay}) - ({by} - {ay}) * (x - {ax}) >= 0" for (ax, ay), (bx, by) in (((3, 12), (16, 12)), ((16, 12), (14, 25)), ((14, 25), (5, 25)), ((5, 25), (3, 12))))


@query(f"""WITH s AS (SELECT l_orderkey // 200 AS photo_id, (l_orderkey // 20 % 10 * 4 + (l_linenumber - 1) % 4) * 20 + l_orderkey % 20 AS at, max((l_partkey * 5 % 256) * 65536 + (l_partkey * 3 % 256) * 256 + (l_partkey + l_suppkey) % 256) AS rgb FROM lineitem GROUP BY ALL),
    g AS (SELECT photo_id, CAST(unnest(range(800)) AS BIGINT) AS at FROM (SELECT DISTINCT photo_id FROM s)), w AS (SELECT g.photo_id, g.at % 20 AS x, g.at // 20 AS y, coalesce(rgb, 0) AS v FROM g LEFT JOIN s ON g.photo_id = s.photo_id AND g.at = s.at),
    c AS (SELECT photo_id, x, y, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b, v // 65536 // 2 AS r0, v // 256 % 256 // 2 AS g0, v % 256 // 2 AS b0 FROM w),
    p AS (SELECT *, {_LUMA.format('r', 'g', 'b')} AS l, {_LUMA.format('r0', 'g0', 'b0')} AS l0, greatest(r, g, b) AS peak, greatest(r0, g0, b0) AS peak0, {_Y.format(_LIN.format('r'), _LIN.format('g'), _LIN.format('b'))} AS z, {_Y.format(_LIN.format('r0'), _LIN.format('g0'), _LIN.format('b0'))} AS z0 FROM c),
    t AS (SELECT photo_id, least(quantile_cont(l / 255, 0.0005), 0.05e0) AS black_point, greatest(quantile_cont(peak / 255.0e0, 0.9995), 0.92e0) AS white_point, median(floor(0.299e0 * r + 0.587e0 * g + 0.114e0 * b + 0.5e0)) FILTER (y < 3 AND (x < 4 OR x >= 16)) AS backdrop_luma FROM p GROUP BY photo_id),
    f AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY y, x) - 1 AS n FROM p WHERE {_SIDES}),
    a AS (SELECT photo_id, avg(CASE WHEN l >= 250 THEN 1.0e0 ELSE 0 END) AS face_blown, avg(CASE WHEN peak >= 254 AND peak0 < 250 THEN 1.0e0 ELSE 0 END) AS clipping_added, avg(CASE WHEN l <= 3 AND l0 > 10 THEN 1.0e0 ELSE 0 END) AS crushing_added, avg({_STAR('z')} - ({_STAR('z0')})) FILTER (n % 5 = 0) AS face_lightness_change FROM f GROUP BY photo_id)
    SELECT t.photo_id, round(face_blown, 6) AS face_blown, round(clipping_added, 6) AS clipping_added, round(crushing_added, 6) AS crushing_added, round(face_lightness_change, 4) AS face_lightness_change, round(black_point, 6) AS black_point, round(white_point, 6) AS white_point, round(backdrop_luma, 4) AS backdrop_luma FROM t JOIN a ON t.photo_id = a.photo_id""")
def image_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures from image bytes: shares of the face, tone points, backdrop, and what the edit changed."""
    m = pixels.image_measures(images(spark, sf_dir))
    digits = {"face_blown": 6, "clipping_added": 6, "crushing_added": 6, "face_lightness_change": 4, "black_point": 6, "white_point": 6, "backdrop_luma": 4}
    return m.select("photo_id", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(f"""WITH {_JUDGED}, {_NEAR_SQL.format(grade=_GRADE('top'), n='n_reasons', rows='j')}, l AS (SELECT *, CASE WHEN photo_id % 5 > 2 THEN (photo_id % 100) / 100.0e0 END AS look FROM near WHERE output IS NOT NULL)
    SELECT photo_id, CASE WHEN look IS NULL THEN 'local' ELSE 'remote' END AS decided_by, CASE WHEN look IS NULL THEN 'remote' END AS requested,
        CASE WHEN grade = 'PASS' AND (CASE WHEN look IS NULL THEN len(hits) > 0 ELSE look >= 0.4e0 END) THEN 'REVIEW' ELSE grade END AS decided,
        CASE WHEN look IS NULL THEN CASE grade WHEN 'FAIL' THEN 1.0e0 WHEN 'REVIEW' THEN round(least(0.95e0, 0.75e0 + 0.05e0 * least(n, 4)), 2) ELSE CASE WHEN len(hits) > 0 THEN 0.55e0 ELSE 0.95e0 END END
            WHEN photo_id % 7 = 0 THEN 0.77e0 WHEN grade = 'PASS' AND look < 0.4e0 THEN round(1 - look, 2) ELSE look END AS confidence FROM l""")
def remote_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by a registered decider whose scores are partly missing or beyond 0 to 1; saved decisions of every
    seventh photo are taken again, those of another seventh rest on something else and are not."""
    k = F.col("photo_id")
    score = F.when(k % 5 == 0, 1.5).when(k % 5 == 1, float("nan")).when(k % 5 > 2, (k % 100) / 100)
    grading.register_decider("remote", lambda rows: score)
    first, d = computed_once(grading.decide_by(grading.stored(graded(spark, sf_dir)), "remote")), F.col("decide")
    old = F.when(k % 7 == 0, d.withField("confidence", F.lit(0.77))).when(k % 7 == 1, d.withField("basis", F.lit("else")).withField("confidence", F.lit(0.11)))
    again = grading.decide_by(first.withColumn("_old", old).drop("decide"), "remote", F.col("_old")).filter("decide IS NOT NULL")
    return again.select("photo_id", d["by"].alias("decided_by"), d["requested"].alias("requested"), d["grade"].alias("decided"), d["confidence"].alias("confidence"))


@query("""WITH t AS (SELECT event_id, (event_id % 150) / 100.0e0 AS v, event_id % 7 AS k FROM events)
    SELECT event_id, CASE WHEN k < 5 AND v <= 1 THEN v WHEN k = 5 THEN NULL END AS look FROM t""")
def answers_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities found in a scorer's answers, wherever they stand."""
    k = F.col("event_id")
    v = ((k % 150) / 100).cast("string")
    shapes = [v, F.concat(F.lit('{"look": '), v, F.lit("}")), F.concat(F.lit('{"other": 7, "noul": '), v, F.lit("}")), F.concat(F.lit('{"answers": {"look": {"noul": '), v, F.lit("}}}")), F.concat(F.lit('{"answers": {"look": '), v, F.lit("}}")), F.lit('{"look": "yes"}'), F.lit("{broken")]
    answer = F.element_at(F.array(*shapes), (k % 7 + 1).cast("int"))
    return tables.read(spark, sf_dir, "events").select("event_id", grading.find_look(answer).alias("look"))


@query("""WITH f AS (SELECT l_orderkey AS photo_id, ((l_partkey * 37 + l_linenumber) % 100) / 100.0e0 AS score FROM lineitem),
    t AS (SELECT photo_id, CASE WHEN max(score) >= 0.8e0 THEN 0.8e0 WHEN max(score) >= 0.5e0 THEN 0.5e0 WHEN max(score) >= 0.3e0 THEN 0.3e0 END AS tier FROM f GROUP BY photo_id)
    SELECT f.photo_id, tier AS detect_threshold, count(*) AS faces FROM f JOIN t ON f.photo_id = t.photo_id WHERE score >= tier GROUP BY ALL""")
def face_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces at the first confidence at which their photo has any."""
    f = tables.faces(spark, sf_dir).withColumn("score", ((F.col("l_partkey") * 37 + F.col("l_linenumber")) % 100) / 100)
    return framing.confident(f).groupBy("photo_id", "detect_threshold").agg(F.count(F.lit(1)).alias("faces"))


@query("""WITH f AS (SELECT l_orderkey AS photo_id, l_linenumber, l_partkey, (l_partkey % 1200) * 1.0e0 AS cx, (l_suppkey * 37 % 900) * 1.0e0 AS cy, (40 + CAST(l_quantity AS BIGINT) + l_linenumber * 10) * 1.0e0 AS d FROM lineitem)
    SELECT photo_id, l_linenumber, l_partkey, CASE WHEN cx - d < -0.03e0 * (2 * d) THEN 'left' WHEN cx + d > 1000 + 0.03e0 * (2 * d) THEN 'right' WHEN cy - 0.875e0 * d < -0.03e0 * (2 * d) THEN 'top' WHEN cy + 1.75e0 * d > 800 + 0.03e0 * (2 * d) THEN 'bottom' END AS cut FROM f""")
def cut_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of the photo that cuts a face off."""
    i = tables.read(spark, sf_dir, "lineitem")
    cx, cy = (F.col("l_partkey") % 1200).cast("double"), (F.col("l_suppkey") * 37 % 900).cast("double")
    d = (40 + F.col("l_quantity").cast("long") + F.col("l_linenumber") * 10).cast("double")
    at = lambda dx, dy: F.array(cx + dx * d, cy + dy * d)
    rows = i.select(F.col("l_orderkey").alias("photo_id"), "l_linenumber", "l_partkey", F.array(cx - d, cy - 0.875 * d, 2 * d, 2.625 * d).alias("box"), F.array(at(-0.5, 0.0), at(0.5, 0.0), at(0.0, 0.5), at(-0.375, 0.875), at(0.375, 0.875)).alias("lm"))
    return rows.select("photo_id", "l_linenumber", "l_partkey", framing.cut_side(F.lit(1000), F.lit(800)).alias("cut"))


_KNOWN = list(inventory.EDIT_NAMES)


@query(f"""WITH t AS (SELECT event_id AS k, {_KNOWN!r} AS ids, {list(inventory.EDIT_NAMES.values())!r} AS names FROM events)
    SELECT k AS event_id, CASE WHEN k % 10 = 0 THEN 'unknown edits' ELSE array_to_string(list_filter([CASE WHEN k % 3 > 0 THEN names[k % {len(_KNOWN)} + 1] END, CASE WHEN k % 4 > 0 THEN 'Odd' || (k % 5) END, CASE WHEN k % 2 > 0 THEN 'edit' END], lambda x: x IS NOT NULL), ', ') END AS edits FROM t""")
def edits_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a sidecar's enabled edits: known, unknown and without an identifier; enabled unless they say not."""
    k = F.col("event_id")
    known = F.element_at(F.array(*[F.lit(n) for n in _KNOWN]), (k % len(_KNOWN) + 1).cast("int"))
    edit = lambda name, on: F.struct(name.cast("string").alias("identifier"), on.alias("enabled"))
    found = F.when(k % 10 > 0, F.array(edit(known, k % 3 > 0), edit(F.concat(F.lit("Odd"), (k % 5).cast("string")), F.when(k % 4 == 0, False)), edit(F.lit(None), k % 2 > 0)))
    return tables.read(spark, sf_dir, "events").select("event_id", F.array_join(inventory.edit_names(found), ", ").alias("edits"))
