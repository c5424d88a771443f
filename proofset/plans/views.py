"""More registered queries over the test tables, each beside the SQL (DuckDB) that must give the same rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.functions import color, framing, grading
from proofset.operators import grouping, inventory, sets
from proofset.plans import passes, tables
from proofset.plans.oracle import _CHECKS, _FINAL, _FLAG, _GRADE, _JUDGED, _SETS, _VECS
from proofset.plans.queries import _members, graded, incremental_inputs, pixels
from proofset.session import remove, scratch, shared_dir, stored_once
from proofset.sources import report as reports

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registering(queries: dict, sqls: dict[str, str]):
    """The decorator that adds a query, and its SQL if there is one, to these."""

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = sql
            return f

        return add

    return query


query = registering(QUERIES, ORACLE_SQL)


@query(f"WITH {_JUDGED}, {_SETS}, f AS (SELECT j.set_id, photo_id, {_FINAL} AS g FROM j JOIN s ON j.set_id = s.set_id), n AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY photo_id) - 1 AS k FROM f WHERE g = 'REVIEW') SELECT set_id, photo_id, CAST(k // 3 + 1 AS BIGINT) AS page, CAST(k % 3 + 1 AS BIGINT) AS place FROM n")
def gallery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gallery filter and paging."""
    rows = sets.gallery(sets.with_final_grade(sets.judge_set(graded(spark, sf_dir))), "review")
    return sets.paged(rows, 3, order="photo_id").select("set_id", "photo_id", "page", "place")


@query(f"WITH {_VECS}, g AS (SELECT set_id, group_no, count(*) AS shots FROM v GROUP BY ALL) SELECT set_id, shots, count(*) AS students FROM g GROUP BY ALL")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_sizes(_members(spark, sf_dir)[1])


@query(f"WITH {_VECS} SELECT set_id, count(DISTINCT group_no) AS students, count(*) AS photos, count(DISTINCT group_no) - 6 AS off_by FROM v GROUP BY set_id")
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.totals(_members(spark, sf_dir)[1], expected=6)


@query(f"""WITH {_VECS}, x AS (SELECT set_id, group_no, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM u), m AS (SELECT set_id, group_no, d, avg(x) AS x FROM x GROUP BY ALL),
    c AS (SELECT set_id, group_no, list(x ORDER BY d) AS c FROM m GROUP BY ALL)
    SELECT u.set_id, u.idx, round(list_dot_product(vec, c) / sqrt(list_dot_product(c, c)), 3) AS fit FROM u JOIN c ON u.set_id = c.set_id AND u.group_no = c.group_no""")
def group_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of each photo to its group's mean direction."""
    return grouping.fit_to_group(*_members(spark, sf_dir))


@query(f"""WITH {_VECS}, x AS (SELECT set_id, least(ga, gb) AS a, greatest(ga, gb) AS b, avg(sim) AS sim FROM p WHERE ga <> gb GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY sim DESC, a DESC, b DESC) AS place FROM x)
    SELECT set_id, a, b, round(sim, 6) AS sim, CAST(place AS INTEGER) AS place FROM r WHERE place <= 4""")
def closest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, members = _members(spark, sf_dir)
    return grouping.closest_groups(grouping.group_pairs(grouping.group_links(kept, members))).select("set_id", "a", "b", F.round("sim", 6).alias("sim"), "place")


@query(f"""WITH {_VECS}, w AS (SELECT *, row_number() OVER (PARTITION BY set_id, ga ORDER BY sim, i, j) AS n FROM p WHERE ga = gb), r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY sim, ga) AS place FROM w WHERE n = 1)
    SELECT set_id, ga AS group_no, i, j, round(sim, 6) AS sim, CAST(place AS INTEGER) AS place FROM r WHERE place <= 4""")
def weakest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, members = _members(spark, sf_dir)
    return grouping.weakest_groups(grouping.weakest_inside(grouping.group_links(kept, members))).select("set_id", "group_no", "i", "j", F.round("sim", 6).alias("sim"), "place")


@query(f"""WITH {_VECS}, g AS (SELECT set_id, group_no, list('IMG_' || photo_id || '.jpg' ORDER BY idx) AS names FROM v GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY group_no) - 1 AS k FROM g)
    SELECT set_id, group_no, CAST(k // 3 + 1 AS BIGINT) AS sheet, CAST(k % 3 + 1 AS BIGINT) AS row, array_to_string(names[1:4], ' ') AS shown, CASE WHEN len(names) > 4 THEN '+' || (len(names) - 4) ELSE '' END AS more FROM n""")
def group_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.sheets(_members(spark, sf_dir)[1], groups=3, shots=4).withColumn("shown", F.array_join("shown", " "))


@query(f"""WITH {_VECS}, g AS (SELECT set_id, group_no, 'S' || lpad(group_no::VARCHAR, 2, '0') || ':' || array_to_string(list('IMG_' || photo_id || '.jpg' ORDER BY idx), '|') || ':' || min(CASE WHEN photo_id % 2 = 0 THEN 'IMG_' || photo_id || '.jpg' END) AS g, count(*) AS n FROM v GROUP BY set_id, group_no)
    SELECT set_id, count(*) AS students, CAST(sum(n) AS BIGINT) AS photos, 0.363e0 AS threshold, 'you asked for it' AS why, array_to_string(list(g ORDER BY group_no), ' ') AS groups, '0.2=4' AS sweep FROM g GROUP BY set_id""")
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested result, with its arrays written out."""
    kept, members = _members(spark, sf_dir)
    rows = grouping.grouped_result(members.withColumn("pick", F.col("photo_id") % 2 == 0), grouping.operating_cut(kept, kept, 0.363), kept.select("set_id", F.lit(0.2).alias("cut"), F.lit(4).alias("students")).distinct())
    groups = F.transform("groups", lambda g: F.concat(g["id"], F.lit(":"), F.array_join(g["photos"], "|"), F.lit(":"), g["pick"]))
    return rows.select("set_id", "students", "photos", "threshold", "why", F.array_join(groups, " ").alias("groups"), F.array_join(F.transform("sweep", lambda x: F.concat_ws("=", x["cut"].cast("string"), x["students"].cast("string"))), " ").alias("sweep"))


@query(f"""WITH {_VECS} SELECT set_id, 'S' || lpad(group_no::VARCHAR, 2, '0') AS student, 'IMG_' || photo_id || '.jpg' AS photo, CASE WHEN photo_id % 5 > 0 THEN 'src' || photo_id ELSE '' END AS source,
    row_number() OVER (PARTITION BY set_id, group_no ORDER BY idx) || '/' || count(*) OVER (PARTITION BY set_id, group_no) AS frame_of, photo_id / 1000.0e0 AS fit_to_group, CASE WHEN photo_id % 5 > 0 THEN 'PASS' ELSE '' END AS grade, CASE WHEN photo_id % 3 = 0 THEN 'pick' ELSE '' END AS pick FROM v""")
def student_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the grouping CSV."""
    m = grouping.frames(_members(spark, sf_dir)[1])
    k = F.col("photo_id")
    return reports.students_table(m.select("*", F.format_string("S%02d", "group_no").alias("student"), F.when(k % 5 > 0, F.concat(F.lit("src"), k.cast("string"))).alias("source"), (k / 1000).alias("fit"), F.when(k % 5 > 0, "PASS").alias("grade"), (k % 3 == 0).alias("pick")))


@query("SELECT o_custkey AS set_id, count(*) FILTER (o_orderkey % 5 < 4) AS photos FROM orders GROUP BY o_custkey")
def supported_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.supported_counts(tables.listing(spark, sf_dir))


_CLASS = "CASE WHEN k % 11 = 0 THEN 'todo' WHEN k % 23 > 0 AND k % 31 > 0 AND k % 37 = 0 THEN 'hand_edited' WHEN k % 23 > 0 AND k % 31 > 0 AND k % 19 = 0 THEN 'reuse' WHEN k % 13 > 0 AND k % 17 > 0 AND (k % 23 = 0 OR k % 31 > 0) THEN 'reuse' ELSE 'todo' END"


@query(f"WITH c AS (SELECT o_custkey AS set_id, o_orderkey AS k, {_CLASS} AS class FROM (SELECT *, o_orderkey AS k FROM orders)) SELECT set_id, count(*) AS total, count(*) FILTER (class = 'reuse') AS unchanged FROM c GROUP BY set_id")
def start_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, report = incremental_inputs(spark, sf_dir)
    return inventory.start_totals(inventory.classify(files, report, F.lit("key")))


@query("""WITH r AS (SELECT l_orderkey % 1000 AS k, l_shipdate, l_linenumber AS at, l_partkey FROM lineitem), s AS (SELECT l_suppkey AS set_id, 'p' || (l_partkey % 40) AS source, l_orderkey * 10 + l_linenumber AS size FROM lineitem)
    SELECT set_id, source, max(size) AS size FROM s GROUP BY ALL""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved reports, and back: documents sorted by source, then their photos by source, the last of repeated ones."""
    i = tables.read(spark, sf_dir, "lineitem")
    photos = i.select(F.col("l_suppkey").alias("set_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("size"))
    settings = photos.select("set_id").distinct().select("set_id", F.struct(F.lit(0.8).alias("ratio")).alias("settings"), F.lit(None).cast("string").alias("set_note"))
    return reports.report_index(reports.report_documents(photos, settings)).select("set_id", "source", "size")


@query("""WITH e AS (SELECT DISTINCT user_id AS set_id FROM events WHERE user_id % 3 = 0), o AS (SELECT o_custkey AS set_id, o_orderkey AS k FROM orders), n AS (SELECT DISTINCT o_custkey AS set_id FROM orders WHERE o_custkey % 3 < 2),
    log AS (SELECT user_id AS set_id, 'e' || event_id AS source, 'FAIL' AS grade, 'a; b' AS why FROM events WHERE user_id % 3 = 0),
    saved AS (SELECT set_id, 'r' || k AS source, 'REVIEW' AS grade, 'c' AS why FROM o WHERE set_id % 3 < 2 AND set_id NOT IN (SELECT set_id FROM e)),
    bare AS (SELECT set_id, 'o' || k AS source, 'PASS' AS grade, 'Already polished.' AS why FROM o WHERE set_id NOT IN (SELECT set_id FROM e) AND set_id NOT IN (SELECT set_id FROM n))
    SELECT * FROM log UNION ALL SELECT * FROM saved UNION ALL SELECT * FROM bare""")
def gallery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each set's gallery: event log, else report, else outputs."""
    e, o = tables.read(spark, sf_dir, "events"), tables.read(spark, sf_dir, "orders")
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    log = e.filter("user_id % 3 = 0").select(F.col("user_id").alias("set_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source"), F.lit("FAIL").alias("grade"), words("a").alias("reasons"), words("b").alias("notes"))
    named = lambda p: F.concat(F.lit(p), F.col("o_orderkey").cast("string")).alias("source")
    entries = o.filter("o_custkey % 3 < 2").select(F.col("o_custkey").alias("set_id"), named("r"), F.lit("REVIEW").alias("grade"), words("c").alias("reasons"), F.lit(None).cast("array<string>").alias("notes"))
    return reports.gallery_rows(log, entries, o.select(F.col("o_custkey").alias("set_id"), named("o")))


@query("""WITH s AS (SELECT o_custkey AS set_id, o_orderkey AS k FROM orders) SELECT set_id, k AS photo_id, substr(sha1('{"finish":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"width":' || (200 + k % 900) || '}1'), 1, 12) AS key,
    200 + k % 900 AS width, CAST(round_even((200 + k % 900) / 0.75e0, 0) AS BIGINT) AS height FROM s""")
def settings_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings keys and output sizes."""
    k = F.col("o_orderkey")
    size = framing.output_size(200 + k % 900, F.lit(0.75))
    rows = tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), k.alias("photo_id"), F.struct((k % 2 == 0).alias("finish"), (200 + k % 900).alias("width")).alias("s"), size.alias("size"))
    return rows.select("set_id", "photo_id", inventory.settings_key(F.col("s")).alias("key"), F.col("size")[0].alias("width"), F.col("size")[1].alias("height"))


_WITHOUT_UPSCALE = ", ".join(f"coalesce({sql}, 0)" if always else f"CASE WHEN face > 0 THEN coalesce({sql}, 0) ELSE 0 END" for _, sql, always in _CHECKS[:-1])
_AGAIN = f"q AS (SELECT *, [{_WITHOUT_UPSCALE}] AS again FROM m)"


@query(f"WITH {_JUDGED}, {_AGAIN} SELECT photo_id, {_GRADE('list_max(again)')} AS grade, CAST(len(list_filter(again, lambda x: x > 0)) AS INTEGER) AS n_reasons, CASE WHEN photo_id % 2 = 0 THEN 'first|' ELSE '' END || 'edited by hand; kept your version' AS notes, TRUE AS hand_edited FROM q")
def rejudged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = "edited by hand; kept your version"
    rows = tables.measures(spark, sf_dir).withColumn("notes", F.when(F.col("photo_id") % 2 == 0, F.array(F.lit(note), F.lit("first"))))
    return grading.rejudged(rows, note).select("photo_id", "grade", F.size("reasons").alias("n_reasons"), F.array_join("notes", "|").alias("notes"), "hand_edited")


@query("""SELECT event_id, CASE WHEN event_id % 7 > 0 THEN 'a=' || (event_id % 10) ELSE '' END AS numbers, CASE WHEN event_id % 5 > 0 THEN 't=' || event_type ELSE '' END AS texts, CASE WHEN event_id % 12 <= 8 THEN event_id % 12 END AS n_array FROM events""")
def compact_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of metric maps may leave the house."""
    k = F.col("event_id")
    numbers = F.create_map(F.lit("a"), F.when(k % 7 > 0, (k % 10).cast("double")).otherwise(float("nan")), F.lit("x/y"), F.lit(1.0), F.lit("i"), F.lit(float("inf")))
    texts = F.create_map(F.lit("t"), F.when(k % 5 > 0, F.col("event_type")).otherwise("a/b"), F.lit("long"), F.repeat(F.lit("z"), 81))
    n, t = grading.compact(numbers, texts)
    values = grading.compact_array(F.array_repeat(F.lit(1.0), (k % 12).cast("int")))
    text = lambda m, f: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), f(e["value"]))), ",")
    return tables.read(spark, sf_dir, "events").select("event_id", text(n, lambda v: v.cast("long").cast("string")).alias("numbers"), text(t, lambda v: v).alias("texts"), F.size(values).cast("long").alias("n_array")).withColumn("n_array", F.when(F.col("n_array") >= 0, F.col("n_array")))


@query("""WITH p AS (SELECT l_suppkey AS photo_id, l_partkey % 400 AS x, l_orderkey % 500 AS y FROM lineitem)
    SELECT photo_id, count(*) FILTER (x >= 208 - 10 AND x < 208 + 10 AND y >= 225 - 10 AND y < 225 + 10) AS cheek, count(*) FILTER ((285 - 115) * (y - 155) - (155 - 155) * (x - 115) >= 0 AND (270 - 285) * (y - 155) - (280 - 155) * (x - 285) >= 0 AND (130 - 270) * (y - 280) - (280 - 280) * (x - 270) >= 0 AND (115 - 130) * (y - 280) - (155 - 280) * (x - 130) >= 0) AS inner_face,
        count(*) FILTER (y < 41 AND (x < 80 OR x >= 320)) AS backdrop FROM p GROUP BY photo_id""")
def pixel_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in a cheek, the inner face and the backdrop's corners."""
    p = tables.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("photo_id"), (F.col("l_partkey") % 400).alias("x"), (F.col("l_orderkey") % 500).alias("y"))
    lm = [(150.0, 200.0), (250.0, 200.0), (200.0, 220.0), (150.0, 250.0), (250.0, 250.0)]
    marks = F.array(*[F.array(*[F.lit(v) for v in q]) for q in lm])
    x, y, d = F.col("x"), F.col("y"), F.lit(100.0)
    eye, mouth = (F.array(F.lit(a), F.lit(b)) for a, b in ((196.0, 200.0), (196.0, 250.0)))
    return p.groupBy("photo_id").agg(F.count_if(color.in_cheek(x, y, eye, mouth, 1, d)).alias("cheek"), F.count_if(color.in_inner_face(x, y, marks, d)).alias("inner_face"), F.count_if(color.in_backdrop(x, y, F.lit(400), F.lit(500))).alias("backdrop"))


@query("""WITH f AS (SELECT l_orderkey AS photo_id, l_linenumber, l_partkey, l_suppkey, (600 + l_partkey % 2800) * 1.0e0 AS cx, (500 + l_suppkey * 37 % 2000) * 1.0e0 AS cy, (40 + CAST(l_quantity AS BIGINT) + l_linenumber * 10) * 1.0e0 AS d FROM lineitem)
    SELECT photo_id, l_linenumber, l_partkey, l_suppkey, CAST(round_even(cx - d, 0) AS BIGINT) AS left, CAST(round_even(cy - 0.875e0 * d + 2.625e0 * d, 0) AS BIGINT) AS bottom, round_even(cx - 2 * d, 1) AS crop_left, round((cx - 0.5e0 * d - (cx - 2 * d)) * 2, 4) AS eye_x, round(3.4e0 * (2 * d) / 1.25e0 / (5 * d), 6) AS head, round(1600 / (4 * d), 6) AS upscale FROM f""")
def face_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report boxes, landmarks in a crop, head size and enlargement."""
    f = tables.faces(spark, sf_dir)
    cx, cy, d = F.col("box")[0] + F.col("box")[2] / 2, F.col("box")[1], F.col("box")[2] / 2
    f = f.withColumn("crop", F.struct((cx - 2 * d).alias("left"), cy.alias("top"), (cx + 2 * d).alias("right"), (cy + 5 * d).alias("bottom")))
    boxes = framing.report_boxes()
    eye = framing.moved(F.col("lm"), F.col("crop.left"), F.col("crop.top"), F.lit(2.0))[0][0]
    return f.select("photo_id", "l_linenumber", "l_partkey", "l_suppkey", boxes["face_box"][0].alias("left"), boxes["face_box"][3].alias("bottom"), boxes["crop_box"][0].alias("crop_left"), F.round(eye, 4).alias("eye_x"), F.round(framing.head_share(framing.face_scale(), F.lit(1.25), F.col("crop.bottom") - F.col("crop.top")), 6).alias("head"), F.round(framing.upscale(F.lit(1600)), 6).alias("upscale"))


_LIN = "CASE WHEN {0} / 255.0e0 <= 0.04045e0 THEN {0} / 255.0e0 / 12.92e0 ELSE pow(({0} / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) END"
_F = "CASE WHEN {0} > 216.0e0 / 24389 THEN cbrt({0}) ELSE (24389.0e0 / 27 * {0} + 16) / 116 END"


_SKIN = f"""WITH p AS (SELECT l_suppkey AS photo_id, l_partkey * 5 % 256 AS r, l_partkey * 3 % 256 AS g, (l_partkey + l_suppkey) % 256 AS b FROM lineitem),
    l AS (SELECT photo_id, {_LIN.format('r')} AS r, {_LIN.format('g')} AS g, {_LIN.format('b')} AS b FROM p),
    x AS (SELECT photo_id, (0.4124564e0 * r + 0.3575761e0 * g + 0.1804375e0 * b) / 0.95047e0 AS x, 0.2126729e0 * r + 0.7151522e0 * g + 0.0721750e0 * b AS y, (0.0193339e0 * r + 0.1191920e0 * g + 0.9503041e0 * b) / 1.08883e0 AS z FROM l),
    f AS (SELECT photo_id, {_F.format('x')} AS x, {_F.format('y')} AS y, {_F.format('z')} AS z FROM x), c AS (SELECT photo_id, 116 * y - 16 AS L, 500 * (x - y) AS a, 200 * (y - z) AS b FROM f),
    m AS (SELECT photo_id, count(*) FILTER (L > 20 AND L < 92) AS n, median(L) FILTER (L > 20 AND L < 92) AS L, median(a) FILTER (L > 20 AND L < 92) AS a, median(b) FILTER (L > 20 AND L < 92) AS b FROM c GROUP BY photo_id),
    k AS (SELECT photo_id, CASE WHEN n >= 20 THEN L END AS L, CASE WHEN n >= 20 THEN a END AS a, CASE WHEN n >= 20 THEN b END AS b FROM m), h AS (SELECT *, degrees(atan2(b, a)) AS hue, sqrt(a * a + b * b) AS chroma FROM k)"""


@query(f"""{_SKIN}
    SELECT photo_id, round(L, 4) AS skin_L, round(a, 4) AS skin_a, round(b, 4) AS skin_b, round(hue, 3) AS hue, round(chroma, 4) AS chroma, chroma < 6 OR (hue BETWEEN 28 AND 77 AND chroma <= 57) AS fine FROM h""")
def skin_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = color.skin_lab(pixels(spark, sf_dir))
    hue, chroma = color.hue_chroma(F.col("skin_a"), F.col("skin_b"))
    return s.select("photo_id", *[F.round(c, 4).alias(c) for c in ("skin_L", "skin_a", "skin_b")], F.round(hue, 3).alias("hue"), F.round(chroma, 4).alias("chroma"), color.skin_ok(hue, chroma).alias("fine"))


_NEAR_SQL = """near AS (SELECT *, list_filter([
        CASE WHEN eye_sharpness >= 0.6e0 AND eye_sharpness < 0.6e0 + 0.05e0 THEN 'eye sharpness ' || eye_sharpness END, CASE WHEN face_blown > 0.03e0 - 0.005e0 AND face_blown <= 0.03e0 THEN 'face blown ' || face_blown END,
        CASE WHEN clipping_added > 0.005e0 - 0.001e0 AND clipping_added <= 0.005e0 THEN 'clipping added ' || clipping_added END, CASE WHEN crushing_added > 0.005e0 - 0.001e0 AND crushing_added <= 0.005e0 THEN 'crushing added ' || crushing_added END,
        CASE WHEN gain > 1.6e0 - 0.05e0 AND gain <= 1.6e0 THEN 'sharpen gain ' || gain END, CASE WHEN up > 1.5e0 - 0.05e0 AND up <= 1.5e0 THEN 'upscale ' || up END], lambda x: x IS NOT NULL) AS hits
    FROM (SELECT *, (g // 10 + CASE WHEN g % 10 > 5 OR (g % 10 = 5 AND g // 10 % 2 = 1) THEN 1 ELSE 0 END) / 100.0e0 AS gain, (u // 10 + CASE WHEN u % 10 > 5 OR (u % 10 = 5 AND u // 10 % 2 = 1) THEN 1 ELSE 0 END) / 100.0e0 AS up FROM (SELECT *, {grade} AS grade, {n} AS n, 900 + photo_id % 790 AS g, 600 + photo_id % 950 AS u FROM {rows})))"""
ORACLE_SQL["decisions"] = f"""WITH {_JUDGED}, {_NEAR_SQL.format(grade=_GRADE('top'), n='n_reasons', rows='j')}
    SELECT photo_id, grade, CASE WHEN output IS NOT NULL THEN CASE WHEN grade = 'PASS' AND len(hits) > 0 THEN 'REVIEW' ELSE grade END END AS decided,
        CASE WHEN output IS NOT NULL THEN CASE grade WHEN 'FAIL' THEN 1.0e0 WHEN 'REVIEW' THEN round(least(0.95e0, 0.75e0 + 0.05e0 * least(n, 4)), 2) ELSE CASE WHEN len(hits) > 0 THEN 0.55e0 ELSE 0.95e0 END END END AS confidence,
        CASE WHEN output IS NULL THEN '' WHEN grade = 'FAIL' THEN '100% sure' WHEN grade = 'REVIEW' THEN (75 + 5 * least(n, 4)) || '% sure' WHEN len(hits) > 0 THEN '55% sure, close to the line: ' || regexp_replace(array_to_string(list_transform(hits[1:2], lambda h: regexp_replace(h, '\\.0$', '')), ', '), '$', '') ELSE '' END AS remark FROM near"""
ORACLE_SQL["intake"] = """WITH i AS (SELECT page_id % 90 AS request_id, '/drop/' || (page_id * 7 % 3) AS parent, '/f' || page_id || CASE WHEN page_id % 4 = 0 THEN '.mov' ELSE '.jpg' END AS name, page_id % 13 = 0 AS is_dir, page_id % 4 > 0 AS image FROM pages),
    c AS (SELECT request_id, count(*) FILTER (is_dir) AS folders, count(*) FILTER (NOT is_dir AND image) AS images, count(*) FILTER (NOT is_dir AND NOT image) AS others, min(parent || name) FILTER (is_dir) AS dir, min(parent) FILTER (NOT is_dir AND image) AS low, max(parent) FILTER (NOT is_dir AND image) AS high FROM i GROUP BY request_id),
    m AS (SELECT *, CASE WHEN folders > 0 AND images + others > 0 THEN 'Drop a folder, or drop photos — not both at once.' WHEN folders > 1 THEN 'Drop one folder at a time.' WHEN folders = 1 THEN NULL
        WHEN others > 0 AND images = 0 THEN 'That file type isn’t supported (.mov). Drop a folder, or photos: JPG, JPEG, PNG, HEIC.' WHEN others > 0 THEN 'Some dropped files aren’t photos. Drop only JPG, JPEG, PNG or HEIC — or a folder.' WHEN images = 0 THEN 'Nothing was dropped.' WHEN low <> high THEN 'Those photos are in different folders. Drop one folder, or photos from the same folder.' END AS message FROM c)
    SELECT request_id, CASE WHEN message IS NULL THEN CASE WHEN folders = 1 THEN dir ELSE low END END AS folder, message IS NULL AND folders = 0 AND images = 1 AS from_single_image, message FROM m"""
ORACLE_SQL["group_runs"] = f"""WITH {_VECS}, n AS (SELECT *, 'IMG_' || photo_id || '.jpg' AS name FROM v), g AS (SELECT set_id, group_no, min(idx) AS first, max(idx) AS last, count(*) AS shots, arg_min(name, idx) || '..' || arg_max(name, idx) AS span FROM n GROUP BY ALL),
    x AS (SELECT g.set_id, g.group_no, list(n.name ORDER BY n.idx) AS gap FROM g JOIN n ON n.set_id = g.set_id AND n.idx > g.first AND n.idx < g.last AND n.group_no <> g.group_no WHERE g.last - g.first + 1 <> g.shots GROUP BY ALL)
    SELECT g.set_id, g.group_no, first, last, shots, span, last - first + 1 = shots AS one_run, array_to_string(gap[1:6], ', ') || CASE WHEN len(gap) > 6 THEN ' ...' ELSE '' END AS skipping FROM g LEFT JOIN x ON g.set_id = x.set_id AND g.group_no = x.group_no"""
_BACK = [[float(v) for v in row] for row in np.linalg.inv(np.array(color.TO_XYZ))]
_CUBE = "CASE WHEN {0} > 6.0e0 / 29 THEN {0} * {0} * {0} ELSE (116 * {0} - 16) * 27 / 24389.0e0 END"


def _light(a: str, b: str) -> str:
    """Linear r, g and b (a list) of Lab, for L and these a and b."""
    y = "((L + 16) / 116)"
    x, y, z = (f"({_CUBE.format(v)}) * {w!r}" for v, w in zip((f"({y} + {a} / 500)", y, f"({y} - {b} / 200)"), color.WHITE, strict=True))
    return "[" + ", ".join(f"least(1.0e0, greatest(0.0e0, {m[0]!r}::DOUBLE * {x} + {m[1]!r}::DOUBLE * {y} + {m[2]!r}::DOUBLE * {z}))" for m in _BACK) + "]"


ORACLE_SQL["skin_colour"] = f"""{_SKIN},
    w AS (SELECT *, chroma >= 6 AND (hue NOT BETWEEN 30 AND 75 OR chroma > 55) AS needed, radians(CASE WHEN hue < 30 THEN 34.0e0 WHEN hue > 75 THEN 71.0e0 ELSE hue END) AS turn, CASE WHEN chroma > 55 THEN 49.0e0 ELSE chroma END AS reach FROM h),
    g AS (SELECT *, list_transform(list_zip({_light('(reach * cos(turn))', '(reach * sin(turn))')}, {_light('a', 'b')}), lambda v: v[1] / greatest(v[2], 1e-4)) AS gain FROM w),
    e AS (SELECT *, list_transform(gain, lambda v: round(greatest(0.75e0, least(1.3e0, v / (0.2126e0 * gain[1] + 0.7152e0 * gain[2] + 0.0722e0 * gain[3]))), 4)) AS gains FROM g)
    SELECT photo_id, round(L, 4) AS skin_L, round(a, 4) AS skin_a, round(b, 4) AS skin_b, round(hue, 3) AS hue, round(chroma, 4) AS chroma, CASE WHEN needed THEN gains[1] END AS gain_r, CASE WHEN needed THEN gains[2] END AS gain_g, CASE WHEN needed THEN gains[3] END AS gain_b,
        CASE WHEN needed THEN 'fixed a ' || CASE WHEN hue BETWEEN 30 AND 75 THEN 'warm/orange' WHEN hue < 30 THEN 'magenta/blue' ELSE 'yellow-green' END || ' color cast' END AS cast FROM e"""
_LUMA = "0.2126e0 * {0} + 0.7152e0 * {1} + 0.0722e0 * {2}"
ORACLE_SQL["pixel_shares"] = f"""WITH p AS (SELECT l_suppkey AS photo_id, l_partkey * 5 % 256 AS r, l_partkey * 3 % 256 AS g, (l_partkey + l_suppkey) % 256 AS b FROM lineitem),
    q AS (SELECT photo_id, greatest(r, g, b) AS peak, greatest(r // 2, g // 2, b // 2) AS peak0, {_LUMA.format('r', 'g', 'b')} AS y, {_LUMA.format('(r // 2)', '(g // 2)', '(b // 2)')} AS y0, round(0.299e0 * r + 0.587e0 * g + 0.114e0 * b) AS gray FROM p)
    SELECT photo_id, round(avg(CASE WHEN y >= 250 THEN 1.0e0 ELSE 0 END), 6) AS face_blown, round(avg(CASE WHEN peak >= 254 AND peak0 < 250 THEN 1.0e0 ELSE 0 END), 6) AS clipping_added, round(avg(CASE WHEN y <= 3 AND y0 > 10 THEN 1.0e0 ELSE 0 END), 6) AS crushing_added,
        round(least(quantile_cont(y / 255, 0.0005), 0.05e0), 6) AS black_point, round(greatest(quantile_cont(peak / 255.0e0, 0.9995), 0.92e0), 6) AS white_point, round(median(gray), 6) AS backdrop_luma FROM q GROUP BY photo_id"""


_BY_SET = {"width <> 1600 OR height <> 2000": "width <> own_width OR height <> own_height", "eye_line - 0.42e0": "eye_line - own_line", "0.02e0 AND 0.2e0": "0.02e0 AND 0.2e0 + 0.4e0 * greatest(0.0e0, 1 - own_zoom)", "WHEN NOT (skin": "WHEN NOT own_bw AND NOT (skin"}


def _own_rank(sql: str, always: bool) -> str:
    for a, b in _BY_SET.items():
        sql = sql.replace(a, b)
    return f"coalesce({sql}, 0)" if always else f"CASE WHEN face > 0 THEN coalesce({sql}, 0) ELSE 0 END"


@query(f"""WITH m AS (SELECT *, CASE WHEN set_id % 4 = 0 THEN 1200 ELSE 1600 END AS own_width, CASE WHEN set_id % 4 = 0 THEN 1500 ELSE 2000 END AS own_height, (40 + set_id % 5) / 100.0e0 AS own_line, (70 + set_id % 50) / 100.0e0 AS own_zoom, set_id % 2 = 0 AS own_bw FROM ({tables.MEASURES_SQL})),
    q AS (SELECT *, [{", ".join(_own_rank(sql, always) for _, sql, always in _CHECKS)}] AS ranks FROM m)
    SELECT set_id, photo_id, {_GRADE('list_max(ranks)')} AS grade, CAST(len(list_filter(ranks, lambda x: x > 0)) AS INTEGER) AS n_reasons,
        coalesce(CASE WHEN ranks[1] > 0 THEN 'size ' || width || 'x' || height || ', expected ' || own_width || 'x' || own_height END, '') AS size_text,
        coalesce(CASE WHEN ranks[5] > 0 THEN 'not ' || (40 + set_id % 5) || '%' END, '') AS eye_text FROM q""")
def judged_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every set judged by its own settings."""
    m = tables.measures(spark, sf_dir)
    s = F.col("set_id")
    settings = m.select("set_id").distinct().select("set_id", F.lit(0.8).alias("ratio"), F.when(s % 4 == 0, 1200).otherwise(1600).alias("width"), ((70 + s % 50) / 100).alias("zoom"), ((40 + s % 5) / 100).alias("eye_line"), (s % 2 == 0).alias("bw"))
    rows = grading.judge_sets(m, settings)
    text = lambda start: F.coalesce(F.array_join(F.filter("reasons", lambda r: r.startswith(start)), ""), F.lit(""))
    return rows.select("set_id", "photo_id", "grade", F.size("reasons").alias("n_reasons"), text("size").alias("size_text"), F.regexp_extract(text("eyes at"), "not .*", 0).alias("eye_text"))


def _pass_sql(kind: str, bare: str) -> str:
    """Final grades of a pass, as f: kind is the class of photo k, bare whether it has no measures."""
    return f"""WITH {_JUDGED}, {_AGAIN}, c AS (SELECT q.*, r.ranks, k, {kind} AS class, {bare} AS bare FROM (SELECT *, photo_id AS k FROM q) q JOIN r ON r.photo_id = q.photo_id),
    t AS (SELECT * REPLACE (CASE WHEN bare AND class = 'todo' THEN NULL ELSE output END AS output), {_GRADE("list_max(CASE WHEN class = 'hand_edited' THEN again ELSE ranks END)")} AS judged FROM c),
    o AS (SELECT *, CASE WHEN class = 'reuse' OR (class = 'hand_edited' AND bare) THEN CASE WHEN k % 5 = 0 THEN 'REVIEW' ELSE 'PASS' END WHEN output IS NULL THEN 'SKIPPED' ELSE judged END AS own FROM t),
    {_NEAR_SQL.format(grade='own', n='0', rows='o')},
    d AS (SELECT set_id, photo_id, class, output, CASE WHEN own = 'PASS' AND len(CASE WHEN class = 'hand_edited' AND NOT bare THEN list_filter(hits, lambda x: NOT starts_with(x, 'upscale')) ELSE hits END) > 0 THEN 'REVIEW' ELSE own END AS g, round_even(head_size, 3) AS head_size FROM near),
    s AS (SELECT set_id, median(head_size) FILTER (output IS NOT NULL) AS head_median, count(head_size) FILTER (output IS NOT NULL) AS n_heads FROM d GROUP BY set_id),
    f AS (SELECT d.*, CASE WHEN output IS NULL THEN 'SKIPPED' WHEN g = 'PASS' AND {_FLAG} THEN 'REVIEW' ELSE g END AS final, {_FLAG} AS flag FROM d JOIN s ON d.set_id = s.set_id)"""


_FINALS = "count(*) FILTER (flag) AS n_flagged, count(*) FILTER (final = 'PASS') AS n_pass, count(*) FILTER (final = 'REVIEW') AS n_review, count(*) FILTER (final = 'FAIL') AS n_fail, count(*) FILTER (final = 'SKIPPED') AS n_skipped"


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all photos, as a pass takes them; of every 47th there are none."""
    m = tables.measures(spark, sf_dir)
    return m.filter("photo_id % 47 > 0").withColumn("source", F.col("photo_id").cast("string"))


@query(f"""{_pass_sql(_CLASS, 'k % 47 = 0')}
    SELECT set_id, count(*) FILTER (class <> 'reuse') AS processed, count(*) FILTER (class = 'reuse') AS unchanged, {_FINALS} FROM f GROUP BY set_id""")
def run_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole grading pass over all sets: listing, report, measures, decisions (on unchanged photos too), photos
    without measures, checks over the set, summary."""
    files, report = incremental_inputs(spark, sf_dir)
    m = grading.stored(tables.measures(spark, sf_dir)).withColumn("source", F.col("photo_id").cast("string")).drop("set_id", "photo_id", "output")
    k = F.col("source").cast("long")
    saved = report.withColumns({"grade": F.when(k % 5 == 0, "REVIEW").otherwise("PASS"), "reasons": F.array().cast("array<string>")}).join(m, "source")
    photo = lambda df: df.withColumn("source", F.concat(F.lit("P"), F.col("source"), F.lit(".jpg")))
    run = passes.run_sets(photo(files), photo(saved), photo(_measures(spark, sf_dir)), F.lit("key"))
    return run.summary.select("set_id", "processed", "unchanged", "n_flagged", "n_pass", "n_review", "n_fail", "n_skipped")


@query(f"""{_pass_sql("'todo'", 'k % 47 = 0')}
    SELECT set_id, 0::BIGINT AS processed, count(*) AS unchanged, {_FINALS} FROM f GROUP BY set_id""")
def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass over all sets whose reports are stored and read again as the next pass's own: nothing is new, and every
    grade stays."""
    files, _ = incremental_inputs(spark, sf_dir)
    files = files.withColumn("source", F.concat(F.lit("P"), F.col("source"), F.lit(".jpg")))
    m = _measures(spark, sf_dir).withColumns({"source": F.concat(F.lit("P"), F.col("source"), F.lit(".jpg")), "out_mtime_ns": F.col("photo_id") * 7, "set_id": F.col("set_id").cast("string")})
    files = files.withColumn("set_id", F.col("set_id").cast("string"))
    none = reports.flat(spark.createDataFrame([], "set_id string, " + ", ".join(f"{c} {t}" for c, t in reports.PHOTO_TYPES.items()))).withColumn("now_mtime_ns", F.lit(None).cast("long"))
    root = f"{shared_dir(spark)}/proofset/reports-{uuid.uuid4().hex}"
    settings = files.select("set_id", F.lit(None).cast(reports.SETTINGS).alias("settings")).distinct()
    with scratch(spark):
        with scratch(spark):  # of the first pass only its reports stay
            documents = stored_once(passes.run_sets(files, none, m, F.lit("key")).documents(settings), keep=True)
        reports.write_reports(documents, root, folders=False)
    with scratch(spark):
        documents = stored_once(reports.stored_reports(spark, root, folders=False))
        remove(spark, root)
        saved = stored_once(reports.report_index(documents), keep=True)
    saved = reports.flat(saved).withColumn("now_mtime_ns", F.col("out_mtime_ns"))
    run = passes.run_sets(files, saved, m, F.lit("key"))
    return run.summary.select(F.col("set_id").cast("long").alias("set_id"), "processed", "unchanged", "n_flagged", "n_pass", "n_review", "n_fail", "n_skipped")


# Clustering step by step: r holds all pairs of groups after each merge; the best of a step is the next merge.
_MERGES = f"""WITH RECURSIVE {_VECS},
    r AS (SELECT set_id, 0 AS step, i AS a, j AS b, sim AS total, 1 AS na, 1 AS nb FROM p
        UNION ALL SELECT set_id, step + 1 AS step, least(x, y) AS a, greatest(x, y) AS b, sum(total) AS total, max(CASE WHEN x < y THEN nx ELSE ny END) AS na, max(CASE WHEN x < y THEN ny ELSE nx END) AS nb
        FROM (SELECT set_id, step, total, CASE WHEN a = bj THEN bi ELSE a END AS x, CASE WHEN b = bj THEN bi ELSE b END AS y, CASE WHEN a IN (bi, bj) THEN ni + nj ELSE na END AS nx, CASE WHEN b IN (bi, bj) THEN ni + nj ELSE nb END AS ny
            FROM (SELECT *, first_value(a) OVER o AS bi, first_value(b) OVER o AS bj, first_value(na) OVER o AS ni, first_value(nb) OVER o AS nj FROM r WINDOW o AS (PARTITION BY set_id ORDER BY total / (na * nb) DESC, a, b)))
        WHERE x <> y GROUP BY set_id, step, least(x, y), greatest(x, y)),
    m AS (SELECT set_id, step, a AS i, b AS j, min(h) OVER (PARTITION BY set_id ORDER BY step) AS low FROM (SELECT *, total / (na * nb) AS h, row_number() OVER (PARTITION BY set_id, step ORDER BY total / (na * nb) DESC, a, b) AS n FROM r) WHERE n = 1),
    cuts(raw, cut) AS (VALUES {", ".join(f"({raw!r}::DOUBLE, {cut!r}::DOUBLE)" for raw, cut in grouping.cuts())}),
    n AS (SELECT set_id, count(*) AS n FROM u GROUP BY set_id),
    sw AS (SELECT n.set_id, cut, CAST(n.n - count(m.low) AS INTEGER) AS students FROM n CROSS JOIN cuts LEFT JOIN m ON m.set_id = n.set_id AND m.low >= cuts.raw GROUP BY n.set_id, cut, n.n)"""
ORACLE_SQL["cut_sweep"] = f"""{_MERGES} SELECT set_id, cut, students, abs(cut - 0.363e0) < 0.005e0 AS marked FROM (SELECT *, lag(students) OVER (PARTITION BY set_id ORDER BY cut) AS was FROM sw)
    WHERE was IS NULL OR was <> students OR abs(cut - 0.363e0) < 0.005e0"""
ORACLE_SQL["clustering"] = f"""{_MERGES},
    st AS (SELECT *, CASE WHEN students = lag(students) OVER (PARTITION BY set_id ORDER BY cut) THEN 0 ELSE 1 END AS new FROM sw WHERE cut BETWEEN 0.3e0 - 1e-9 AND 0.78e0 + 1e-9),
    runs AS (SELECT set_id, run, list(cut ORDER BY cut) AS c FROM (SELECT *, sum(new) OVER (PARTITION BY set_id ORDER BY cut ROWS UNBOUNDED PRECEDING) AS run FROM st) GROUP BY set_id, run),
    chosen AS (SELECT set_id, c[len(c) // 2 + 1] AS cut FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY len(c) DESC, c[1] DESC) AS n FROM runs) WHERE n = 1),
    g AS (SELECT set_id, idx, idx AS cur FROM u UNION ALL SELECT g.set_id, g.idx, m.i AS cur FROM g JOIN chosen ON chosen.set_id = g.set_id JOIN m ON m.set_id = g.set_id AND m.j = g.cur AND m.low >= chosen.cut),
    f AS (SELECT set_id, idx, min(cur) AS first FROM g GROUP BY ALL)
    SELECT set_id, idx, CAST(dense_rank() OVER (PARTITION BY set_id ORDER BY first) AS INTEGER) AS group_no, 'S' || lpad(CAST(dense_rank() OVER (PARTITION BY set_id ORDER BY first) AS VARCHAR), 2, '0') AS student FROM f"""


@query(None)
def analysis_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole grouping pass over all sets: the text summary."""
    report = tables.measures(spark, sf_dir).select("set_id", "output", F.col("output").alias("source"), F.lit("PASS").alias("grade"), F.array().cast("array<string>").alias("reasons"), "eye_sharpness", "head_size")
    return passes.analyze_sets(tables.fingerprints(spark, sf_dir), report).lines



# The search as rows: 36 heights by 67 drifts for each photo. Drifts are counted up as the arrays of the search are.
ORACLE_SQL["crop_plans"] = """WITH f AS (SELECT l_orderkey AS photo_id, (600 + l_partkey % 2800) * 1.0e0 AS cx, (500 + l_suppkey * 37 % 2000) * 1.0e0 AS cy, (40 + CAST(l_quantity AS BIGINT) + l_linenumber * 10) * 1.0e0 AS d, CAST(l_quantity AS BIGINT) AS q, l_partkey, l_suppkey, l_linenumber FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY d DESC, l_partkey, l_suppkey, l_linenumber, q) AS n FROM f),
    c AS (SELECT photo_id, cx, cy, 2 * d AS s, CASE WHEN l_linenumber % 2 = 0 THEN cy - 1.25e0 * d END AS crown, 3.4e0 * (2 * d) / 1.0e0 AS ideal FROM r WHERE n = 1),
    t AS (SELECT *, least(least(ideal * (1 - i * 0.01e0), 3024.0e0), 4032.0e0 / 0.8e0) AS tall FROM c, (SELECT unnest(range(36)) AS i)),
    u AS (SELECT *, abs(least(greatest(cx - tall * 0.8e0 / 2, 0), 4032 - tall * 0.8e0) - (cx - tall * 0.8e0 / 2)) / (tall * 0.8e0) AS slide, 1 - tall / ideal AS zoomed FROM t),
    k AS (SELECT *, -0.08e0 + j * ((-0.08e0 + 0.005e0) - -0.08e0) AS drift FROM u, (SELECT unnest(range(67)) AS j)),
    v AS (SELECT *, cy - (0.42e0 + drift) * tall AS top FROM k), x AS (SELECT *, (crown - 0.03e0 * s - top) / tall AS room FROM v),
    y AS (SELECT photo_id, min(ROW(3 * zoomed + 10 * greatest(0, zoomed - 0.12e0) + slide + 4 * abs(drift) + 20 * greatest(0, drift - 0.10e0) + CASE WHEN crown IS NULL THEN 0 ELSE 3 * greatest(0, 0.06e0 - room) END, i, j, drift, tall, top))
        FILTER (NOT (slide > 0.12e0 + 1e-6 OR top < -0.5e0 OR top + tall > 3024.5e0 OR coalesce(room < 0.03e0, FALSE))) AS best FROM x GROUP BY photo_id),
    z AS (SELECT c.*, best IS NULL AS none, CASE WHEN best IS NULL THEN least(least(ideal * (1 - 0.12e0), 3024.0e0), 4032.0e0 / 0.8e0) ELSE best[5] END AS high, best FROM c JOIN y ON c.photo_id = y.photo_id),
    b AS (SELECT *, least(greatest(cx - high * 0.8e0 / 2, 0), 4032 - high * 0.8e0) AS l, CASE WHEN none THEN least(greatest(cy - 0.42e0 * high, 0), greatest(0, 3024 - high)) ELSE greatest(0.0e0, best[6]) END AS o FROM z),
    e AS (SELECT *, 1 - high / ideal AS zoom_in, CASE WHEN none THEN (cy - o) / high - 0.42e0 ELSE best[4] END AS drift, abs(l - (cx - high * 0.8e0 / 2)) / (high * 0.8e0) AS slid FROM b),
    n AS (SELECT *, list_filter([CASE WHEN none THEN 'the photo doesn''t leave room for the standard framing' END, CASE WHEN zoom_in > 0.01e0 THEN 'framed ' || CAST(round_even(zoom_in * 100, 0) AS INTEGER) || '% tighter to fit the photo' END,
        CASE WHEN drift > 0.01e0 THEN 'eyes ' || CAST(round_even(drift * 100, 0) AS INTEGER) || '% lower than standard, to keep the whole head in' WHEN drift < -0.01e0 THEN 'eyes ' || CAST(round_even(-drift * 100, 0) AS INTEGER) || '% higher than standard (subject sits high in the photo)' END,
        CASE WHEN slid > 0.05e0 THEN CAST(round_even(slid * 100, 0) AS INTEGER) || '% off-center (subject near the edge)' END], lambda w: w IS NOT NULL) AS notes FROM e)
    SELECT photo_id, CAST(NULL AS VARCHAR) AS skip_reason, round_even(3.4e0 * s / 1.0e0 / (o + high - o), 3) AS planned_head, array_to_string(notes, '; ') AS notes, round(l, 3) AS left, round(o, 3) AS top, round(l + high * 0.8e0, 3) AS right, round(o + high, 3) AS bottom FROM n"""
