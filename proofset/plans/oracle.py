"""SQL (DuckDB) that gives the rows of the registered queries on the same tables."""

from __future__ import annotations

from proofset.plans.tables import MEASURES_SQL

# Ranks of the checks, in order; NULL or 0 is a pass; the last item: it runs without a face too.
_CHECKS = [
    ("size", "CASE WHEN width <> 1600 OR height <> 2000 THEN 2 END", True), ("no s", "CASE WHEN NOT srgb THEN 2 END", True), ("meta", "CASE WHEN metadata_tags > 0 THEN 2 END", True), ("no f", "CASE WHEN face = 0 THEN 2 END", True),
    ("eyes", "CASE WHEN eye_line - 0.42e0 BETWEEN -0.03e0 AND 0.11e0 THEN 0 WHEN eye_line - 0.42e0 BETWEEN -0.10e0 AND 0.16e0 THEN 1 ELSE 2 END", False),
    ("room", "CASE WHEN headroom NOT BETWEEN 0.02e0 AND 0.2e0 THEN 1 END", False),
    ("face", "CASE WHEN center - 0.5e0 BETWEEN -0.04e0 AND 0.04e0 THEN 0 WHEN center - 0.5e0 BETWEEN -0.15e0 AND 0.15e0 THEN 1 ELSE 2 END", False),
    ("head", "CASE WHEN planned_head IS NULL THEN CASE WHEN head_size BETWEEN 0.9e0 AND 1.1e0 THEN 0 WHEN head_size BETWEEN 0.75e0 AND 1.3e0 THEN 1 ELSE 2 END WHEN head_size / planned_head BETWEEN 0.92e0 AND 1.08e0 THEN 0 WHEN head_size / planned_head BETWEEN 0.8e0 AND 1.25e0 THEN 1 ELSE 2 END", False),
    ("some", "CASE WHEN other_faces > 0 THEN 1 END", False), ("blown", "CASE WHEN face_blown > 0.03e0 THEN 1 END", False),
    ("skin", "CASE WHEN NOT (skin_chroma < 6 OR (skin_hue BETWEEN 28 AND 77 AND skin_chroma <= 57)) THEN 1 END", False), ("eyes soft", "CASE WHEN eye_sharpness < 0.6e0 THEN 1 END", False),
    ("edit", "CASE WHEN fidelity_ssim BETWEEN 0.9e0 AND 1 THEN 0 WHEN fidelity_ssim BETWEEN 0.8e0 AND 1 THEN 1 ELSE 2 END", False),
    ("clip", "CASE WHEN clipping_added > 0.005e0 THEN 1 END", False), ("crush", "CASE WHEN crushing_added > 0.005e0 THEN 1 END", False),
    ("light", "CASE WHEN abs(face_lightness_change) <= 8 THEN 0 WHEN abs(face_lightness_change) <= 20 THEN 1 ELSE 2 END", False),
    ("over", "CASE WHEN sharpen_gain > 1.6e0 THEN 1 END", False), ("up", "CASE WHEN upscale > 1.5e0 THEN 1 END", False),
]
_RANKS = ", ".join(f"coalesce({sql}, 0)" if always else f"CASE WHEN face > 0 THEN coalesce({sql}, 0) ELSE 0 END" for _, sql, always in _CHECKS)
_GRADE = lambda r: f"CASE {r} WHEN 2 THEN 'FAIL' WHEN 1 THEN 'REVIEW' ELSE 'PASS' END"
_JUDGED = f"m AS ({MEASURES_SQL}), r AS (SELECT *, [{_RANKS}] AS ranks FROM m), j AS (SELECT *, list_max(ranks) AS top, len(list_filter(ranks, lambda x: x > 0)) AS n_reasons FROM r)"
_SETS = """
    s AS (SELECT set_id, median(head_size) FILTER (output IS NOT NULL) AS head_median, count(head_size) FILTER (output IS NOT NULL) AS n_heads,
        min(backdrop_luma) FILTER (output IS NOT NULL) AS low, max(backdrop_luma) FILTER (output IS NOT NULL) AS high, count(backdrop_luma) FILTER (output IS NOT NULL) AS n_backdrops FROM m GROUP BY set_id)
"""
_FLAG = "coalesce(output IS NOT NULL AND n_heads >= 3 AND abs(head_size / head_median - 1) > 0.08e0, FALSE)"
_FINAL = f"CASE WHEN output IS NULL THEN 'SKIPPED' ELSE {_GRADE(f'greatest(top, CASE WHEN {_FLAG} THEN 1 ELSE 0 END)')} END"
_VECS = """
    v AS (SELECT label AS set_id, vec_id AS photo_id, vec_id % 7 AS group_no, embedding::DOUBLE[] AS e,
        row_number() OVER (PARTITION BY label ORDER BY vec_id, concat('IMG_', vec_id, '.jpg')) - 1 AS idx FROM embeddings),
    u AS (SELECT *, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS vec FROM v),
    p AS (SELECT a.set_id, a.idx AS i, b.idx AS j, a.group_no AS ga, b.group_no AS gb, greatest(-1, least(1, list_dot_product(a.vec, b.vec))) AS sim FROM u a JOIN u b ON a.set_id = b.set_id AND a.idx < b.idx)
"""
_EVENTS = """
    e AS (SELECT user_id AS set_id, event_id, ts, 's' || (event_id % 20) AS source, ['PASS', 'REVIEW', 'FAIL', 'SKIPPED'][event_id % 4 + 1] AS grade FROM events WHERE event_id % 10 > 1)
"""
_PATH = "url || ['.JPG', '/a.webp', '/.hidden', '/IMG_12.tar.gz', '/'][page_id % 5 + 1]"

ORACLE_SQL: dict[str, str] = {
    "judged": f"WITH {_JUDGED} SELECT photo_id, {_GRADE('top')} AS grade, CAST(n_reasons AS INTEGER) AS n_reasons FROM j",
    "grade_counts": f"WITH {_JUDGED}, {_SETS}, f AS (SELECT j.set_id, {_FINAL} AS g, {_FLAG} AS flag FROM j JOIN s ON j.set_id = s.set_id) SELECT set_id, count(*) FILTER (g = 'PASS') AS n_pass, count(*) FILTER (g = 'REVIEW') AS n_review, count(*) FILTER (g = 'FAIL') AS n_fail, count(*) FILTER (g = 'SKIPPED') AS n_skipped, count(*) FILTER (flag) AS n_flagged, bool_or(g = 'FAIL') AS failed FROM f GROUP BY set_id",
    "run_summary": f"WITH {_JUDGED}, {_SETS}, f AS (SELECT j.set_id, photo_id, {_FINAL} AS g FROM j JOIN s ON j.set_id = s.set_id) SELECT set_id, count(*) FILTER (photo_id % 3 <> 0) AS processed, count(*) FILTER (photo_id % 3 = 0) AS unchanged, CAST(greatest(1, ceil(count(*) / 30.0)) AS BIGINT) AS pages, count(*) FILTER (g = 'PASS') AS n_pass, count(*) FILTER (g = 'REVIEW') AS n_review, count(*) FILTER (g = 'FAIL') AS n_fail, count(*) FILTER (g = 'SKIPPED') AS n_skipped FROM f GROUP BY set_id",
    "set_checks": f"WITH m AS ({MEASURES_SQL}), {_SETS} SELECT s.set_id, round(any_value(head_median), 6) AS head_median, any_value(n_heads) AS n_heads, any_value(CASE WHEN n_backdrops >= 2 AND high - low > 40 THEN 'backdrop brightness varies a lot across the set (' || CAST(low AS INTEGER) || '-' || CAST(high AS INTEGER) || ' of 255): shoot everyone in one spot' END) AS set_note, count(*) FILTER ({_FLAG}) AS n_flagged FROM m JOIN s ON m.set_id = s.set_id GROUP BY s.set_id",
    "incremental_plan": """
        WITH f AS (SELECT o_custkey AS set_id, o_orderkey AS k FROM orders), c AS (
            SELECT set_id, CASE WHEN k % 11 = 0 THEN 'todo'
                WHEN k % 23 > 0 AND k % 31 > 0 AND k % 37 = 0 THEN 'hand_edited' WHEN k % 23 > 0 AND k % 31 > 0 AND k % 19 = 0 THEN 'reuse'
                WHEN k % 13 > 0 AND k % 17 > 0 AND (k % 23 = 0 OR k % 31 > 0) THEN 'reuse' ELSE 'todo' END AS class FROM f)
        SELECT set_id, class, count(*) AS n FROM c GROUP BY ALL""",
    "picked_sources": """
        WITH l AS (SELECT DISTINCT o_custkey AS set_id, CASE WHEN o_orderkey % 7 = 0 THEN 'IMG_E' ELSE 'IMG_' END || (o_orderkey % 50) AS stem, o_orderkey % 5 AS x FROM orders),
        b AS (SELECT set_id, stem, min(x) AS x FROM l WHERE x < 4 GROUP BY ALL)
        SELECT b.set_id, stem || ['.HEIC', '.jpg', '.png', '.tiff'][CASE x WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END] AS source FROM b
        WHERE stem LIKE 'IMG\\_E%' ESCAPE '\\' OR NOT EXISTS (SELECT 1 FROM b e WHERE e.set_id = b.set_id AND e.stem = replace(b.stem, 'IMG_', 'IMG_E'))""",
    "path_functions": f"""
        WITH r AS (SELECT page_id, {_PATH} AS p FROM pages), n AS (SELECT *, regexp_extract(regexp_replace(p, '/+$', ''), '[^/]*$') AS name FROM r),
        x AS (SELECT *, lower(regexp_extract(name, '^.*[^.](\\.[^.]+)$', 1)) AS ext FROM n)
        SELECT page_id, ext, regexp_extract(regexp_replace(p, '/+$', ''), '^(.*)/', 1) AS parent, ext IN ('.heic', '.heif', '.jpg', '.jpeg', '.png', '.tif', '.tiff', '.webp') AS supported,
            coalesce(TRY_CAST(regexp_extract(regexp_replace(name, '(.)\\.[^.]+$', '\\1'), '[0-9]+') AS BIGINT), 0) AS shot FROM x""",
    "subject_faces": """
        WITH f AS (SELECT l_orderkey AS photo_id, (40 + CAST(l_quantity AS BIGINT) + l_linenumber * 10) * 1.0e0 AS d, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem),
        s AS (SELECT *, greatest(2 * d, 1.8e0 * 0.875e0 * d) AS scale FROM f),
        r AS (SELECT *, row_number() OVER w AS n, lead(scale) OVER w AS second, count(*) OVER (PARTITION BY photo_id) AS n_faces, max(scale) OVER (PARTITION BY photo_id) AS top FROM s WINDOW w AS (PARTITION BY photo_id ORDER BY d DESC, l_partkey, l_suppkey, l_linenumber, l_quantity)),
        o AS (SELECT photo_id, sum(CASE WHEN n > 1 AND scale > 0.4e0 * top THEN 1 ELSE 0 END) AS other_faces FROM r GROUP BY photo_id)
        SELECT r.photo_id, round(scale, 6) AS scale, n_faces, CAST(other_faces AS BIGINT) AS other_faces, CASE WHEN second > 0.6e0 * scale THEN n_faces || ' people, framed the largest face' END AS people_note FROM r JOIN o ON r.photo_id = o.photo_id WHERE n = 1""",
    "lonely_photos": f"""
        WITH {_VECS}, b AS (SELECT set_id, i AS idx, sim FROM p UNION ALL SELECT set_id, j, sim FROM p), m AS (SELECT set_id, idx, max(sim) AS best FROM b GROUP BY ALL),
        r AS (SELECT m.*, row_number() OVER (PARTITION BY set_id ORDER BY best, idx) AS place FROM m)
        SELECT r.set_id, CAST(place AS INTEGER) AS place, photo_id, group_no, round(best, 6) AS best_other FROM r JOIN u ON r.set_id = u.set_id AND r.idx = u.idx WHERE place <= 6""",
    "pair_diagnostics": f"""
        WITH {_VECS}, w AS (SELECT set_id, ga, min(sim) AS sim FROM p WHERE ga = gb GROUP BY ALL), x AS (SELECT set_id, least(ga, gb) AS a, greatest(ga, gb) AS b, avg(sim) AS sim FROM p WHERE ga <> gb GROUP BY ALL),
        a AS (SELECT set_id, min(sim) AS weakest, median(sim) AS weakest_median FROM w GROUP BY set_id), c AS (SELECT set_id, max(sim) AS closest, median(sim) AS closest_median, count(*) AS n_pairs FROM x GROUP BY set_id)
        SELECT a.set_id, round(weakest, 6) AS weakest, round(weakest_median, 6) AS weakest_median, round(closest, 6) AS closest, round(closest_median, 6) AS closest_median, round(weakest - closest, 6) AS gap, n_pairs FROM a JOIN c ON a.set_id = c.set_id""",
    "picks": f"""
        WITH {_VECS}, r AS (SELECT *, photo_id % 5 > 0 AS known FROM v),
        o AS (SELECT *, CASE WHEN NOT known OR photo_id % 2 > 0 THEN 0 WHEN photo_id % 3 > 0 THEN 1 ELSE 2 END AS own, CASE WHEN known THEN (photo_id % 11) / 10.0e0 ELSE 0 END AS sharp, CASE WHEN known THEN abs(0.9e0 + (photo_id % 7) / 20.0e0 - 1) ELSE 0 END AS off FROM r)
        SELECT set_id, photo_id, group_no, row_number() OVER (PARTITION BY set_id, group_no ORDER BY idx) || '/' || count(*) OVER (PARTITION BY set_id, group_no) AS frame_of, CASE WHEN known THEN 'src' || photo_id ELSE '' END AS source,
            row_number() OVER (PARTITION BY set_id, group_no ORDER BY own, sharp DESC, off, idx) = 1 AS pick FROM o""",
    "event_counts": f"WITH {_EVENTS} SELECT set_id, count(*) AS done, count(*) FILTER (grade = 'PASS') AS n_pass, count(*) FILTER (grade = 'REVIEW') AS n_review, count(*) FILTER (grade = 'FAIL') AS n_fail, count(*) FILTER (grade = 'SKIPPED') AS n_skipped FROM e GROUP BY set_id",
    "latest_events": f"WITH {_EVENTS} SELECT set_id, source, max(event_id) AS event_id, arg_max(grade, event_id) AS grade FROM e GROUP BY ALL",
    "event_progress": f"WITH {_EVENTS}, r AS (SELECT set_id, event_id, row_number() OVER (PARTITION BY set_id ORDER BY event_id, source) AS done, count(*) OVER (PARTITION BY set_id) AS total FROM e) SELECT set_id, event_id, done, total, CAST(round(done * 100.0e0 / total) AS INTEGER) AS percent FROM r",
    "folder_sessions": """
        WITH g AS (SELECT user_id AS set_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY set_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT set_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 2 HOUR) AS ended, count(*) AS changes FROM s GROUP BY set_id, run""",
}
