"""Passes over sets that are saved and read again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from proofset import session
from proofset.functions import paths
from proofset.plans import passes
from proofset.sources import report as rp
from proofset.sources import store

LISTING = "set_id string, source string, size long, mtime_ns long"
MEASURES = "set_id string, source string, output string, out_mtime_ns long, eye_sharpness double, head_size double, upscale double, skip_reason string, notes array<string>"
EMPTY = f"set_id string, {', '.join(f'{k} {v}' for k, v in rp.PHOTO_TYPES.items() if k != 'metrics')}, metrics {rp.METRICS}"


def photos(*sets):
    return [(s, f"IMG_{k}.jpg", 10 + k, 100 + k) for s in sets for k in range(6)]


def measured(spark, rows, change=None):
    out = []
    for s, n, _, at in rows:
        k = at - 100
        skip = "no face found" if k == 4 else None
        out.append((s, n, None if skip else n, None if skip else at + 1, [0.9, 0.62, 0.3, 0.9, 0.9, 0.9][k], [1.0, 1.0, 1.0, 1.3, None, 1.0][k], 1.0, skip, ["framed"] if k == 0 else None))
    if change:
        out = [change(r) for r in out]
    return spark.createDataFrame([r for r in out if r], MEASURES)


def previous(spark, root, outputs):
    """The stored report as the next pass takes it; outputs: the polished files that are there (set, name, time)."""
    found = rp.flat(rp.report_index(rp.stored_reports(spark, root)))
    return passes.with_output_times(found, spark.createDataFrame(outputs, "set_id string, source string, mtime_ns long"))


def nothing(spark):
    return rp.flat(spark.createDataFrame([], EMPTY)).withColumn("now_mtime_ns", F.lit(None).cast("long"))


def settings(spark, *sets):
    return spark.createDataFrame([(s, (0.8, 1600, 1.0, 0.42, True, False)) for s in sets], f"set_id string, settings {rp.SETTINGS}")


def run(spark, rows, report, measures=None, **kw):
    return passes.run_sets(spark.createDataFrame(rows, LISTING), report, measured(spark, rows) if measures is None else measures, F.lit("k1"), **kw)


def shown(out):
    return {(r.set_id, r.source): (r.final_grade, r.reasons, r.notes, r.decide, r.set_reasons) for r in out.photos.collect()}


def made(rows):
    return [(s, n, at + 1) for s, n, _, at in rows if at != 104]


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names}


def test_a_second_pass_over_what_the_first_saved_is_all_reuse(spark, tmp_path):
    root, rows = f"file://{tmp_path}/r", photos("x", "y")
    first = run(spark, rows, nothing(spark))
    rp.write_reports(first.documents(settings(spark, "x", "y")), root)
    second = run(spark, rows, previous(spark, root, made(rows)))
    assert shown(first) == shown(second) and len(shown(first)) == 12
    assert {r["class"] for r in second.photos.collect()} == {"reuse"}
    grades = {n: g for (s, n), (g, *_) in shown(second).items() if s == "x"}
    assert grades == {"IMG_0.jpg": "PASS", "IMG_1.jpg": "REVIEW", "IMG_2.jpg": "REVIEW", "IMG_3.jpg": "REVIEW", "IMG_4.jpg": "SKIPPED", "IMG_5.jpg": "PASS"}
    assert shown(second)["x", "IMG_1.jpg"][3].note == "close to the line: eye sharpness 0.62"
    assert shown(second)["x", "IMG_4.jpg"][1] == ["no face found"] and shown(second)["x", "IMG_0.jpg"][2] == ["framed"]
    lines = [json.loads(r.value) for r in second.events.collect() if r.set_id == "x"]
    kinds = [e["event"] for e in lines]
    assert (kinds.count("start"), kinds.count("photo"), kinds.count("polished")) == (1, 6, 1)
    start, end = (next(e for e in lines if e["event"] == k) for k in ("start", "polished"))
    assert (start["total"], start["unchanged"], end["processed"], end["unchanged"]) == (6, 6, 0, 6)
    assert end["counts"] == {"PASS": 2, "REVIEW": 3, "FAIL": 0, "SKIPPED": 1}
    for kind in ("start", "photo", "polished"):
        assert rp.read_events(second.events, kind).count() == 2 * kinds.count(kind)


def test_a_pass_over_one_set_leaves_all_others(spark, tmp_path):
    root, rows = f"file://{tmp_path}/r", photos("x", "y", "z")
    rp.write_reports(run(spark, rows, nothing(spark)).documents(settings(spark, "x", "y", "z")), root)
    before = tree(tmp_path)
    only = [(s, n, size, at) for s, n, size, at in photos("y") if n != "IMG_5.jpg"]
    again = run(spark, only, previous(spark, root, made(rows)), force=True)
    rp.write_reports(again.documents(settings(spark, "y")), root)
    after = tree(tmp_path)
    assert all(after[f] == b for f, b in before.items())
    got = {r.set_id: len(r.photos) for r in rp.stored_reports(spark, root).collect()}
    assert got == {"x": 6, "y": 5, "z": 6}


def test_a_killed_write_was_never_there(spark, tmp_path, monkeypatch):
    root, rows = f"file://{tmp_path}/r", photos("x")
    rp.write_reports(run(spark, rows, nothing(spark)).documents(settings(spark, "x")), root)
    before = rp.stored_reports(spark, root).collect()
    mark = store.mark
    with monkeypatch.context() as m:
        m.setattr(store, "mark", lambda s, path: (_ for _ in ()).throw(KeyboardInterrupt()) if "/commits/" in path else mark(s, path))
        with pytest.raises(KeyboardInterrupt):
            rp.write_reports(run(spark, rows[:2], nothing(spark)).documents(settings(spark, "x")), root)
    assert rp.stored_reports(spark, root).collect() == before and store.generations(spark, root) == [1]
    rp.write_reports(run(spark, rows[:2], nothing(spark)).documents(settings(spark, "x")), root)
    assert store.generations(spark, root) == [1, 3] and len(rp.stored_reports(spark, root).first().photos) == 2
    assert store.vacuum(spark, root) == [1] and len(rp.stored_reports(spark, root).first().photos) == 2


def test_an_emptied_set_is_empty_and_an_empty_store_has_no_rows(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    assert store.load(spark, root, "json", "a long").count() == 0
    rows = spark.createDataFrame([("s=1/ü", 1), ("t", 2), (None, 3)], "set_id string, a long")
    store.save(rows, root, "json")
    assert sorted(store.load(spark, root, "json", "a long").collect(), key=str) == sorted(rows.collect(), key=str)
    store.save(rows.limit(0), root, "json", sets=spark.createDataFrame([("t",)], "set_id string"))
    assert sorted(r.a for r in store.load(spark, root, "json", "a long").collect()) == [1, 3]
    for k, part in enumerate((rows, rows.filter("a > 1").withColumn("a", F.col("a") * 10))):
        assert store.save(part, root + "/flat", "parquet", folders=False) == k + 1
    assert sorted(((r.set_id, r.a) for r in store.load(spark, root + "/flat", "parquet", "a long", folders=False).collect()), key=str) == [("s=1/ü", 1), ("t", 20), (None, 30)]


def test_edited_photos_keep_their_entry(spark, tmp_path):
    root, rows = f"file://{tmp_path}/r", photos("x")
    rp.write_reports(run(spark, rows, nothing(spark)).documents(settings(spark, "x")), root)
    touched = [(s, n, at + (5 if n in ("IMG_0.jpg", "IMG_5.jpg") else 0)) for s, n, at in made(rows)]
    worse = measured(spark, rows, lambda r: r[:4] + (0.2, 1.0, 9.0) + r[7:] if r[1] == "IMG_0.jpg" else None if r[1] == "IMG_5.jpg" else r)
    out = run(spark, rows, previous(spark, root, touched), worse)
    got = {r.source: r for r in out.photos.collect()}
    mine = got["IMG_0.jpg"]
    assert (mine["class"], mine.final_grade, mine.reasons, mine.notes, mine.out_mtime_ns) == ("hand_edited", "REVIEW", ["eyes look soft (focus miss or motion?)"], ["framed", "edited by hand; kept your version"], 106)
    left = got["IMG_5.jpg"]
    assert (left["class"], left.final_grade, left.out_mtime_ns) == ("hand_edited", "PASS", 106)
    rp.write_reports(out.documents(settings(spark, "x")), root)
    third = {r.source: r for r in run(spark, rows, previous(spark, root, touched), worse).photos.collect()}
    assert third["IMG_0.jpg"]["class"] == "reuse" and third["IMG_0.jpg"].hand_edited and third["IMG_0.jpg"].notes == mine.notes
    assert third["IMG_5.jpg"]["class"] == "hand_edited"


def test_photos_without_measures_are_skipped_and_sidecar_notes_stay(spark):
    rows = photos("x") + [("x", "IMG_E7.jpg", 1, 1)]
    notes = spark.createDataFrame([("x", "IMG_1", ["crop"])], "set_id string, stem string, edits array<string>")
    out = run(spark, rows, nothing(spark), measured(spark, photos("x")), sidecars=notes)
    got = {r.source: r for r in out.photos.collect()}
    assert (got["IMG_E7.jpg"].final_grade, got["IMG_E7.jpg"].reasons, got["IMG_E7.jpg"].decide) == ("SKIPPED", [passes.NO_MEASURES], None)
    assert got["IMG_1.jpg"].notes == ["exported without its Photos edits (crop); export the edited version to keep them"]
    summary = out.summary.first()
    assert (summary.processed, summary.n_skipped) == (7, 2)


def test_remote_looks_are_taken_again_on_an_equal_basis(spark, tmp_path):
    root, rows = f"file://{tmp_path}/r", photos("x")
    scored = measured(spark, rows).withColumn("look", F.lit(0.2))
    first = run(spark, rows, nothing(spark), scored, look="look", by="jev")
    assert {r.decide.by for r in first.photos.collect() if r.output} == {"jev"}
    rp.write_reports(first.documents(settings(spark, "x")), root)
    second = run(spark, rows, previous(spark, root, made(rows)), scored.withColumn("look", F.lit(None).cast("double")), look="look", by="jev")
    assert shown(first) == shown(second)


def test_other_outputs_are_stored_by_set_too(spark, tmp_path):
    members = spark.createDataFrame([("x", "S01", "b.jpg", "B", "1/2", 0.9, "PASS", True), ("x", "S01", "c.jpg", "", "2/2", 0.8, "", False), ("y", "S01", "d.jpg", "D", "1/1", 1.0, "FAIL", True)], "set_id string, student string, name string, source string, frame_of string, fit double, grade string, pick boolean")
    root = f"file://{tmp_path}/c"
    rp.write_students(members, root)
    rp.write_students(members.filter("set_id = 'y'").withColumn("grade", F.lit("REVIEW")), root)
    got = {(r.set_id, r.photo): (r.grade, r.pick, r.fit_to_group) for r in rp.stored_students(spark, root).collect()}
    assert got == {("x", "b.jpg"): ("PASS", "pick", 0.9), ("x", "c.jpg"): ("", "", 0.8), ("y", "d.jpg"): ("REVIEW", "pick", 1.0)}
    lines = spark.createDataFrame([("x", 1, 2.0, "last"), ("x", 0, 1.0, "first"), ("y", 0, 0.0, "other")], "set_id string, section int, ordinal double, line string")
    rp.write_summary(lines, f"file://{tmp_path}/t")
    assert {r.set_id: r.value for r in rp.stored_summary(spark, f"file://{tmp_path}/t").collect()} == {"x": "first\nlast\n", "y": "other\n"}


def test_reports_by_set_come_back_under_their_set(spark, tmp_path):
    (tmp_path / "set_id=y").mkdir()
    (tmp_path / "set_id=y" / "part.json").write_text(json.dumps({"photos": [{"source": "a"}]}))
    assert [r.set_id for r in rp.read_reports(spark, f"file://{tmp_path}/set_id=y/part.json").collect()] == ["y"]


def test_long_numbers_and_dots_in_paths(spark):
    col = lambda values, f: [r.v for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("v")).collect()]
    long = ["1" * 20, "2" * 38, "3" * 45, "0" * 50 + "7", "none"]
    assert [int(v) for v in col([f"IMG_{n}.jpg" for n in long], paths.shot_number)] == [int("1" * 20), int("2" * 38), int("9" * 38), 7, 0]
    given = ["/a/./b", "./a", "a/./", "//a//b", "///a", "/", "//", ".", "./.", "a/../b", ""]
    assert col(given, paths.normal_path) == ["/a/b", "a", "a", "//a/b", "/a", "/", "//", ".", ".", "a/../b", "."]


def test_a_last_generation_of_its_own_sets_is_read_without_a_lookup(spark, tmp_path):
    root = str(tmp_path / "r")
    rows = lambda *pairs: spark.createDataFrame(pairs, "set_id string, a long")
    read = lambda: store.load(spark, root, "parquet", "a long", folders=False)
    plan = lambda: read()._jdf.queryExecution().optimizedPlan().toString()
    store.save(rows(("s", 1), ("t", 2), (None, 3)), root, "parquet", folders=False)
    assert "Join" not in plan() and sorted(map(tuple, read().collect()), key=str) == [("s", 1), ("t", 2), (None, 3)]
    store.save(rows(("t", 20), (None, 30)), root, "parquet", folders=False)
    assert sorted(map(tuple, read().collect()), key=str) == [("s", 1), ("t", 20), (None, 30)]
    store.save(rows(("u", 9), ("s", 5)), root, "parquet", spark.createDataFrame([("u",)], "set_id string"), folders=False)  # s was not covered
    assert "Join" in plan() and sorted(map(tuple, read().collect()), key=str) == [("s", 1), ("t", 20), ("u", 9), (None, 30)]


def test_reports_without_folders_are_packed_and_passes_leave_little(spark, tmp_path):
    kept = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    seen = lambda: {os.path.join(d, n) for d, _, names in os.walk(kept) for n in names}
    before = seen()
    rows = photos("a", "b")
    with session.scratch(spark):
        with session.scratch(spark):
            first = run(spark, rows, nothing(spark), measured(spark, rows))
            documents = session.stored_once(first.documents(settings(spark, "a", "b")), keep=True)
            assert len(seen()) > len(before)
        assert documents.count() == 2
        rp.write_reports(documents, str(tmp_path / "flat"), folders=False)
    assert seen() == before
    files = [n for _, _, names in os.walk(tmp_path / "flat" / "rows") for n in names if n.startswith("part-")]
    assert files and all(n.endswith(".json.gz") for n in files)
    assert rp.report_index(rp.stored_reports(spark, str(tmp_path / "flat"), folders=False)).count() == 12
