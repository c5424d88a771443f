import json
import os

from pyspark.sql import functions as F

from proofset.sources import report as rp
from proofset.streaming import watch


def test_events_drop_unknown_and_broken_lines(spark):
    lines = ['{"event":"photo","source":"a","grade":"PASS","reasons":[],"notes":[]}', '{"event":"photo","source":"b"}', '{"event":"odd"}', "{broken", '{"event":"start","total":2,"unchanged":2}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.source for r in rp.read_events(df, "photo").collect()] == ["a"]
    assert [(r.total, r.unchanged) for r in rp.read_events(df, "start").collect()] == [(2, 2)]
    made = spark.range(1).select(rp.event_line("log", F.lit("hello").alias("text")).alias("value"))
    assert [r.text for r in rp.read_events(made, "log").collect()] == ["hello"]


def test_report_index_keeps_the_last(spark, tmp_path):
    d = tmp_path / "set1"
    d.mkdir()
    photos = [{"source": "a", "output": "a.jpg", "grade": "FAIL"}, {"source": "a", "output": "a.jpg", "grade": "PASS"}, {"source": "b", "grade": "SKIPPED"}]
    (d / "_r.json").write_text("")
    (d / "report.json").write_text(json.dumps({"settings": {"ratio": 0.8}, "set_note": None, "photos": photos}))
    docs = rp.read_reports(spark, str(d / "report.json"))
    assert {r.source: r.grade for r in rp.report_index(docs).collect()} == {"a": "PASS", "b": "SKIPPED"}
    assert [(r.set_id, r.output) for r in rp.report_index(docs, "output").collect()] == [("set1", "a.jpg")]


def test_listing(spark, tmp_path):
    for n in ("a.jpg", "_sheet.jpg", ".b.jpg", "c.txt", "d.PNG"):
        (tmp_path / n).write_bytes(b"12")
    assert sorted((r.source, r.size) for r in rp.list_photos(spark, str(tmp_path)).collect()) == [("_sheet.jpg", 2), ("a.jpg", 2), ("d.PNG", 2)]
    assert [r.source for r in rp.list_outputs(spark, str(tmp_path)).collect()] == ["a.jpg"]


def test_streamed_progress_equals_the_batch(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"set_id": "s", "source": f"p{i}", "grade": ["PASS", "FAIL"][i % 2], "seen_at": k}) for i in range(4)))
    schema = "set_id string, source string, grade string, seen_at long"
    q = watch.grade_progress(spark.readStream.schema(schema).json(str(src))).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    batch = watch.grade_progress(spark.read.schema(schema).json(str(src))).collect()
    assert spark.table("progress").collect() == batch and batch[0].done == 12


def test_late_events_do_not_replace_newer_ones(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    for k, rows in enumerate([[("p", 9, "FAIL"), ("q", 1, "PASS")], [("p", 3, "PASS"), ("q", 2, "REVIEW")], [("p", 8, "REVIEW"), ("r", 0, "PASS")]]):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"set_id": "s", "source": n, "seen_at": at, "grade": g}) for n, at, g in rows))
        os.utime(src / f"{k}.json", (1000 + k, 1000 + k))
    schema = "set_id string, source string, seen_at long, grade string"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = watch.latest(events).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("latest").collect())
    assert got == [("s", "p", 9, "FAIL"), ("s", "q", 2, "REVIEW"), ("s", "r", 0, "PASS")]
    assert got == sorted(tuple(r) for r in watch.latest(spark.read.schema(schema).json(str(src))).collect())


def test_watch_reports_settled_sets(spark, tmp_path):
    src = tmp_path / "changes"
    src.mkdir()
    for k, (name, at) in enumerate([("a", "2024-01-01T00:00:00Z"), ("a", "2024-01-01T00:00:01Z"), ("b", "2024-01-01T00:10:00Z")]):
        (src / f"{k}.json").write_text(json.dumps({"set_id": name, "seen_at": at}))
    changes = spark.readStream.schema("set_id string, seen_at timestamp").json(str(src))
    seen = []
    q = watch.watch(changes, lambda sets, n: seen.extend(r.set_id for r in sets.collect()), str(tmp_path / "c"), every="2 seconds", late="1 second")
    q.awaitTermination()
    assert seen == ["a"]
