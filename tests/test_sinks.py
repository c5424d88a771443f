"""Streams that are stopped, killed and played again."""

import json
import os

import pytest

from proofset.sources import store
from proofset.streaming import sink, watch

SCHEMA = "set_id string, source string, seen_at long, grade string"
EVENTS = [("s", "p", 9, "FAIL"), ("s", "q", 1, "PASS"), ("t", "p", 1, "PASS"), ("s", "p", 3, "PASS"), ("s", "q", 2, "REVIEW"), ("s", "p", 8, "REVIEW"), ("s", "r", 0, "PASS"), ("t", "p", 5, "FAIL")]


def write(folder, events, name):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("set_id", "source", "seen_at", "grade"), e))) for e in events))
    os.utime(folder / name, (1000 + int(name[0]), 1000 + int(name[0])))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def rows(spark, root):
    return sorted(tuple(r[c] for c in ("set_id", "source", "seen_at", "grade")) for r in sink.latest_photos(spark, root, "source string, seen_at long, grade string").collect())


def test_latest_events_survive_kill_and_replay(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    for k in range(3):
        write(tmp_path / "log", EVENTS[3 * k : 3 * k + 3], f"{k}.json")
    work, calls = sink.upsert_latest(root, keep=2), []

    def dies(batch, n):
        """Killed in batch 1: the second time after the rows were committed, but before the batch was marked."""
        calls.append(n)
        with monkeypatch.context() as m:
            if n == 1 and calls.count(1) == 2:
                real = store.mark
                m.setattr(store, "mark", lambda s, path: (_ for _ in ()).throw(RuntimeError("killed")) if "/batches/" in path else real(s, path))
            if n == 1 and calls.count(1) == 1:
                raise RuntimeError("killed")
            work(batch, n)

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            sink.start(stream(spark, tmp_path / "log"), dies, str(tmp_path / "c")).awaitTermination()
    sink.start(stream(spark, tmp_path / "log"), dies, str(tmp_path / "c")).awaitTermination()
    want = sorted(tuple(r) for r in watch.latest(spark.createDataFrame(EVENTS, SCHEMA)).select("set_id", "source", "seen_at", "grade").collect())
    assert rows(spark, root) == want and calls.count(1) == 3
    assert len(store.generations(spark, root)) <= 2
    before = store.generations(spark, root)
    work(spark.createDataFrame(EVENTS[:3], SCHEMA), 0)  # a batch that is marked changes nothing
    assert store.generations(spark, root) == before and rows(spark, root) == want


@pytest.mark.parametrize("cuts", [(3, 5), (1, 7)])
def test_running_numbers_equal_the_batch_form(spark, tmp_path, cuts):
    events = sorted(EVENTS, key=lambda e: (e[2], e[0], e[1]))
    bounds = [0, *cuts, len(events)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        write(tmp_path / "log", events[a:b], f"{k}.json")
    totals = spark.createDataFrame([("s", 6), ("t", 3)], "set_id string, total long")
    root, out = f"file://{tmp_path}/store", f"file://{tmp_path}/out"
    work, calls = sink.running_progress(totals, root, out), []

    def twice(batch, n):
        work(batch, n)
        work(batch, n)
        calls.append(n)

    sink.start(stream(spark, tmp_path / "log"), twice, str(tmp_path / "c")).awaitTermination()
    assert calls == [0, 1, 2]
    cols = ("set_id", "source", "seen_at", "done", "total", "percent")
    got = sorted(tuple(r[c] for c in cols) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r[c] for c in cols) for r in watch.progress(spark.createDataFrame(events, SCHEMA), totals).collect())
    assert got == want and len(got) == 8
