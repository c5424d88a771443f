"""Many folders listed in tasks, and folders that settle."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from proofset.sources import listing
from proofset.sources import report as rp
from proofset.streaming import settle


def fill(root, sets=1000):
    for k in range(sets):
        (root / f"set {k}").mkdir()
        for n in ("a.jpg", "_b.PNG", ".c.jpg", "d.txt", "%41.jpg")[: 1 + k % 5]:
            (root / f"set {k}" / n).write_bytes(b"x" * (k % 7))


def want(sets=1000):
    shown = [n for n in ("a.jpg", "_b.PNG", ".c.jpg", "d.txt", "%41.jpg")]
    return sorted((f"set {k}", n, k % 7) for k in range(sets) for n in shown[: 1 + k % 5] if n not in (".c.jpg", "d.txt"))


def test_a_thousand_folders_in_one_plan(spark, tmp_path):
    fill(tmp_path)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "set 3" / "deeper.jpg").mkdir()
    folders = spark.createDataFrame([(f"set {k}", f"{tmp_path}/set {k}", 1) for k in range(1000)] + [("gone", f"{tmp_path}/gone", 1), ("none", None, 1)], "set_id string, folder string, size int")
    rows = listing.list_sets(folders, 8)
    assert sorted((r.set_id, r.source, r.size) for r in rows.collect()) == want()
    listing.register(spark)
    for uri in (str(tmp_path), f"file://{tmp_path}"):
        source = spark.read.format("photo_folders").option("folders_per_task", 100).load(uri)
        assert source.rdd.getNumPartitions() == 10
        assert sorted((r.set_id, r.source, r.size) for r in source.collect()) == want()
    one = {tuple(r) for r in rows.filter("set_id = 'set 4'").select("source", "size").collect()}
    assert one == {tuple(r) for r in rp.list_photos(spark, f"{tmp_path}/set 4").select("source", "size").collect()}


def test_empty_and_missing_roots(spark, tmp_path):
    listing.register(spark)
    (tmp_path / "bare").mkdir()
    for root in ("bare", "missing"):
        assert spark.read.format("photo_folders").load(f"{tmp_path}/{root}").collect() == []
    assert listing.list_sets(spark.createDataFrame([], "set_id string, folder string")).collect() == []


def by_hand(rows):
    """The watcher's rule, one set at a time."""
    out, state = [], {}
    for name, taken, files, digest in sorted(rows, key=lambda r: r[1]):
        if digest is None:
            continue
        last, ran = state.get(name, (None, None))
        if digest == last != ran:
            out.append((name, taken, files, digest))
            ran = digest
        state[name] = (digest, ran)
    return sorted(out, key=repr)


SHOTS = [(name, 10 * k + at, k % 3, digest) for at, name in enumerate(("s", "t", None)) for k, digest in enumerate(random.Random(at).choices(["x", "y", None], [5, 4, 1], k=30))]


@pytest.mark.parametrize("cuts", [(1, 2, 3, 40), (45,), tuple(range(5, 90, 5))])
def test_settled_on_a_stream_equals_the_batch_form(spark, tmp_path, cuts):
    rows = sorted(SHOTS, key=lambda r: r[1])
    (tmp_path / "log").mkdir()
    for k, (a, b) in enumerate(zip((0, *cuts), (*cuts, len(rows)))):
        at = tmp_path / "log" / f"{k:02d}.json"
        at.write_text("\n".join(json.dumps(dict(zip(("set_id", "taken", "files", "digest"), r))) for r in rows[a:b]))
        os.utime(at, (1000 + k, 1000 + k))
    schema = "set_id string, taken long, files long, digest string"
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
    q = settle.settled(stream).writeStream.foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    static = sorted((tuple(r) for r in settle.settled(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert sorted(got, key=repr) == static == by_hand(rows) and len(static) > 10


def test_watched_folders_run_when_they_settle(spark, tmp_path):
    """One look for each step; a run that dies is run again; a late file makes its set settle anew."""
    root = tmp_path / "in"
    for name in ("s", "t"):
        (root / name).mkdir(parents=True)
        (root / name / "a.jpg").write_bytes(b"1")
    ran, dies = [], [True]

    def run(sets, number):
        found = sorted(r.set_id for r in sets.collect())
        photos = listing.list_sets(sets.withColumn("folder", F.concat(F.lit(f"{root}/"), "set_id")), 2).count()
        if dies.pop() if dies else False:
            raise RuntimeError("killed")
        ran.append((found, photos))

    def look():
        settle.watch_folders(spark, str(root), run, str(tmp_path / "c"), availableNow=True).awaitTermination()

    look()
    assert ran == []
    (root / "t" / "b.jpg").write_bytes(b"1")  # still copying
    with pytest.raises(Exception, match="killed"):
        look()
    look()
    assert ran[0] == (["s"], 1)
    look()
    assert ran[1:] == [(["t"], 2)]
    look()
    (root / "s" / "a.jpg").unlink()
    (root / "new").mkdir()
    look()
    look()
    assert ran[2:] == [(["new", "s"], 0)]
    look()
    assert len(ran) == 3
