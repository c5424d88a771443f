from pyspark.sql import functions as F

from proofset.functions import paths
from proofset.operators import inventory as inv


def col(spark, values, f):
    return [r.v for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("v")).collect()]


def test_names_and_paths(spark):
    assert [int(v) for v in col(spark, ["IMG_3711.jpg", "IMG_E3711.jpg", "IMG_O3939.HEIC", "DSC_0042", "nodigits"], paths.shot_number)] == [3711, 3711, 3939, 42, 0]
    assert col(spark, ["IMG_4529.JPG", "C:\\Photos\\IMG_4529.JPG", "noext", ".hidden", "a/b.tar.gz"], paths.extension_of) == [".jpg", ".jpg", "", "", ".gz"]
    assert col(spark, ["a.jpg", "/a.jpg", "/x/y/a.jpg", "x\\a.jpg"], paths.parent_of) == [".", "/", "/x/y", "x"]
    assert col(spark, ["/a//b/", "C:\\a\\\\b\\", ""], paths.normal_path) == ["/a/b", "C:\\a\\b", "."]


def test_sources_prefer_extensions_and_edited_exports(spark):
    names = ["IMG_1.HEIC", "img_1.jpg", "IMG_2.JPG", "IMG_E2.jpg", ".IMG_3.jpg", "note.txt", "b.png"]
    files = spark.createDataFrame([("s", n) for n in names], "set_id string, source string")
    notes = spark.createDataFrame([("s", "IMG_1", ["crop"])], "set_id string, stem string, edits array<string>")
    got = {r.source: r.notes for r in inv.pick_sources(files, notes).collect()}
    assert set(got) == {"IMG_1.HEIC", "IMG_E2.jpg", "b.png"}
    assert got["IMG_1.HEIC"] == ["exported without its Photos edits (crop); export the edited version to keep them"]


def test_incremental_classes(spark):
    src = spark.createDataFrame([("s", n, 1, 1) for n in "abcdefg"], "set_id string, source string, size long, mtime_ns long")
    rows = [("a", "k", 1, 1, "o", 5, None, 5), ("b", "k", 1, 1, "o", 5, None, 6), ("c", "x", 9, 9, "o", 5, True, 5), ("d", "x", 1, 1, "o", 5, None, 5), ("e", "k", 1, 1, "o", 5, None, None), ("f", "k", 1, 1, None, None, None, None)]
    rep = spark.createDataFrame([("s", *r) for r in rows], "set_id string, source string, key string, size long, mtime_ns long, output string, out_mtime_ns long, hand_edited boolean, now_mtime_ns long")
    got = {r.source: r["class"] for r in inv.classify(src, rep, F.lit("k")).collect()}
    assert got == {"a": "reuse", "b": "hand_edited", "c": "reuse", "d": "todo", "e": "todo", "f": "reuse", "g": "todo"}
    assert {r.source: r["class"] for r in inv.classify(src, rep, F.lit("k"), force=True).collect()}["a"] == "todo"


def test_intake(spark):
    cases = {"one": [("/p/a.jpg", False)], "dir": [("/p/q/", True)], "three": [(f"/p/{c}.png", False) for c in "abc"], "apart": [("/p/a.jpg", False), ("/q/a.jpg", False)], "mov": [("/p/a.mov", False)], "both": [("/p", True), ("/p/a.jpg", False)], "dirs": [("/p", True), ("/q", True)]}
    items = spark.createDataFrame([(k, *i) for k, v in cases.items() for i in v], "request_id string, path string, is_dir boolean")
    asked = spark.createDataFrame([(k,) for k in [*cases, "none"]], "request_id string")
    got = {r.request_id: r for r in inv.resolve_drop(items, asked).collect()}
    assert (got["one"].folder, got["one"].from_single_image) == ("/p", True)
    assert (got["dir"].folder, got["three"].folder, got["three"].from_single_image) == ("/p/q", "/p", False)
    assert got["mov"].message.startswith("That file type isn’t supported (.mov)")
    assert got["none"].message == "Nothing was dropped." and got["dirs"].message == "Drop one folder at a time."
    assert got["apart"].folder is None and got["both"].folder is None


def test_settings(spark):
    flags = spark.createDataFrame([("a", None, None), ("b", None, 900), ("c", "nonsense", None), ("d", "1:1", 100)], "set_id string, ratio string, width int")
    for c, kind in (("zoom", "double"), ("eye_line", "double"), ("finish", "boolean"), ("bw", "boolean")):
        flags = flags.withColumn(c, F.lit(None).cast(kind))
    saved = spark.createDataFrame([("a", 2 / 3, 1200, 0.85, 0.42, True, False), ("b", 2 / 3, 1200, 0.85, 0.42, True, False)], "set_id string, ratio double, width int, zoom double, eye_line double, finish boolean, bw boolean")
    got = {r.set_id: r for r in inv.resolve_settings(flags, saved).collect()}
    assert (got["a"].width, got["a"].zoom, got["a"].origin) == (1200, 0.85, "saved")
    assert (got["b"].width, got["b"].origin) == (900, "new: re-polishing")
    assert got["c"].error == "--ratio looks like 4:5 or 1:1" and got["d"].error is not None and got["d"].ratio == 1.0


def test_sidecars(spark):
    import json
    import plistlib
    import zlib

    pack = lambda body: plistlib.dumps({"adjustmentData": (lambda c: c.compress(body) + c.flush())(zlib.compressobj(wbits=-15))})
    good = pack(json.dumps({"adjustments": [{"identifier": "Crop"}, {"identifier": "Odd"}, {"enabled": True}, {"identifier": "Effect", "enabled": False}]}).encode())
    files = spark.createDataFrame([("a", good), ("b", b"broken")], "path string, content binary")
    assert {r.path: r.edits for r in inv.sidecar_edits(files).collect()} == {"a": ["crop", "Odd", "edit"], "b": ["unknown edits"]}


def test_named_framings(spark):
    flags = spark.createDataFrame([("a", None, "close"), ("b", 0.9, "wide"), ("c", None, "other"), ("d", None, None)], "set_id string, zoom double, preset string")
    for c, kind in (("ratio", "string"), ("width", "int"), ("eye_line", "double"), ("finish", "boolean"), ("bw", "boolean")):
        flags = flags.withColumn(c, F.lit(None).cast(kind))
    saved = spark.createDataFrame([], "set_id string, ratio double, width int, zoom double, eye_line double, finish boolean, bw boolean")
    assert {r.set_id: r.zoom for r in inv.resolve_settings(flags, saved).collect()} == {"a": 1.15, "b": 0.9, "c": 1.0, "d": 1.0}
