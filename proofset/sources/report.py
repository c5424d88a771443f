"""Listings, saved reports, event logs and the files that are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofset.functions.paths import PHOTO_EXTENSIONS, extension_of
from proofset.sources import store

DECIDE = "struct<by:string,grade:string,confidence:double,note:string,basis:string,requested:string>"
METRICS = "struct<size:array<long>,srgb:boolean,metadata_tags:long,face:long,eye_line:double,headroom:double,center:double,head_size:double,planned_head_size:double,other_faces:long,face_blown:double,skin_hue:double,skin_chroma:double,eye_sharpness:double,backdrop_luma:double,fidelity_ssim:double,clipping_added:double,crushing_added:double,face_lightness_change:double,sharpen_gain:double,upscale:double>"
PHOTO = f"struct<source:string,size:long,mtime_ns:long,key:string,output:string,out_mtime_ns:long,grade:string,reasons:array<string>,notes:array<string>,metrics:{METRICS},src_wh:array<long>,face_box:array<long>,box:array<double>,planned_head:double,hand_edited:boolean,set_reasons:array<string>,decide:{DECIDE}>"
SETTINGS = "struct<ratio:double,width:int,zoom:double,eye_line:double,finish:boolean,bw:boolean>"
REPORT = f"settings {SETTINGS}, set_note string, photos array<{PHOTO}>"
STUDENTS = "student string, photo string, source string, frame_of string, fit_to_group double, grade string, pick string"


def _fields(struct: str) -> dict[str, str]:
    """Names and types of a struct's own fields."""
    out, depth, start, body = {}, 0, 0, struct.removeprefix("struct<")[:-1] + ","
    for k, c in enumerate(body):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = body[start:k].split(":", 1)
            out[name], start = kind, k + 1
    return out


METRIC_TYPES, PHOTO_TYPES = _fields(METRICS), _fields(PHOTO)

# The kinds of events, their fields, and those that must be there.
EVENTS = {
    "start": ("total long, unchanged long, folder string, out string", ("total", "unchanged")),
    "photo": (f"source string, grade string, reasons array<string>, notes array<string>, output string, confidence double, decide {DECIDE}", ("source", "grade", "reasons", "notes")),
    "polished": ("processed long, unchanged long, counts map<string,long>, flagged long, set_note string, sheet string, pages long, out string", ("processed", "unchanged", "counts", "flagged")),
    "grouped": ("students long, photos long, threshold double, why string, groups array<struct<id:string,photos:array<string>,pick:string>>, report string, csv string", ("students", "photos", "threshold", "why")),
    "log": ("text string", ("text",)),
}


def list_photos(spark: SparkSession, folder: str) -> DataFrame:
    """source, size, mtime_ns of a folder's own photos; contents are never read. The folder is listed by its file
    system, as Spark's readers pass over files whose names begin with an underscore."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    files = [(f.getPath().getName(), f.getLen(), f.getModificationTime() * 1_000_000) for f in found if f.isFile()]
    rows = spark.createDataFrame(files, "source string, size long, mtime_ns long")
    return rows.filter(~F.col("source").startswith(".") & extension_of(F.col("source")).isin(*PHOTO_EXTENSIONS))


def list_outputs(spark: SparkSession, folder: str) -> DataFrame:
    return list_photos(spark, folder).filter(F.col("source").endswith(".jpg") & ~F.col("source").startswith("_"))


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per report document; a broken one has no photos. set_id is the name of the report's folder."""
    rows = spark.read.schema(REPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    folder = F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -2))
    return rows.withColumn("set_id", F.regexp_replace(folder, "^set_id=", ""))


def report_index(reports: DataFrame, by: str = "source") -> DataFrame:
    """Photos of the reports by source or by output; of repeated ones the last, and none without that name."""
    rows = reports.select("set_id", F.posexplode("photos").alias("at", "p")).select("set_id", "at", "p.*").filter(F.col(by).isNotNull())
    last = F.row_number().over(Window.partitionBy("set_id", by).orderBy(F.desc("at")))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n", "at")


def report_documents(photos: DataFrame, settings: DataFrame) -> DataFrame:
    """set_id, settings, set_note, photos (sorted by source). settings: set_id, settings (struct), set_note."""
    cols = [c for c in photos.columns if c != "set_id"]
    first = ["source", *[c for c in cols if c != "source"]]
    docs = photos.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct(*first))).alias("photos"))
    return settings.select("set_id", "settings", "set_note").join(docs, "set_id", "left").withColumn("photos", F.coalesce("photos", F.array().cast(docs.schema["photos"].dataType)))


def flat(entries: DataFrame) -> DataFrame:
    """Report entries (report_index()) with a column for each metric, as the passes take them."""
    out = entries.select("*", *[F.col(f"metrics.{c}").alias(c) for c in METRIC_TYPES if c not in ("size", "planned_head_size")])
    return out.withColumns({"width": F.col("metrics.size")[0], "height": F.col("metrics.size")[1]}).drop("metrics")


def nested(photos: DataFrame) -> DataFrame:
    """Entries of a pass, with a column for each metric, as a report keeps them. Columns that photos lack are null."""
    have = set(photos.columns)
    col = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    named = {"size": F.when(col("width", "long").isNotNull(), F.array(col("width", "long"), col("height", "long"))), "planned_head_size": col("planned_head", "double")}
    metrics = F.struct(*[named.get(c, col(c, kind)).alias(c) for c, kind in METRIC_TYPES.items()])
    return photos.select("set_id", *[(metrics if c == "metrics" else col(c, kind)).alias(c) for c, kind in PHOTO_TYPES.items()])


def write_reports(documents: DataFrame, root: str, sets: DataFrame | None = None, folders: bool = True) -> int:
    """Documents of some sets, as their newest generation; all other sets keep theirs. folders: one for each set;
    without them files are packed by gzip."""
    return store.save(documents, root, "json", sets, folders=folders, **({} if folders else {"deal": False, "compression": "gzip"}))


def stored_reports(spark: SparkSession, root: str, folders: bool = True) -> DataFrame:
    """What write_reports() keeps: set_id, settings, set_note, photos."""
    return store.load(spark, root, "json", REPORT, folders)


def students_table(members: DataFrame) -> DataFrame:
    """Rows of the grouping CSV from members with student, name, source, frame_of, fit, grade, pick."""
    return members.select("set_id", "student", F.col("name").alias("photo"), F.coalesce("source", F.lit("")).alias("source"), "frame_of", F.col("fit").alias("fit_to_group"), F.coalesce("grade", F.lit("")).alias("grade"), F.when(F.col("pick"), "pick").otherwise("").alias("pick"))


def write_students(members: DataFrame, root: str, sets: DataFrame | None = None) -> int:
    return store.save(students_table(members), root, "csv", sets, ("student", "frame_of"), header=True)


def stored_students(spark: SparkSession, root: str) -> DataFrame:
    rows = store.load(spark, root, "csv", STUDENTS, header=True)
    return rows.fillna("", ["source", "grade", "pick"])


def summary_lines(totals: DataFrame, cut: DataFrame, changes: DataFrame, apart: DataFrame, sizes: DataFrame, closest: DataFrame, picked: DataFrame, broken: DataFrame | None = None, weakest: DataFrame | None = None, lonely: DataFrame | None = None, weak: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """set_id, section, ordinal, line: the text summary in order. Optional parts: broken_runs(), weakest_groups() with
    the names of its pair (first_name, second_name), loneliest(), and intake()'s weak and skipped rows."""
    row = lambda df, section, ordinal, line: df.select("set_id", F.lit(section).alias("section"), ordinal.cast("double").alias("ordinal"), line.alias("line"))
    head = totals.join(cut, "set_id")
    parts = [
        row(head, 0, F.lit(0), F.format_string("%d students across %d photos", "students", "photos")),
        row(head, 0, F.lit(1), F.concat(F.format_string("grouped at cosine %.2f (", "cut"), F.col("why"), F.lit(")"))),
        row(changes, 1, F.col("cut"), F.concat(F.format_string("    %.2f -> %3d students", "cut", "students"), F.when(F.col("marked"), "   <- SFace's published same-person threshold").otherwise(""))),
        row(apart, 2, F.lit(0), F.format_string("    within a group, the weakest pair:   %.3f  (median %.3f)", "weakest", "weakest_median")),
        row(apart, 2, F.lit(1), F.format_string("    between groups, the closest pair:   %.3f  (median %.3f over %d pairs)", "closest", "closest_median", "n_pairs")),
        row(apart, 2, F.lit(2), F.concat(F.format_string("    gap between those two: %+.3f  - ", "gap"), F.col("verdict"))),
        row(sizes, 3, F.col("shots"), F.concat(F.format_string("    %3d students with %d shot", "students", "shots"), F.when(F.col("shots") != 1, "s").otherwise(""))),
        row(closest, 4, F.col("place"), F.format_string("    S%02d + S%02d  %.3f", "a", "b", "sim")),
        row(picked.filter("pick"), 5, F.col("group_no"), F.format_string("    S%02d  %s  %s", "group_no", "name", "grade")),
    ]
    place = lambda df: df.withColumn("_place", F.row_number().over(Window.partitionBy("set_id").orderBy("name")))
    if broken is not None:
        parts.append(row(broken, 6, F.col("group_no"), F.format_string("    S%02d  %s..%s without %s", "group_no", "first_name", "last_name", "skipping")))
    if weakest is not None:
        parts.append(row(weakest, 7, F.col("place"), F.format_string("    S%02d  %.3f  %s + %s", "group_no", "sim", "first_name", "second_name")))
    if lonely is not None:
        parts.append(row(lonely, 8, F.col("place"), F.concat(F.format_string("    %s  S%02d  best other ", "name", "group_no"), F.coalesce(F.format_string("%.3f", "best_other"), F.lit("none")))))
    if weak is not None:
        parts.append(row(place(weak), 9, F.col("_place"), F.format_string("    %s  face found only at %.1f", "name", "detect_threshold")))
    if skipped is not None:
        parts.append(row(place(skipped), 10, F.col("_place"), F.format_string("    %s  %s", "name", "reason")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_summary(lines: DataFrame, root: str, sets: DataFrame | None = None) -> int:
    rows = lines.select("set_id", F.col("section").alias("_section"), F.col("ordinal").alias("_ordinal"), F.col("line").alias("value"))
    return store.save(rows, root, "text", sets, ("_section", "_ordinal"))


def stored_summary(spark: SparkSession, root: str) -> DataFrame:
    """set_id, value: each set's whole text."""
    return store.load(spark, root, "text", "value string", wholetext=True)


def event_line(kind: str, *fields: Column) -> Column:
    """One JSON object, tagged by kind."""
    return F.to_json(F.struct(F.lit(kind).alias("event"), *fields))


def write_events(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def read_events(lines: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """The events of one kind from lines of JSON (static or streaming); other kinds, broken lines and events
    without a required field are dropped. Other columns of the lines are kept."""
    schema, required = EVENTS[kind]
    tag = F.get_json_object(F.col(value), "$.event")
    rest = [c for c in lines.columns if c != value]
    rows = lines.filter(tag == kind).select(*rest, F.from_json(value, schema).alias("_e")).select(*rest, "_e.*")
    for name in required:
        rows = rows.filter(F.col(name).isNotNull())
    return rows


def why_text(reasons: Column, notes: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(reasons, none), F.coalesce(notes, none)), "; ")


def gallery_rows(events: DataFrame, entries: DataFrame, outputs: DataFrame) -> DataFrame:
    """set_id, source, grade, why per set from the first that has any: event log, report entries, outputs as PASS."""
    log = events.select("set_id", "source", "grade", why_text(F.col("reasons"), F.col("notes")).alias("why"))
    saved = entries.select("set_id", "source", "grade", why_text(F.col("reasons"), F.col("notes")).alias("why")).join(events.select("set_id").distinct(), "set_id", "left_anti")
    bare = outputs.select("set_id", "source", F.lit("PASS").alias("grade"), F.lit("Already polished.").alias("why"))
    bare = bare.join(events.select("set_id").unionByName(entries.select("set_id")).distinct(), "set_id", "left_anti")
    return log.unionByName(saved).unionByName(bare)
