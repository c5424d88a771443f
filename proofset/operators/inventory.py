"""What a folder holds, what is new, and what was dropped on the app."""

from __future__ import annotations

import json
import plistlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofset.functions.paths import INTAKE_EXTENSIONS, PHOTO_EXTENSIONS, edited_stem, extension_of, is_supported, normal_path, parent_of, stem_of

# Identifiers of sidecar edits and their names.
EDIT_NAMES = {"DepthEffect": "Portrait blur", "PortraitEffect": "Portrait Lighting", "Crop": "crop", "SmartTone": "light", "SmartColor": "color", "Effect": "filter", "WhiteBalance": "white balance", "Retouch": "retouch"}
DEFAULTS = {"ratio": 0.8, "width": 1600, "zoom": 1.0, "eye_line": 0.42, "finish": True, "bw": False}
PRESETS = {"full": 0.85, "close": 1.15, "wide": 0.70}


def pick_sources(listing: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Photos of each set from (set_id, source, ...): no dot-files, one file per stem by preference of extension,
    no original whose edited export is there. sidecars (set_id, stem, edits) adds a note to kept originals."""
    name = F.col("source")
    rank = F.array_position(F.array(*[F.lit(e) for e in PHOTO_EXTENSIONS]), extension_of(name))
    files = listing.filter(~name.startswith(".") & (rank > 0)).withColumns({"_rank": rank, "_stem": F.upper(stem_of(name))})
    best = files.withColumn("_n", F.row_number().over(Window.partitionBy("set_id", "_stem").orderBy("_rank", "source"))).filter("_n = 1").drop("_n", "_rank")
    edited = best.select("set_id", F.col("_stem").alias("_edited"))
    kept = best.withColumn("_edited", edited_stem(F.col("_stem"))).join(edited, ["set_id", "_edited"], "left_anti")
    if sidecars is None:
        return kept.drop("_stem", "_edited")
    notes = sidecars.select("set_id", F.upper("stem").alias("_stem"), F.col("edits").alias("_edits"))
    note = F.concat(F.lit("exported without its Photos edits ("), F.array_join("_edits", ", "), F.lit("); export the edited version to keep them"))
    has = F.col("_edited").isNotNull() & (F.size("_edits") > 0)
    return kept.join(notes, ["set_id", "_stem"], "left").withColumn("notes", F.when(has, F.array(note)).otherwise(F.array().cast("array<string>"))).drop("_stem", "_edited", "_edits")


def classify(sources: DataFrame, report: DataFrame, key: Column, force: bool = False) -> DataFrame:
    """sources plus class: hand_edited, reuse or todo. report: set_id, source, key, size, mtime_ns, output,
    out_mtime_ns, hand_edited; and now_mtime_ns, the output file's time now (NULL: it is not there)."""
    r = report.select("set_id", "source", *[F.col(c).alias(f"r_{c}") for c in ("key", "size", "mtime_ns", "output", "out_mtime_ns", "hand_edited", "now_mtime_ns")])
    there = F.col("r_output").isNotNull() & F.col("r_now_mtime_ns").isNotNull()
    same = F.lit(not force) & (F.col("r_key") == key) & (F.col("r_size") == F.col("size")) & (F.col("r_mtime_ns") == F.col("mtime_ns")) & (F.col("r_output").isNull() | there)
    kind = F.when(there & ~F.col("r_now_mtime_ns").eqNullSafe(F.col("r_out_mtime_ns")), "hand_edited").when(there & F.coalesce("r_hand_edited", F.lit(False)), "reuse").when(F.coalesce(same, F.lit(False)), "reuse").otherwise("todo")
    return sources.join(r, ["set_id", "source"], "left").withColumn("class", kind).drop(*[c for c in r.columns if c.startswith("r_")])


def start_totals(classified: DataFrame) -> DataFrame:
    return classified.groupBy("set_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("class") == "reuse").alias("unchanged"))


def merged_report(reused: DataFrame, fresh: DataFrame) -> DataFrame:
    return reused.unionByName(fresh, allowMissingColumns=True)


def settings_key(settings: Column, version: str = "1") -> Column:
    """12 hex digits of the settings and the code's version; settings is a struct with fields in order of names."""
    return F.substring(F.sha1(F.concat(F.to_json(settings), F.lit(version)).cast("binary")), 1, 12)


def preset_zoom(name: Column) -> Column:
    """The zoom of a named framing; NULL for any other name."""
    out = F.lit(None).cast("double")
    for k, v in PRESETS.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return out


def resolve_settings(flags: DataFrame, saved: DataFrame) -> DataFrame:
    """Per set: a flag, else what is saved, else the default. flags.ratio is text such as 4:5;
    flags.preset, where there is such a column, names a framing that stands in for a zoom that is not given. `origin` says where
    the settings come from and `error` what is wrong with them, if anything."""
    s = saved.select("set_id", *[F.col(c).alias(f"s_{c}") for c in DEFAULTS], F.lit(True).alias("has"))
    if "preset" in flags.columns:
        flags = flags.withColumn("zoom", F.coalesce("zoom", preset_zoom(F.col("preset"))))
    parts = F.split("ratio", ":")
    ratio = F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("double") / F.nullif(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)))
    bad_ratio = F.col("ratio").isNotNull() & ratio.isNull()
    rows = flags.join(s, "set_id", "left").withColumn("_ratio", ratio).withColumn("_bad", bad_ratio)
    out = {c: F.coalesce("_ratio" if c == "ratio" else c, f"s_{c}", F.lit(v)) for c, v in DEFAULTS.items()}
    rows = rows.withColumns({f"n_{c}": v for c, v in out.items()})
    same = F.lit(True)
    for c in DEFAULTS:
        same = same & F.col(f"n_{c}").eqNullSafe(F.col(f"s_{c}"))
    fine = F.col("n_eye_line").between(0.2, 0.6) & F.col("n_zoom").between(0.3, 3) & F.col("n_width").between(200, 8000)
    return rows.select("set_id", *[F.col(f"n_{c}").alias(c) for c in DEFAULTS], F.when(F.col("has").isNull(), "defaults").when(same, "saved").otherwise("new: re-polishing").alias("origin"), F.when(F.col("_bad"), "--ratio looks like 4:5 or 1:1").when(~fine, "--eye-line must be 0.2-0.6, --zoom 0.3-3, --width 200-8000").alias("error"))


def resolve_drop(items: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Per request_id: folder, from_single_image, message for dropped (path, is_dir). requests names those that may
    have no items."""
    path = F.col("path")
    image = ~F.col("is_dir") & is_supported(path)
    other = ~F.col("is_dir") & ~is_supported(path)
    ext = extension_of(path)
    c = items.groupBy("request_id").agg(
        F.count_if("is_dir").alias("folders"), F.count_if(image).alias("images"), F.count_if(other).alias("others"), F.min(F.when(F.col("is_dir"), path)).alias("dir"),
        F.min(F.when(image, parent_of(path))).alias("low"), F.max(F.when(image, parent_of(path))).alias("high"), F.array_sort(F.collect_set(F.when(other, F.when(ext == "", "(none)").otherwise(ext)))).alias("exts"),
    )
    if requests is not None:
        c = requests.select("request_id").distinct().join(c, "request_id", "left").fillna(0, ["folders", "images", "others"])
    none, many = F.lit("Nothing was dropped."), (F.col("images") + F.col("others")) > 0
    message = (
        F.when((F.col("folders") > 0) & many, "Drop a folder, or drop photos — not both at once.")
        .when(F.col("folders") > 1, "Drop one folder at a time.")
        .when(F.col("folders") == 1, None)
        .when((F.col("others") > 0) & (F.col("images") == 0), F.concat(F.lit("That file type isn’t supported ("), F.array_join(F.slice("exts", 1, 4), ", "), F.lit("). Drop a folder, or photos: JPG, JPEG, PNG, HEIC.")))
        .when(F.col("others") > 0, "Some dropped files aren’t photos. Drop only JPG, JPEG, PNG or HEIC — or a folder.")
        .when(F.col("images") == 0, none)
        .when(F.col("low") != F.col("high"), "Those photos are in different folders. Drop one folder, or photos from the same folder.")
    )
    out = c.withColumn("message", message)
    folder = F.when(F.col("message").isNull(), normal_path(F.when(F.col("folders") == 1, F.col("dir")).otherwise(F.col("low"))))
    return out.select("request_id", folder.alias("folder"), (F.col("message").isNull() & (F.col("folders") == 0) & (F.col("images") == 1)).alias("from_single_image"), "message")


def supported_counts(listing: DataFrame) -> DataFrame:
    """Photos per folder as intake counts them: (set_id, source), no hidden files."""
    fine = ~F.col("source").startswith(".") & extension_of(F.col("source")).isin(*INTAKE_EXTENSIONS)
    return listing.groupBy("set_id").agg(F.count_if(fine).alias("photos"))


def adjustments(blob: bytes | None) -> list[dict]:
    """The adjustment list in a sidecar file: a property list with deflated JSON or another property list."""
    body = zlib.decompress(plistlib.loads(blob)["adjustmentData"], -15)
    try:
        doc = json.loads(body)
    except ValueError:
        doc = plistlib.loads(body)
    return [{"identifier": a.get("identifier"), "enabled": bool(a.get("enabled", True))} for a in doc.get("adjustments", [])]


def sidecar_edits(files: DataFrame) -> DataFrame:
    """path and edits (array of names) of sidecar files from the binaryFile source; an unreadable one has
    `unknown edits`."""

    @F.pandas_udf("array<struct<identifier:string,enabled:boolean>>")
    def parsed(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(blob):
            try:
                return adjustments(blob)
            except Exception:  # any broken file
                return None

        for c in contents:
            yield c.map(one)

    return files.select("path", parsed("content").alias("found")).select("path", edit_names(F.col("found")).alias("edits"))


def edit_names(found: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in EDIT_NAMES.items() for x in kv])
    on = F.filter(found, lambda a: F.coalesce(a["enabled"], F.lit(True)))
    return F.when(found.isNull(), F.array(F.lit("unknown edits"))).otherwise(F.transform(on, lambda a: F.coalesce(F.try_element_at(names, a["identifier"]), a["identifier"], F.lit("edit"))))
