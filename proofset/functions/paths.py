"""Names and paths of photos, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions. Polishing takes the first list, in order of preference; intake also takes .webp.
PHOTO_EXTENSIONS = (".heic", ".heif", ".jpg", ".jpeg", ".png", ".tif", ".tiff")
INTAKE_EXTENSIONS = (*PHOTO_EXTENSIONS, ".webp")


def file_name(path: Column) -> Column:
    """Last component; a backslash counts as a slash, slashes at the end do not count."""
    return F.substring_index(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/", -1)


def extension_of(path: Column) -> Column:
    """Lower-case suffix with its dot; '' for names without one and for dot-files."""
    return F.lower(F.regexp_extract(file_name(path), r"^.*[^.](\.[^.]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension_of(path).isin(*INTAKE_EXTENSIONS)


def parent_of(path: Column) -> Column:
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")
    parent = F.regexp_extract(clean, r"(?s)^(.*)/", 1)
    return F.when(~clean.contains("/"), ".").when(parent == "", "/").otherwise(parent)


def normal_path(path: Column) -> Column:
    """Repeated and trailing separators and components that are a dot go, but two slashes at the very beginning stay;
    a path of backslashes alone keeps them. Nothing left is a dot."""
    root = F.when(path.rlike("^//([^/]|$)"), "//").when(path.startswith("/"), "/").otherwise("")
    parts = F.array_join(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), "/")
    slashes = F.concat(root, parts)
    back = F.regexp_replace(F.regexp_replace(path, r"(?<=.)\\+", r"\\"), r"(?<=[^:])\\$", "")
    return F.when(path.contains("\\") & ~path.contains("/"), back).when(slashes == "", ".").otherwise(slashes)


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def shot_number(name: Column) -> Column:
    """Capture order: the first run of digits in the stem, else 0. Numbers of more than 38 digits, besides zeros before
    them, count as the largest of 38."""
    digits = F.regexp_replace(F.regexp_extract(stem_of(name), r"(\d+)", 1), "^0+", "")
    number = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)"))
    return F.when(digits == "", F.lit("0").cast("decimal(38,0)")).otherwise(number)


def edited_stem(stem: Column) -> Column:
    """IMG_1234 becomes IMG_E1234, the name of its edited export; NULL for other names."""
    return F.when(stem.rlike(r"^[A-Z]+_\d+$"), F.regexp_replace(stem, r"_(\d+)$", "_E$1"))
