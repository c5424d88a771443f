"""Listings of a great many folders, made in tasks: nothing is listed, and no name is held, on the driver.

The file systems are those that pyarrow opens by uri (local paths, hdfs, s3, gs). Names that begin with an underscore
are kept, unlike in Spark's file sources; contents are never read. A folder that is missing, or goes while it is read,
has no photos."""

from __future__ import annotations

import time
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from proofset.functions.paths import PHOTO_EXTENSIONS

FILES = "set_id string, source string, size long, mtime_ns long"
SNAPSHOTS = "set_id string, taken long, files long, digest string"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, named as Spark names paths: as it is, nothing in it percent-encoded."""
    scheme, mark, rest = folder.partition("://") if "://" in folder else folder.partition(":") if folder.startswith("file:/") else ("", "", folder)
    if not mark:
        return fs.LocalFileSystem(), folder
    host, slash, path = rest.partition("/")
    return fs.FileSystem.from_uri(f"{scheme}://{host}{slash}{quote(path)}")


def _is_photo(name: str) -> bool:
    stem, dot, end = name.rpartition(".")
    return bool(stem) and not name.startswith(".") and dot + end.lower() in PHOTO_EXTENSIONS


def photos_of(folder: str) -> list[tuple[str, int, int]]:
    """(name, size, mtime_ns) of a folder's own photos, by name."""
    files, path = opened(folder)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if files.get_file_info(path).type == fs.FileType.Directory else []
    return sorted((f.base_name, f.size, f.mtime_ns) for f in found if f.type == fs.FileType.File and _is_photo(f.base_name))


def folders_of(root: str) -> list[str]:
    """Folders in a folder, but hidden ones, by name: the sets of a data source."""
    files, path = opened(root)
    if files.get_file_info(path).type != fs.FileType.Directory:
        return []
    found = files.get_file_info(fs.FileSelector(path))
    return [f"{root.rstrip('/')}/{n}" for n in sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith("."))]


def digest_of(photos: list[tuple[str, int, int]]) -> str:
    """A name for a listing that changes with any name, size or time in it."""
    h = blake2b(digest_size=16)
    for photo in photos:
        h.update(repr(photo).encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def list_sets(folders: DataFrame, tasks: int | None = None) -> DataFrame:
    """set_id, source, size, mtime_ns of the photos in folders (set_id, folder): the folders are dealt to tasks, which
    list them. A set may have several folders; a null folder has no photos; other columns are ignored. A folder's
    names are held by one task, 65,536 of them to a batch."""
    tasks = tasks or folders.sparkSession.sparkContext.defaultParallelism * 4
    dealt = folders.select(F.col("set_id").cast("string").alias("set_id"), F.col("folder").cast("string").alias("folder")).repartition(tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = photos_of(row["folder"]) if row["folder"] is not None else []
                for at in range(0, len(found), 65536):
                    names, sizes, times = zip(*found[at : at + 65536])
                    sets = pa.array([row["set_id"]] * len(names), pa.string())
                    yield pa.record_batch([sets, pa.array(names), pa.array(sizes, pa.int64()), pa.array(times, pa.int64())], names=["set_id", "source", "size", "mtime_ns"])

    return dealt.mapInArrow(read, FILES)


class _Some(InputPartition):
    """Folders that one task lists."""

    def __init__(self, folders: list[str]):
        self.folders = folders


def _dealt(options: dict) -> list[_Some]:
    folders, each = folders_of(options["path"]), int(options.get("folders_per_task", "16"))
    return [_Some(folders[at : at + each]) for at in range(0, len(folders), each)]


def _set_of(folder: str) -> str:
    return folder.rstrip("/").rpartition("/")[2]


class _Files(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Some]:
        return _dealt(self.options) or [_Some([])]

    def read(self, part: _Some) -> Iterator[tuple]:
        for folder in part.folders:
            for photo in photos_of(folder):
                yield (_set_of(folder), *photo)


class PhotoFolders(DataSource):
    """spark.read.format("photo_folders").load(root): the photos of every folder in a root, each folder a set by its
    name. folders_per_task says how many folders a partition lists (16)."""

    @classmethod
    def name(cls) -> str:
        return "photo_folders"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> _Files:
        return _Files(self.options)


class _Snapshots(DataSourceStreamReader):
    """Every batch looks at every folder once. What was seen cannot be seen again: a batch that is repeated looks anew,
    which settled() allows, as it only compares what it was shown."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"taken": 0}

    def latestOffset(self) -> dict:
        return {"taken": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[_Some]:
        parts = _dealt(self.options) or [_Some([])]
        for p in parts:
            p.taken = end["taken"]
        return parts

    def read(self, part: _Some) -> Iterator[tuple]:
        for folder in part.folders:
            photos = photos_of(folder)
            yield _set_of(folder), part.taken, len(photos), digest_of(photos)

    def commit(self, end: dict) -> None:
        pass


class FolderSnapshots(DataSource):
    """spark.readStream.format("folder_snapshots").load(root): set_id, taken (microseconds), files and digest of the
    listing of every folder in a root, once for each batch."""

    @classmethod
    def name(cls) -> str:
        return "folder_snapshots"

    def schema(self) -> str:
        return SNAPSHOTS

    def streamReader(self, schema) -> _Snapshots:
        return _Snapshots(self.options)


def register(spark) -> None:
    """Make both sources known to a session."""
    for source in (PhotoFolders, FolderSnapshots):
        spark.dataSource.register(source)
