"""What the training-data operators share: table access, shared storage and blocks of rows."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_CLEANING: dict[str, list] = {}  # session: [writes under way, the setting before them]
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], name: str) -> str:
    """A column name like `name` that the given ones do not have (Spark compares without case)."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_key(text: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits of a text that know nothing of each other (Spark seeds each argument's hash with the one
    before, so the constant comes first)."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session. Only a local session
    may go without: a temporary folder is made and set then."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-proofset-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/proofset/{label}-{uuid.uuid4().hex}"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While any write of this session is under way, Spark removes shuffle files as soon as their query ends."""
    name = str(id(spark))
    with _LOCK:
        own = _CLEANING.setdefault(name, [0, None])
        if own[0] == 0:
            own[1] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        own[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            own[0] -= 1
            if own[0] == 0:
                spark.conf.set(CLEANUP, own[1])


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs
    nothing that was written. Returns the path too."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """stored(), for what an operator needs on its way. The files stay until the surrounding scratch() ends, or
    where there is none until the cluster clears the folder, because the returned frame reads them lazily."""
    out, path = stored(df, label)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete what stored() wrote, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What written() stores inside is deleted at the end: results must have been stored before."""
    held: list[str] = []
    mark = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(mark)
        for path in held:
            remove(spark, path)


def text_bytes(df: DataFrame, col: str = "text") -> tuple[int, int]:
    """Rows, and UTF-8 bytes of a column, from one narrow pass over it."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(col)))).first()
    return rows, int(size or 0)


def block_count(size: int, per_block: int) -> int:
    return max(1, math.ceil(size / per_block))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def utf8(col: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string or binary column as Python bytes (None stays None)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], col: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: about most_bytes of a string column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


import pyarrow.compute  # noqa: E402, F401  (slices() uses pa.compute)
