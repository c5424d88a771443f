"""Making the package known to the executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python, unless their search path already has it."""
    here = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _sent or here.parent in known:
        return
    _sent.add(app)
    target = Path(tempfile.mkdtemp(prefix="spark-proofset-")) / f"{here.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session. Only a local session
    may go without; a temporary folder is made and set then."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-proofset-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def computed_once(df: DataFrame) -> DataFrame:
    """df, computed now and once: a checkpoint in the folder that the session names in spark.checkpoint.dir. Only a
    local session may go without; a temporary folder is taken then."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_CLEANING: dict[int, list] = {}  # session: [writes under way, the setting before them]
_SCRATCH: ContextVar[tuple] = ContextVar("rows", default=())  # paths, by scratch()


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """While any write of this session is under way, Spark removes shuffle files as soon as their query ends."""
    with _LOCK:
        own = _CLEANING.setdefault(id(spark), [0, None])
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


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What stored_once() stores inside is deleted at the end: nothing may be read from it later."""
    held: list[str] = []
    mark = _SCRATCH.set((*_SCRATCH.get(), held))
    try:
        yield
    finally:
        _SCRATCH.reset(mark)
        for path in held:
            remove(spark, path)


def stored_once(df: DataFrame, keep: bool = False) -> DataFrame:
    """df, computed now and once, as compressed Parquet in the folder of shared_dir(), where it stays until the
    surrounding scratch() ends (with keep: the one around that), or where there is none until the cluster clears the folder. Much
    smaller than a checkpoint, and what Spark inferred of the values on the way does not pile up in loops."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/proofset/rows-{uuid.uuid4().hex}"
    if held := _SCRATCH.get()[:-1] if keep else _SCRATCH.get():
        held[-1].append(path)
    with cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
