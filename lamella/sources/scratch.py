"""Tables in the folder that all executors share, to cut lineage. Paths go through the JVM's file systems, so a classic (not a remote) session is needed."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read, as the session names it.

    On a local master without the setting (tests) a temporary folder is made and kept for the
    session; on a cluster a missing setting is an error, because a machine-local folder would
    not be readable by other executors.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lamella-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed at the end of the ``scratch_scope`` around it or of the driver's JVM."""
    path = f"{shared_folder(spark)}/lamella/{label}-{uuid.uuid4().hex}"
    if getattr(_SCOPES, "paths", None) is not None:
        _SCOPES.paths.append(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


_LOCK = threading.Lock()
_HELD: dict[int, list] = {}  # session -> the setting before, and the sizes now asked for


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While this holds, Python functions get at most so many rows at a time: whole texts are long, and two tasks share an executor's memory.

    The session's setting is the least that any thread asks for; when the last one leaves, it is what it was.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def put(before: str, sizes: list[int]) -> None:
        spark.conf.set(key, str(min([n for n in [int(before), *sizes] if n > 0])) if sizes else before)

    with _LOCK:
        before, sizes = _HELD.setdefault(id(spark), [spark.conf.get(key), []])
        sizes.append(rows)
        put(before, sizes)
    try:
        yield
    finally:
        with _LOCK:
            sizes.remove(rows)
            put(before, sizes)
            if not sizes:
                _HELD.pop(id(spark), None)


_SCOPES = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, on leaving, every path that ``new_path`` gave to this thread meanwhile, but for those of inner scopes, which have gone by then.

    For steps whose result has been written: frames that read a scratch table must not be used after that.
    """
    outer, _SCOPES.paths = getattr(_SCOPES, "paths", None), []
    try:
        yield
    finally:
        for path in _SCOPES.paths:
            delete_path(spark, path)
        _SCOPES.paths = outer


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, with its path.

    This cuts the lineage like ``checkpoint()`` does, but stays columnar and survives the loss
    of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
