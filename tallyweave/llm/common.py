"""What the corpus operators share: the shared work folder, files in it, and code shipped to executors."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


#: Rows in an Arrow batch: rows hold whole texts, so the default of 10,000 would take tens of MB in each of several copies.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, and keeps Arrow batches small."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp()) / "tallyweave_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def lean(run):
    """A function over Arrow batches that gives unused memory back once a partition is done; idle workers stay small."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def _hadoop(spark: SparkSession, path: str):
    """(file system, qualified path) as Spark's own readers see a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(where)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, with its scheme; one of our own only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return _hadoop(spark, named)[1].toString().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a work folder through Spark's file system layer."""
    system, where = _hadoop(spark, path)
    system.delete(where, True)


class Scratch:
    """Work tables that end with the block they serve; what outlives it is written outside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, work_path(spark, "scratch"), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works in the driver and in Python workers."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_json(uri: str, value) -> None:
    where, path = filesystem(uri)
    with where.open_output_stream(path) as out:
        out.write(json.dumps(value).encode())


def read_json(uri: str):
    where, path = filesystem(uri)
    with where.open_input_stream(path) as source:
        return json.loads(source.read())


def array_file(uri: str, dtype):
    """A flat file of integers: memory-mapped where the folder is mounted, else read whole."""
    import numpy as np

    where, path = filesystem(uri)
    if where.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with where.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A vocabulary file of the installed public tokenizers, or the same name in a given folder."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
