"""Helpers that all operators of this folder share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch may hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the Python worker gives memory back that it keeps
    for later: workers of ended tasks stay alive beside those at work."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared folder that the session names.

    Only where none is named and driver and executors are one process (tests)
    a local folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="millrace")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: a lost executor costs no recomputation of what lies
    before. The shuffle files that the write needed are freed at its end.
    """
    path = scratch(spark)
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a stored table that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` as one, ``row``, beside those of a stage's own:
    no name that a table brings can clash with these."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in more.items()])


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def at_most(df: DataFrame, rows: int, total: int, *key: str) -> DataFrame:
    """All rows, or if there are more than ``rows`` about so many of them:
    those whose key hashes below a bound; rows of one key come together, so keys
    should be distinct. No order and no task-wise limit is
    needed, so what a driver then collects does not follow the partitions."""
    if total <= rows:
        return df
    # Five standard deviations below, so that the count stays within ``rows``.
    share = max(1.0, rows - 5 * rows**0.5) / total
    return df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int(share * (1 << 30)))


def sha256_hex(column):
    return F.sha2(column.cast("binary"), 256)
