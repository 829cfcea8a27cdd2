"""What the corpus operators share: durable scratch tables, spreading of small
inputs over the cores, and checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a table only up to so many bytes of rows.
BROADCAST_BYTES = 1 << 20
#: The setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it none of df's columns, in whatever case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


class Workspace:
    """Scratch tables in the folder that all executors share.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is
    unset (tests on one machine) a local temporary folder is chosen. A written
    table cuts the lineage and survives the loss of executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = f"file://{tempfile.gettempdir()}/panelloom-{os.getpid()}"
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """The table, written; its shuffle files go at once, as nothing reads them again, and not when the driver collects its garbage."""
        conf = self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        finally:
            if before is None:
                conf.unset(CLEANUP)
            else:
                conf.set(CLEANUP, before)
        return self.read(name)

    def read(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*map(self.path, names))

    def drop(self, *names: str) -> None:
        """Remove the tables, or all if none is named, once nothing reads them any more."""
        jvm = self.spark.sparkContext._jvm
        for at in map(self.path, names) if names else [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def within(self, label: str) -> Workspace:
        """A folder inside this one, for tables that go together."""
        inner = Workspace(self.spark, label)
        inner.root = self.path(f"{label}-{uuid.uuid4().hex}")
        return inner


#: Rows of an Arrow batch, so that a Python worker holds a few MB of usual texts at a time.
BATCH_ROWS = 1000


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out if the input has fewer splits than there are cores.

    Large inputs have many splits and are left alone (no shuffle). Also keeps the
    session's Arrow batches small, as texts are wide rows."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_HELD: dict[str, object] = {}


def release() -> None:
    """Give what a Python worker holds of earlier operators back to the system, as Spark uses a worker again for the next one."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held(name: str, make: Callable[[], object]) -> object:
    """Tables and word caches of a Python worker: kept from task to task, but of one operator at a time."""
    if name not in _HELD:
        release()
        _HELD[name] = make()
    return _HELD[name]


def small_side(written: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the rows' bytes, summed, stay under the limit; else leave the join to Spark.

    The table is read for it, so it should be a written one."""
    size = written.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(written) if size <= limit else written


def id_hash_mod(column: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a row (null ids: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")), F.lit(modulus))
