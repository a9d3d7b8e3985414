"""What the operators of this subpackage share: reading tables, the shared folder, number of buckets."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of packed arrays that one bucket of a shuffle holds on average.
BUCKET_BYTES = 8 << 20
#: Paths of the tables that the innermost ``finished`` has seen written.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where it is unset and the
    master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="docflow-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_table(df: DataFrame, name: str) -> str:
    """Writes a table into the shared folder, which cuts its lineage; returns its path."""
    path = f"{shared_dir(df.sparkSession)}/docflow/{name}-{uuid.uuid4().hex}"
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of the frame that ``make`` returns, read from a table; the tables written on the way are removed."""
    on_the_way: list[str] = []
    token = _WRITTEN.set(on_the_way)
    try:
        frame = make()
        schema, path = frame.schema, write_table(frame, name)
        on_the_way.remove(path)
    finally:
        _WRITTEN.reset(token)
        for x in on_the_way:
            drop_table(spark, x)
    outer = _WRITTEN.get()
    if outer is not None:
        outer.append(path)
    return spark.read.schema(schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such a column already (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Sends at most 1,000 rows at a time to Python in this session; of long texts, Spark's 10,000 fill some hundred MB of
    an executor, outside its heap and in its workers. Smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= 1_000:
        spark.conf.set(key, "1000")


def trim() -> None:
    """Gives memory that a worker has freed back to the system, so that it doesn't add to what the next stage needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Number of rows and UTF-8 bytes of all texts."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def buckets_for(n_bytes: float, least: int = 12) -> int:
    """Buckets that hold about BUCKET_BYTES each; grows with the data, so that a task's memory doesn't."""
    return max(least, math.ceil(n_bytes / BUCKET_BYTES))
