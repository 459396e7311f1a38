"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, in one Arrow batch between the JVM and Python: whole texts and blocks are long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 8_000_000

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(), "pricelore.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; one of our own only where that is unset and Spark runs in one
    process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = tempfile.mkdtemp(prefix="pricelore-")
        spark.conf.set("spark.checkpoint.dir", where)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The kept columns and the text as text (null: empty); other columns go, so none can clash."""
    return df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, compressed byte place by byte place."""
    from zstandard import ZstdCompressor

    n = len(columns[0])
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns]
    return ZstdCompressor(level=1).compress(n.to_bytes(4, "little") + b"".join(planes))


def unpack(body: bytes, types: tuple[str | int, ...]) -> list[np.ndarray]:
    """The columns of a block; a number for a type is a row of so many bytes."""
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(body)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for t in types:
        width = t if isinstance(t, int) else np.dtype(t).itemsize
        rows = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T)
        out.append(rows if isinstance(t, int) else rows.view(t).reshape(n))
        at += n * width
    return out


def _give_back() -> None:
    """Let the system have the memory that this process has freed, and map its large arrays one by one, so that each goes back when it is freed."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows with what is freed
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """run, a function of Arrow batches, for a Python worker that keeps no memory after it: Spark keeps the workers."""

    def lean_run(batches):
        _give_back()
        yield from run(batches)
        _give_back()

    return lean_run


#: Rows of a few bytes that are broadcast at most.
MOST_BROADCAST = 500_000


def small(df: DataFrame) -> DataFrame | None:
    """df marked for a broadcast, if its rows, narrow ones, are few enough; they are counted. Else None."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else None


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored: it does once their plans are collected, which takes
    more than one round, as plans are let go here first and there later. In one process disk is not shared and this not worth
    the wait."""
    if spark.sparkContext.master.startswith("local"):
        return
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
