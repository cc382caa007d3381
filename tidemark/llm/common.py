"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel handles at once; bounds a worker's memory whatever the batch.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only for local sessions that name none."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"{tempfile.gettempdir()}/tidemark-checkpoints"
    return f"file://{own}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and lost executors cost no recomputation.

    Results read these tables lazily, so they stay; an application's folder can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch between Spark and a Python worker, at most.
BATCH_BYTES = 8 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, unless their import path has it."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped or not root.is_dir() or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"tidemark-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "tidemark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_BYTES, after which a worker gives its free memory back.

    Spark reads the bound on batches when the plan runs, so the session keeps the smaller value.
    """
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(freeing, schema)


#: Ids from here on stand in for missing ones within operators that join by id.
STAND_IN = 1 << 62


def stand_in_id() -> F.Column:
    """doc_id, or where it is missing one that the row's text gives."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(STAND_IN) + F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(STAND_IN)))


def id_text(docs: DataFrame, stand_in: bool = False) -> DataFrame:
    """doc_id and text, a null text as an empty one; with stand_in, no id is missing."""
    return docs.select((stand_in_id() if stand_in else F.col("doc_id").cast("long")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def real_id(c: str) -> F.Column:
    """The id, null where it was a stand-in."""
    return F.when(F.col(c) < STAND_IN, F.col(c)).alias(c)


#: What parts the keys of neighbouring tasks: low bits of a key differ between tasks as well.
KEY_STEP = 5_184_337


def keyed(docs: DataFrame) -> DataFrame:
    """key and doc: every row of docs as one struct, staged beside a number that no other row has, below STAND_IN.

    Operators that give rows back join by it: ids may be missing, or shared by rows.
    """
    task, at = F.spark_partition_id().cast("long"), F.monotonically_increasing_id() % (1 << 33)
    key = F.call_function("shiftleft", task, F.lit(33)) + (at + task * KEY_STEP) % (1 << 33)
    return staged(docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "keyed")


def utf8_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) for runs of rows of at most limit bytes, or one longer row."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, 8 * col.offset)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def texts(batch: pa.RecordBatch, column: str = "text", rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """Yield (first row, texts) for small runs of rows, so few Python strings are alive at once."""
    col = batch.column(batch.schema.get_field_index(column))
    for i in range(0, len(col), rows):
        yield i, col.slice(i, rows).to_pylist()


def flat_gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate values[s:s+n] for each (s, n)."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return values[shift + np.arange(total)]
