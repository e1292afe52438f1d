"""Shared pieces of the training-data operators: scratch tables, Arrow helpers, the hold-out rule."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package once a session, for clusters on which it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_palimpsest_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="palimpsest-")
    name = f"{folder}/palimpsest.zip"
    with zipfile.ZipFile(name, "w") as packed:
        for path in sorted(PACKAGE.rglob("*.py")):
            packed.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(name)
    context._palimpsest_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a session without that setting gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/palimpsest-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, root: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{root or scratch_root(spark)}/{name}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, root: str, *names: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, for sizing partitions."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return rows, size


def shards_for(size: int, target: int, least: int = 1) -> int:
    return max(least, -(-size // target))


def numbered(docs: DataFrame, root: str, nulls_first: bool, range_bytes: int = 16 << 20) -> DataFrame:
    """docs with row, a number of each row's own in the order of doc_id (a long) and text (null doc_ids all first or all last).

    Where no doc_id stands twice it is the number itself. Else the rows are dealt by ranges, sorted, numbered and written with
    their texts. Ranges go by the beginning of a text, as the driver holds a sample of what they go by.
    """
    null_id = F.lit(-(2**63) if nulls_first else 2**63 - 1)
    own = F.coalesce("doc_id", null_id)
    if docs.groupBy(own.alias("row")).count().where("count > 1").limit(1).count() == 0:
        return docs.withColumn("row", own)
    first = F.col("doc_id").asc_nulls_first() if nulls_first else F.col("doc_id").asc_nulls_last()
    ranged = docs.repartitionByRange(shards_for(text_bytes(docs)[1], range_bytes, 8), first, F.substring("text", 1, 40).asc())
    return staged(ranged.sortWithinPartitions(first, F.col("text").asc()).withColumn("row", F.monotonically_increasing_id()), "numbered", root)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def remainder_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def slices(batches: Iterator[pa.RecordBatch], size: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about size bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(array: pa.Array) -> np.ndarray:
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if large else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def lengths(array: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    if not len(array):
        return np.zeros(0, np.int64)
    return np.diff(offsets_of(array))


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and len+1 offsets into them (a null text is empty)."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets_of(array)
    data = array.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def raw_bytes(array: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column end to end."""
    return raw(array)[0]


def packed(batch: pa.RecordBatch) -> bytes:
    """A record batch as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def trimmed(work: Callable) -> Callable:
    """work, after whose end a worker gives the memory it freed back to the system: workers outlive their tasks."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def fixed_workers() -> None:
    """One thread for each Python worker: Spark has one for each core already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
