"""The change feed as a stream: micro-batches are folded and merged into versions of a table, each named by its batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.operators.store import PartitionedStore
from palimpsest.sources.exports import scratch, staged


def op_of(kind: Column) -> Column:
    """What a kind of event does: some delete, all others write."""
    return F.when(kind == "error", "delete").otherwise("upsert")


def received(events: DataFrame) -> DataFrame:
    """Changes from events: user_id, event_id, ts, op (upsert or delete) and n, the events each stands for."""
    return events.select("user_id", "event_id", "ts", op_of(F.col("event_type")).alias("op"), F.lit(1).cast("long").alias("n"))


def folded(changes: DataFrame) -> DataFrame:
    """The last change of each key and how many there were."""
    last = F.max(F.struct("ts", "event_id", "op")).alias("last")
    return changes.groupBy("user_id").agg(last, F.sum("n").alias("n")).select("user_id", "last.event_id", "last.ts", "last.op", "n")


#: Folders that keys are dealt to. A micro-batch rewrites those of its keys.
BUCKETS = 64


def bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int"))


def run(spark: SparkSession, source: str, schema: StructType, root: str, files_per_batch: int = 1) -> PartitionedStore:
    """Merge all events below source (a path or glob) that were not yet merged into the table below root; returns the table.

    Offsets are the stream's checkpoint, the state is the table: both lie below root, so a run goes on where the one before ended. A version
    carries the number of its batch, and a batch that is run again after its version was named changes nothing: each event counts once. A batch reads and
    writes the buckets of its keys only; two runs of the same batch can't both name its version.
    """
    store = PartitionedStore(spark, f"{root}/state", ["bucket"])

    def merge(batch: DataFrame, k: int) -> None:
        at = store.at()
        if at is not None and at.facts["batch"] >= k:
            return
        fresh = folded(received(batch))
        if at is None:
            store.publish(bucketed(fresh), facts={"batch": k})
            return
        fresh = staged(bucketed(fresh), "batch")
        touched = [(r.bucket,) for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
        old = store.only(at, store.named(touched, at))
        store.replace(bucketed(folded(old.drop("bucket").unionByName(fresh.drop("bucket")))), touched, at, {"batch": k})
        store.clean()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store


def latest_by_key(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """user_id, event_id, ts and op of the last change, and n changes, after all events."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # a file source reads folders: the glob also fits a table of one file
    store = run(spark, f"{sf_dir}/events.parque[t]", schema, root or scratch(spark, "streams"))
    return store.read().drop("bucket") if store.at() else folded(received(spark.createDataFrame([], schema)))
