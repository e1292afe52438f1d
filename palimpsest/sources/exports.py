"""Readers of export files and writers of reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only a local session without that setting gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/palimpsest-{name}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared scratch folder and read back: what is read several times is computed once, and survives lost executors."""
    spark = rows.sparkSession
    path = f"{scratch(spark, 'tables')}/{name}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def placed(rows: DataFrame, *order: Column, name: str = "line") -> DataFrame:
    """rows with their place from 1 in an order over all of them: sorted by ranges, numbered within each, shifted by the sizes of those before."""
    spark = rows.sparkSession
    own = staged(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_range", F.shiftright("_at", 33))
    before, starts = 0, []
    for r in sorted(own.groupBy("_range").count().collect(), key=lambda r: r["_range"]):  # one row a range
        starts.append((r["_range"], before))
        before += r["count"]
    shifts = spark.createDataFrame(starts, "_range long, _before long")
    return own.join(shifts, "_range").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_range", "_before")


def csv_sink(rows: DataFrame, *order: Column, path: str | None = None) -> DataFrame:
    """Write rows as CSV in an order, over all files, and return them as read back with their line."""
    spark = rows.sparkSession
    out = path or scratch(spark, "csv")
    numbered = placed(rows, *order)
    numbered.write.option("header", True).csv(out)
    return spark.read.schema(numbered.schema).option("header", True).csv(out)
