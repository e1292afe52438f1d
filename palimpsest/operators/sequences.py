"""Ordered-sequence operators: sessions, as-of and interval joins, interval unions and decayed quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import utc_day


def episodes(messages: DataFrame, gap: int = 3600) -> DataFrame:
    """An episode number per chat: a new one at another UTC day, a change of the deleted flag or a gap of more than gap seconds."""
    order = W.partitionBy("chat_id").orderBy("timestamp", "message_id")
    was = lambda c: F.lag(c).over(order)
    new = was("timestamp").isNull() | (utc_day(F.col("timestamp")) != utc_day(was("timestamp"))) | (F.col("deleted") != was("deleted")) | (F.col("timestamp") - was("timestamp") > gap)
    return messages.withColumn("_new", new.cast("int")).withColumn("episode", F.sum("_new").over(order)).drop("_new")


def ancestors(messages: DataFrame, age: int = 30 * 86400) -> DataFrame:
    """Parent and grandparent of each reply, no older than age; a message isn't its own ancestor."""
    reply = messages.select("chat_id", "message_id", "timestamp", "reply_to")
    one = messages.select(F.col("chat_id").alias("c1"), F.col("message_id").alias("parent_id"), F.col("timestamp").alias("t1"), F.col("reply_to").alias("r1"))
    two = messages.select(F.col("chat_id").alias("c2"), F.col("message_id").alias("grandparent_id"), F.col("timestamp").alias("t2"))
    first = reply.join(one, (reply.chat_id == one.c1) & (reply.reply_to == one.parent_id) & (reply.timestamp - one.t1 <= age), "left")
    both = first.join(two, (F.col("chat_id") == F.col("c2")) & (F.col("r1") == F.col("grandparent_id")) & (F.col("timestamp") - F.col("t2") <= age) & (F.col("grandparent_id") != F.col("message_id")), "left")
    return both.select("chat_id", "message_id", "parent_id", "grandparent_id")


def within(points: DataFrame, ranges: DataFrame, key: str, time: str, start: str, end: str, width: int = 86400) -> DataFrame:
    """Interval join: points in [start, end) of ranges with the same key. Both sides meet in buckets of width, so it is an equi-join."""
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    own = points.withColumn("_bucket", F.floor(F.col(time) / width))
    return own.join(cut, [key, "_bucket"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_bucket")


def covered_time(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Seconds that the union of overlapping spans covers, for each key."""
    order = W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.max(end).over(order), F.col(start))))
    return spans.withColumn("_fresh", fresh).groupBy(*keys).agg(F.sum("_fresh").alias("covered"), F.count(F.lit(1)).alias("spans"))


def keep_last(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def decayed_quantile(samples: DataFrame, keys: list[str], value: str, time: str, id_: str, share: float, half: int = 6) -> DataFrame:
    """The weighted quantile of a value by key, the weight halving every half samples back from the newest.

    Beyond 40 halvings a sample weighs nothing, so only the newest 40 * half are kept before anything is ordered by value.
    """
    newest = W.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(id_).desc())
    last = samples.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= 40 * half)
    weighed = last.withColumn("_w", F.pow(F.lit(0.5), (F.col("_rn") - 1) / F.lit(float(half))))
    rising = W.partitionBy(*keys).orderBy(value, id_)
    placed = weighed.withColumns({"_cum": F.sum("_w").over(rising.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_w").over(W.partitionBy(*keys))})
    return placed.where(F.col("_cum") >= share * F.col("_all") - 1e-12).groupBy(*keys).agg(F.min(value).alias("quantile"))
