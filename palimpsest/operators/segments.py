"""Segments (a chat's UTC day) and their generations: coverage, due work, totals, what depends on a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import utc_day
from palimpsest.operators.sequences import within

KEY = ["chat_id", "message_id"]


def indexable(messages: DataFrame, excluded: DataFrame) -> DataFrame:
    """Messages but for those of excluded (chat_id, author_id); a message without an author stays."""
    return messages.join(F.broadcast(excluded) if excluded.limit(100_001).count() <= 100_000 else excluded, ["chat_id", "author_id"], "left_anti")


def due(work: DataFrame, segments: DataFrame, chats: DataFrame) -> DataFrame:
    """Pending and failed work of the generation that its segment aims at, with its chat's title and whether vectors lag behind."""
    aims = segments.select("chat_id", "day", F.col("target_generation").alias("generation"), (F.col("dense_generation") < F.col("target_generation")).alias("behind"))
    return work.where("state in ('pending', 'failed')").join(aims, ["chat_id", "day", "generation"]).join(chats, "chat_id").select("chat_id", "day", "stage", "title", "behind")


def coverage_by_chat(segments: DataFrame) -> DataFrame:
    ready = F.count_if(F.expr("chunk_generation = target_generation and dense_generation = target_generation"))
    return segments.groupBy("chat_id").agg(F.count(F.lit(1)).alias("total"), ready.alias("ready"))


def chunk_totals(messages: DataFrame, chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """By segment: chunks, tokens, source messages, and those that no chunk owns."""
    made = chunks.groupBy("chat_id", "day").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("tokens"))
    own = parts.where("role <> 'borrowed_context'").groupBy("chat_id", "day").agg(F.countDistinct("message_id").alias("_own"))
    source = messages.groupBy("chat_id", utc_day(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("source"))
    zero = F.lit(0).cast("long")
    both = source.join(made, ["chat_id", "day"], "left").join(own, ["chat_id", "day"], "left")
    return both.select("chat_id", "day", F.coalesce("n_chunks", zero).alias("n_chunks"), F.coalesce("tokens", zero).alias("tokens"), "source", (F.col("source") - F.coalesce("_own", zero)).alias("skipped"))


def dependent_days(changed: DataFrame, parts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Segments that hold or borrow a changed message, or whose interval [since, until) it falls into."""
    held = parts.join(changed.select(*KEY), KEY, "left_semi").select("chat_id", "day")
    near = within(changed, ranges, "chat_id", "timestamp", "since", "until").select("chat_id", "day")
    return held.union(near).distinct()


def rebuilt(chunks: DataFrame, dirty: DataFrame) -> DataFrame:
    """chunks with the generation of dirty segments raised, and whether each was rebuilt."""
    marked = chunks.join(dirty.withColumn("rebuilt", F.lit(True)), ["chat_id", "day"], "left").withColumn("rebuilt", F.coalesce("rebuilt", F.lit(False)))
    return marked.withColumn("generation", F.col("generation") + F.col("rebuilt").cast("int"))


def superseded(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Ids of chunks of a generation before the one that is published."""
    done = segments.where("dense_generation = target_generation").select("chat_id", "day", "target_generation")
    return chunks.join(done, ["chat_id", "day"]).where("generation < target_generation").select(F.col("chunk_id").alias("id"))
