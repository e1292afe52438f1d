"""Words and vectors together: published chunks, witnesses, keys of lexical hits, anchors, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import query_terms, words
from palimpsest.operators import retrieval as R
from palimpsest.plans.spec import SearchSpec
from palimpsest.sources.exports import staged

KEY = ["chat_id", "message_id"]


def published(chunks: DataFrame, segments: DataFrame, space: str) -> DataFrame:
    """Chunks of one vector space whose generation is the one that their segment has reached in words and vectors."""
    done = segments.where("chunk_generation = target_generation and dense_generation = target_generation").select("chat_id", "day", F.col("target_generation").alias("generation"))
    return chunks.where(F.col("space_id") == space).join(done, ["chat_id", "day", "generation"], "left_semi")


def owned(parts: DataFrame) -> DataFrame:
    return parts.where("role <> 'borrowed_context'")


def witnessed(chunks: DataFrame, parts: DataFrame, messages: DataFrame, spec: SearchSpec) -> DataFrame:
    """Chunks of which one owned message meets all filters at once; with exclude_deleted none that owns a deleted one."""
    fit = messages.where(spec.filters()).select(*KEY)
    out = chunks.join(owned(parts).join(fit, KEY, "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    if spec.exclude_deleted:
        gone = messages.where("deleted = 1").select(*KEY)
        out = out.join(parts.join(gone, KEY, "left_semi").select("chunk_id"), "chunk_id", "left_anti")
    return out


def bounds(chunks: DataFrame) -> DataFrame:
    """How many chunks there are, and the days and the chat (null if several) that hold them."""
    one = F.when(F.min("chat_id") == F.max("chat_id"), F.min("chat_id"))
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), one.alias("chat_id"))


def first_chunks(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each message the chunk of the lowest number that holds it."""
    held = parts.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return held.groupBy(*KEY).agg(F.min_by("chunk_id", F.struct("number", "chunk_id")).alias("chunk_id"))


def lexical_keys(hits: DataFrame, parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (chat_id, message_id, rank) with key: the chunk that holds the message, or the message itself if none does or a better hit has the chunk."""
    placed = hits.join(first_chunks(parts, chunks), KEY, "left")
    best = F.row_number().over(W.partitionBy("chunk_id").orderBy("rank"))
    own = F.concat_ws(":", F.lit("message"), "chat_id", "message_id")
    return placed.withColumn("key", F.when(F.col("chunk_id").isNotNull() & (best == 1), F.col("chunk_id")).otherwise(own)).drop("chunk_id")


def has_term(text: Column, query: str) -> Column:
    terms = query_terms(query)
    return F.arrays_overlap(words(text), F.array(*map(F.lit, terms))) if terms else F.lit(False)


def anchors(keys: DataFrame, lexical: DataFrame, parts: DataFrame, messages: DataFrame, spec: SearchSpec) -> DataFrame:
    """keys with the message each is shown by: the lexical hit, else of the owned messages that meet the filters one with a term, then a core one, then the first.

    Keys without one go; of keys with the same message the best (by score, then key) stays.
    """
    order = F.struct((~has_term(F.col("text"), spec.query)).alias("a"), (F.col("role") != "core").alias("b"), F.col("ordinal").alias("c"))
    wanted = keys.join(lexical.select("key"), "key", "left_anti").select(F.col("key").alias("chunk_id"))
    shown = owned(parts).join(wanted, "chunk_id", "left_semi").join(messages.where(spec.filters()).select(*KEY, "text"), KEY).withColumn("_order", order)
    chosen = shown.groupBy(F.col("chunk_id").alias("key")).agg(F.min_by(F.struct(*KEY), "_order").alias("m")).select("key", "m.*")
    found = keys.join(lexical.select("key", *KEY).unionByName(chosen), "key")
    first = F.row_number().over(W.partitionBy(*KEY).orderBy(F.col("score").desc(), "key"))
    return found.withColumn("_first", first).where("_first = 1").drop("_first")


def evidence(found: DataFrame, parts: DataFrame, messages: DataFrame) -> DataFrame:
    """found (key, chat_id, message_id, matched_by) with the spans that matched: the chunk's owned parts, and the message itself where words matched or there are none."""
    spans = owned(parts).groupBy(F.col("chunk_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "message_id", F.col("chars").alias("end")))).alias("spans"))
    joined = found.join(spans, "key", "left").join(messages.select(*KEY, F.length("text").alias("_chars")), KEY)
    of_chunk = F.transform(F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)), lambda x: F.struct(x["message_id"].alias("message_id"), x["end"].alias("end")))
    itself = F.array(F.struct(F.col("message_id"), F.col("_chars").alias("end")))
    with_words = F.col("matched_by").contains("words") | (F.size(of_chunk) == 0)
    spans = F.when(with_words & ~F.exists(of_chunk, lambda x: (x["message_id"] == F.col("message_id")) & (x["end"] == F.col("_chars"))), F.concat(of_chunk, itself)).otherwise(of_chunk)
    return joined.withColumn("spans", spans).drop("_chars")


def lexical_branch(messages: DataFrame, spec: SearchSpec, most: int) -> DataFrame:
    """The best messages by words, ranked from 1."""
    found = R.bm25(messages, spec.query).where(spec.filters()).orderBy("score", *KEY).limit(most)
    return R.ranked(found, F.col("score"), *map(F.col, KEY)).select(*KEY, "rank")


def dense_branch(eligible: DataFrame, vectors: DataFrame, goal: list[float], most: int) -> DataFrame:
    """The nearest chunks, ranked from 1. vectors: vec_id and vector."""
    rows = eligible.select(F.col("chunk_id").alias("id"), "vec_id").join(vectors, "vec_id").select("id", "vector")
    near = R.nearest(rows, goal, most)
    return R.ranked(near, F.col("distance"), F.col("id").desc()).select(F.col("id").alias("key"), "rank")


def hybrid(messages: DataFrame, chunks: DataFrame, parts: DataFrame, segments: DataFrame, vectors: DataFrame, spec: SearchSpec, goal: list[float] | None, space: str = "space", most: int = 100, limit: int = 20, k: int = 60) -> DataFrame:
    """key, score, matched_by and the anchor (chat_id, message_id) of the best results, with mode: the one that took effect.

    words, and any exact phrase, go by words alone; so does everything without a query vector or a published segment. A blank
    query finds nothing. Scores of the branches are fused by rank.
    """
    if spec.browses:
        return messages.limit(0).select(F.lit("").alias("key"), F.lit(0.0).alias("score"), F.lit("").alias("matched_by"), *KEY, F.lit(spec.mode).alias("mode"))
    live = published(chunks, segments, space)
    mode = "words" if spec.mode == "words" or spec.exact_phrase or goal is None or not live.limit(1).count() else spec.mode
    if mode == "words":
        found = R.ranked(R.search(messages, spec, limit), F.col("score"), *map(F.col, ("timestamp", "message_id", "chat_id")))
        return found.select(F.concat_ws(":", F.lit("message"), *KEY).alias("key"), (F.lit(1.0) / (k + F.col("rank"))).alias("score"), F.lit("words").alias("matched_by"), *KEY, F.lit("words").alias("mode"))
    lexical = lexical_keys(lexical_branch(messages, spec, most), parts, live)
    if mode == "meaning":
        lexical = lexical.limit(0)
    # both branches are pages of at most most rows, and are used several times
    lexical = staged(lexical, "lexical")
    dense = staged(dense_branch(witnessed(live, parts, messages, spec), vectors, goal, most), "dense")
    keys = R.fused({"words": (lexical, 1.0), "meaning": (dense, 1.0)}, ["key"], k)
    found = anchors(keys, lexical, parts, messages, spec)
    return found.orderBy(F.col("score").desc(), "key").limit(limit).select("key", "score", "matched_by", *KEY, F.lit(mode).alias("mode"))


def coverage(segments: DataFrame) -> DataFrame:
    """Segments in all, those published in words and vectors, and the warning that a part is missing."""
    ready = F.count_if(F.expr("chunk_generation = target_generation and dense_generation = target_generation"))
    counts = segments.agg(F.count(F.lit(1)).alias("total"), ready.alias("ready"))
    return counts.withColumn("warning", F.when(F.col("ready") < F.col("total"), F.concat(F.lit("meaning covers "), "ready", F.lit(" of "), "total", F.lit(" segments"))))
