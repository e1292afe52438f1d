"""Keyword, phrase, fuzzy and vector retrieval; fusion, context and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import folded, normal, query_terms, query_words, words
from palimpsest.functions.vectors import cosine_distances
from palimpsest.plans.spec import SearchSpec, after

KEY = ["chat_id", "message_id"]


def matches(texts: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """texts with their length in words and, in tf0, tf1 and so on, how often each distinct term stands in them. One scan, no shuffle."""
    found = texts.withColumn("_words", words(F.col(text)))
    count = lambda t: F.size(F.filter("_words", lambda x: x == t))
    counts = {f"tf{i}": count(t) for i, t in enumerate(dict.fromkeys(terms))}
    return found.withColumns({"dl": F.size("_words")} | counts).drop("_words")


def bm25(texts: DataFrame, query: str, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows with all terms of query and their score (the smaller the better).

    Corpus statistics cover all rows of texts: filter the result, not the input. A term that the query repeats counts as often.
    """
    terms = query_terms(query)
    if not terms:
        return texts.limit(0).withColumn("score", F.lit(0.0))
    distinct = list(dict.fromkeys(terms))
    found = matches(texts, distinct, text)
    facts = found.agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"_df{i}") for i in range(len(distinct))))
    every = F.lit(True)
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        tf, df = F.col(f"tf{i}"), F.col(f"_df{i}")
        every = every & (tf > 0)
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score - terms.count(t) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("_avg")))
    # one row of statistics stands beside every match
    return found.where(every).join(F.broadcast(facts), F.lit(True)).withColumn("score", score).select(*texts.columns, "score")


def phrase(texts: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows in which the words of query follow one another, with how often; the literal text must stand there too."""
    terms = query_words(query)
    n = len(terms)
    if not n:
        return texts.limit(0).withColumn("tf", F.lit(0))
    # the literal text rules out most rows before any is cut into words
    found = texts.where(folded(F.col(text)).contains(normal(query).strip())).withColumn("_words", words(F.col(text)))
    start = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_words") - n + 1, F.lit(1))), lambda i: F.slice("_words", i, n) == F.array(*map(F.lit, terms)))
    return found.withColumn("tf", F.size(start)).where("tf > 0").drop("_words")


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """Exact cosine top k among rows that already passed every filter; ties go to the larger id."""
    return cosine_distances(vectors, query, vector).orderBy("distance", F.col(key).desc()).limit(k)


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Positions from 1 over at most a result page of candidates."""
    return rows.withColumn(name, F.row_number().over(W.orderBy(*order)))


def fused(branches: dict[str, tuple[DataFrame, float]], key: Sequence[str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: the sum of weight / (k + rank), and the branches that matched, in their order. A branch has key and rank."""
    union = None
    for place, (name, (rows, weight)) in enumerate(branches.items()):
        own = rows.select(*key, (F.lit(weight) / (k + F.col("rank"))).alias("vote"), F.struct(F.lit(place).alias("place"), F.lit(name).alias("name")).alias("branch"))
        union = own if union is None else union.union(own)
    matched = F.transform(F.array_sort(F.collect_set("branch")), lambda x: x["name"])
    return union.groupBy(*key).agg(F.sum("vote").alias("score"), F.array_join(matched, ",").alias("matched_by"))


def context(messages: DataFrame, anchors: DataFrame, before: int, after_: int) -> DataFrame:
    """Messages around each anchor (chat_id, message_id) in the chat's order, as anchor_id with offset."""
    order = W.partitionBy("chat_id").orderBy("timestamp", "message_id")
    placed = messages.withColumn("_rn", F.row_number().over(order))
    wanted = placed.join(anchors.select(*KEY), KEY, "left_semi").select("chat_id", F.col("message_id").alias("anchor_id"), F.explode(F.sequence(F.col("_rn") - before, F.col("_rn") + after_)).alias("_rn"), F.col("_rn").alias("_at"))
    return placed.join(wanted, ["chat_id", "_rn"]).withColumn("offset", (F.col("_rn") - F.col("_at")).cast("long")).drop("_rn", "_at")


def result_context(messages: DataFrame, size: int) -> DataFrame:
    """For every message the bounds of a window of size messages that fills up at the ends of the chat."""
    order = W.partitionBy("chat_id").orderBy("timestamp", "message_id")
    placed = messages.select(*KEY, (F.row_number().over(order) - 1).alias("prev"), (F.count(F.lit(1)).over(W.partitionBy("chat_id")) - F.row_number().over(order)).alias("next"))
    first = F.least(F.lit((size - 1) // 2), F.col("prev"))
    follow = F.least(size - 1 - first, F.col("next"))
    lead = F.least(size - 1 - follow, F.col("prev"))
    return placed.select(*KEY, lead.cast("long").alias("n_before"), follow.cast("long").alias("n_after"))


def browse(messages: DataFrame, spec: SearchSpec, cursor: tuple | None = None) -> DataFrame:
    """One page and one row more, newest or oldest first, behind a cursor."""
    newest = spec.sort == "newest"
    rows = messages.where(spec.filters())
    if cursor is not None:
        rows = rows.where(after(cursor, newest))
    keys = ["timestamp", "chat_id", "message_id"]
    return rows.orderBy(*((F.col(k).desc() if newest else F.col(k).asc()) for k in keys)).limit(spec.page_size + 1)


def search(messages: DataFrame, spec: SearchSpec, limit: int = 20) -> DataFrame:
    """Keyword search: scores over the whole archive, filters before ranking."""
    found = bm25(messages, spec.query) if not spec.exact_phrase else bm25(messages, spec.query).join(phrase(messages, spec.query).select(*KEY), KEY, "left_semi")
    return found.where(spec.filters()).orderBy("score", "timestamp", "message_id", "chat_id").limit(limit)
