"""Queries over messages, recognised texts and vectors: search, fusion, context, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.vectors import dot
from palimpsest.operators import postings as P
from palimpsest.operators import retrieval as R
from palimpsest.operators.store import Store
from palimpsest.plans.registry import WITH, bm25_sql, folded_sql, query, words_sql
from palimpsest.plans.spec import SearchSpec
from palimpsest.sources.exports import scratch, staged
from palimpsest.sources.views import EPOCH, messages, table

SPEC = SearchSpec(query="er th", author_ids=("user", "assistant"), date_from=EPOCH, date_to=EPOCH + 365 * 86400)
LIVE = SearchSpec(query="er th er", content_type="text", exclude_deleted=True)
#: SPEC and LIVE's conditions, for SQL.
SPEC_SQL = f"author_id IN ('user', 'assistant') AND timestamp >= {EPOCH} AND timestamp < {EPOCH + 365 * 86400}"
LIVE_SQL = "kind = 'message' AND text <> '' AND deleted = 0"
GOAL = [((i * 37) % 17 - 8) / 8 for i in range(64)]
GOAL_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in GOAL) + "]"
KEY = ["chat_id", "message_id"]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("chat_id"), F.col("embedding").alias("vector"))


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.nearest(vectors(spark, sf_dir), GOAL, k)


NEIGHBOURS_SQL = f"""away AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS chat_id,
  1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {GOAL_SQL}) AS distance FROM embeddings)"""


@query(f"""{WITH}, {bm25_sql(["er", "th"], keys="chat_id, message_id")},
top AS (SELECT s.* FROM scored s JOIN messages m USING (chat_id, message_id) WHERE {SPEC_SQL} ORDER BY score, timestamp, message_id, chat_id LIMIT 20),
placed AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, message_id) AS rn FROM messages)
SELECT a.chat_id, a.message_id AS anchor_id, p.message_id, CAST(p.rn - a.rn AS BIGINT) AS position, round(t.score, 6) AS score
FROM top t JOIN placed a ON a.chat_id = t.chat_id AND a.message_id = t.message_id
JOIN placed p ON p.chat_id = a.chat_id AND p.rn BETWEEN a.rn - 2 AND a.rn + 1""")
def ret01_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words by BM25 under author and date filters, with the messages around each hit."""
    m = messages(spark, sf_dir)
    # a page of results, used twice; only its chats are put in order
    hits = staged(R.search(m, SPEC).select(*KEY, "score"), "hits")
    around = R.context(m.join(F.broadcast(hits.select("chat_id").distinct()), "chat_id", "left_semi"), hits, 2, 1)
    return around.join(hits.select("chat_id", F.col("message_id").alias("anchor_id"), "score"), ["chat_id", "anchor_id"]).select("chat_id", "anchor_id", "message_id", F.col("offset").alias("position"), F.round("score", 6).alias("score"))


@query(f"{WITH}, {bm25_sql(['er', 'th', 'er'])} SELECT chat_id, message_id, round(score, 6) AS score FROM scored")
def ret02_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all matches over the statistics of the whole archive; a repeated term counts twice."""
    return R.bm25(messages(spark, sf_dir), "er th er").select(*KEY, F.round("score", 6).alias("score"))


@query(f"{WITH}, {bm25_sql(['er', 'th', 'er'])} SELECT s.chat_id, s.message_id, round(s.score, 6) AS score FROM scored s JOIN messages m USING (chat_id, message_id) WHERE {LIVE_SQL} ORDER BY s.score, s.timestamp, s.message_id, s.chat_id LIMIT 100")
def topk01_lexical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(messages(spark, sf_dir), LIVE, 100).select(*KEY, F.round("score", 6).alias("score"))


@query(f"""{WITH}, w AS (SELECT chat_id, message_id, {words_sql("text")} AS w, {folded_sql("text")} AS f FROM messages)
SELECT chat_id, message_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS BIGINT) AS tf
FROM w WHERE contains(f, 'of the') AND len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0""")
def ret03_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.phrase(messages(spark, sf_dir), "of the").select(*KEY, F.col("tf").cast("long").alias("tf"))


def word_index(spark: SparkSession, sf_dir: str) -> P.WordIndex:
    return P.WordIndex(Store(spark, scratch(spark, "words")), KEY)


@query(f"{WITH}, {bm25_sql(['er', 'th', 'er'])} SELECT chat_id, message_id, round(score, 6) AS score FROM scored")
def ret01_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a stored index of words."""
    found = word_index(spark, sf_dir).build(messages(spark, sf_dir)).bm25("er th er")
    return found.withColumn("score", F.round("score", 6))


@query(f"""{WITH}, later AS (SELECT * REPLACE (CASE WHEN message_id % 5 = 1 THEN text || ' er th' ELSE text END AS text) FROM messages WHERE message_id % 7 <> 3), {bm25_sql(['er', 'th'], "later")} SELECT chat_id, message_id, round(score, 6) AS score FROM scored""")
def ret01_updated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same once some texts have changed and others are gone: only these are indexed anew."""
    m = messages(spark, sf_dir)
    index = word_index(spark, sf_dir).build(m)
    changed = m.where("message_id % 5 = 1 and message_id % 7 <> 3").withColumn("text", F.concat("text", F.lit(" er th")))
    return index.update(changed, m.where("message_id % 7 = 3")).bm25("er th").withColumn("score", F.round("score", 6))


@query(f"""{WITH}, w AS (SELECT chat_id, message_id, {words_sql("text")} AS w FROM messages)
SELECT chat_id, message_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS BIGINT) AS tf FROM w WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0""")
def ret03_index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases by the places of their words in the index."""
    found = word_index(spark, sf_dir).build(messages(spark, sf_dir)).phrase("of the")
    return found.withColumn("tf", F.col("tf").cast("long"))


TIERS = "thernt erth"


def gram_index(spark: SparkSession, sf_dir: str) -> P.GramIndex:
    root = scratch(spark, "grams")
    return P.GramIndex(Store(spark, f"{root}/grams"), Store(spark, f"{root}/texts"), "doc_id").build(table(spark, sf_dir, "documents"))


def prefix_edits_sql(term: str) -> str:
    """Whether a text holds term with one typo: a letter more, fewer, other or swapped with the next."""
    wild = [f"{term[:i]}.{term[i:]}" for i in range(1, len(term))] + [term[:i] + term[i + 1 :] for i in range(len(term))] + [f"{term[:i]}.{term[i + 1:]}" for i in range(len(term))] + [term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)]
    return "(?s)" + "|".join(dict.fromkeys(wild))


@query(f"""WITH t AS (SELECT doc_id, {folded_sql("text")} AS t, {words_sql("text")} AS w FROM documents), d AS (SELECT *, {", ".join(f"CASE WHEN contains(t, '{x}') THEN 0 WHEN regexp_matches(t, '{prefix_edits_sql(x)}') THEN 1 END AS d{i}" for i, x in enumerate(TIERS.split()))} FROM t)
SELECT doc_id, CASE WHEN {" AND ".join(f"list_contains(w, '{x}')" for x in TIERS.split())} THEN 'exact' WHEN d0 + d1 = 0 THEN 'substring' ELSE 'fuzzy' END AS kind, d0 + d1 AS edits FROM d WHERE d0 + d1 IS NOT NULL""")
def ret04_word_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two words: as they are, within others, or with one typo each, from a stored index of letter grams."""
    return gram_index(spark, sf_dir).search(TIERS, most=None, budget=None).select("doc_id", "kind", "edits")


@query(f"WITH {NEIGHBOURS_SQL} SELECT id, round(distance, 6) AS distance FROM away ORDER BY away.distance, id DESC LIMIT 50")
def ret05_exact_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, 50).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {NEIGHBOURS_SQL.replace('FROM embeddings)', 'FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1))')} SELECT id, round(distance, 6) AS distance FROM away ORDER BY away.distance, id DESC LIMIT 20")
def ret05_eligible_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of those that meet a condition, which holds before ranking."""
    fit = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    found = R.nearest(vectors(spark, sf_dir).join(fit, "id", "left_semi"), GOAL, 20)
    return found.select("id", F.round("distance", 6).alias("distance"))


@query(f"""{WITH}, {bm25_sql(["er", "th"])}, {NEIGHBOURS_SQL},
a AS (SELECT chat_id, row_number() OVER (ORDER BY score, chat_id) AS rank FROM (SELECT chat_id, min(score) AS score FROM scored GROUP BY chat_id ORDER BY score, chat_id LIMIT 50)),
b AS (SELECT chat_id, row_number() OVER (ORDER BY distance, chat_id) AS rank FROM (SELECT chat_id, min(distance) AS distance FROM away GROUP BY chat_id ORDER BY distance, chat_id LIMIT 50)),
v AS (SELECT chat_id, 1.0::DOUBLE / (60 + rank) AS vote, 'words' AS branch FROM a UNION ALL SELECT chat_id, 0.5::DOUBLE / (60 + rank), 'meaning' FROM b)
SELECT chat_id, round(sum(vote), 9) AS score, string_agg(branch, ',' ORDER BY branch DESC) AS matched_by FROM v GROUP BY chat_id""")
def ret09_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted reciprocal-rank fusion of the word and the vector branch by chat."""
    words = R.bm25(messages(spark, sf_dir), "er th").groupBy("chat_id").agg(F.min("score").alias("score")).orderBy("score", "chat_id").limit(50)
    near = R.cosine_distances(vectors(spark, sf_dir), GOAL).groupBy("chat_id").agg(F.min("distance").alias("distance")).orderBy("distance", "chat_id").limit(50)
    branches = {"words": (R.ranked(words, F.col("score"), F.col("chat_id")), 1.0), "meaning": (R.ranked(near, F.col("distance"), F.col("chat_id")), 0.5)}
    return R.fused(branches, ["chat_id"]).withColumn("score", F.round("score", 9))


@query(f"""{WITH}, {bm25_sql(["er"])} SELECT chat_id, arg_min(message_id, (score, message_id)) AS message_id, round(min(score), 6) AS score FROM scored GROUP BY chat_id""")
def win05_best_of_each_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bm25(messages(spark, sf_dir), "er")
    return found.groupBy("chat_id").agg(F.min_by("message_id", F.struct("score", "message_id")).alias("message_id"), F.round(F.min("score"), 6).alias("score"))


@query(f"""WITH {NEIGHBOURS_SQL}, head AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id DESC) AS place FROM away ORDER BY distance, id DESC LIMIT 80),
s AS (SELECT h.id, h.place, list_inner_product(CAST(e.embedding AS DOUBLE[])[1:8], {GOAL_SQL}[1:8]) AS score FROM head h JOIN embeddings e ON e.vec_id = h.id WHERE h.place <= 50)
SELECT id, CAST(row_number() OVER (ORDER BY score DESC, place) AS BIGINT) AS rank FROM s UNION ALL SELECT id, CAST(place AS BIGINT) FROM head WHERE place > 50""")
def ret17_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 by another score, stable on ties; the tail as it was."""
    place = R.ranked(neighbours(spark, sf_dir, 80), F.col("distance"), F.col("id").desc(), name="place")
    head = place.where("place <= 50").join(vectors(spark, sf_dir).select("id", "vector"), "id")
    score = dot(F.slice("vector", 1, 8), F.array(*map(F.lit, GOAL[:8])))
    top = R.ranked(head.select("id", "place", score.alias("score")), F.col("score").desc(), F.col("place"))
    tail = place.where("place > 50").select("id", F.col("place").cast("long").alias("rank"))
    return top.select("id", F.col("rank").cast("long").alias("rank")).union(tail)


@query(f"""{WITH}, p AS (SELECT chat_id, message_id, row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, message_id) - 1 AS prev,
 count(*) OVER (PARTITION BY chat_id) - row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, message_id) AS next FROM messages),
q AS (SELECT *, least(3 - least(1, prev), next) AS n_after FROM p)
SELECT chat_id, message_id, CAST(least(3 - n_after, prev) AS BIGINT) AS n_before, CAST(n_after AS BIGINT) AS n_after FROM q""")
def win02_filling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.result_context(messages(spark, sf_dir), 4)


@query(f"""{WITH}, placed AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY timestamp, message_id) AS rn FROM messages WHERE deleted = 0)
SELECT a.chat_id, a.message_id AS anchor_id, p.message_id, CAST(p.rn - a.rn AS BIGINT) AS position,
 (p.author_id IN ('user', 'assistant') AND p.timestamp >= {EPOCH} AND p.timestamp < {EPOCH + 365 * 86400}) AS matches_filters
FROM placed a JOIN placed p ON p.chat_id = a.chat_id AND p.rn BETWEEN a.rn - 3 AND a.rn + 3 WHERE a.has_photo = 1""")
def win01_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live messages around every photo message, flagged by whether they pass the filters themselves."""
    m = messages(spark, sf_dir).where("deleted = 0")
    return R.context(m, m.where("has_photo = 1"), 3, 3).select("chat_id", "anchor_id", "message_id", F.col("offset").alias("position"), SPEC.filters().alias("matches_filters"))


CURSOR = (EPOCH + 12 * 86400, 2, 17)


@query(f"""{WITH} SELECT timestamp, chat_id, message_id FROM messages WHERE {LIVE_SQL}
AND (timestamp, chat_id, message_id) < ({CURSOR[0]}, {CURSOR[1]}, {CURSOR[2]}) ORDER BY timestamp DESC, chat_id DESC, message_id DESC LIMIT 21""")
def topk06_browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page behind a cursor, and one row that tells whether more follow."""
    spec = SearchSpec(content_type="text", exclude_deleted=True)
    return R.browse(messages(spark, sf_dir), spec, CURSOR).select("timestamp", *KEY)


@query(f"{WITH} SELECT chat_id, message_id FROM messages WHERE {SPEC_SQL}")
def fil01_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where(SPEC.filters()).select(*KEY)


@query(f"""{WITH} SELECT chat_id, message_id, has_photo = 1 AS is_photo, kind = 'message' AND text <> '' AS is_text, kind = 'service' AS is_service FROM messages""")
def fil03_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {f"is_{k}": SearchSpec(content_type=k).filters() for k in ("photo", "text", "service")}
    return messages(spark, sf_dir).select(*KEY, *(c.alias(n) for n, c in kinds.items()))


@query(f"""{WITH} SELECT chat_id, message_id FROM messages WHERE (timestamp, chat_id, message_id) > ({CURSOR[0]}, {CURSOR[1]}, {CURSOR[2]})""")
def fil10_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where(R.after(CURSOR, newest=False)).select(*KEY)


@query(f"{WITH} SELECT DISTINCT forwarded_from FROM messages WHERE contains({folded_sql('forwarded_from')}, 'd 1')")
def fil12_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = messages(spark, sf_dir).select("forwarded_from").distinct()
    return names.where(R.folded(F.col("forwarded_from")).contains("d 1"))


@query(f"""WITH {NEIGHBOURS_SQL} SELECT id, chat_id, round(distance, 6) AS distance FROM away QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY distance, id) <= 5""")
def ret14_best_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each scope."""
    found = R.cosine_distances(vectors(spark, sf_dir), GOAL)
    order = R.W.partitionBy("chat_id").orderBy("distance", "id")
    return found.withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("id", "chat_id", F.round("distance", 6).alias("distance"))
