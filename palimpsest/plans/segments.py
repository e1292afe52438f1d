"""Chunks, segments and hybrid search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import hybrid as H
from palimpsest.operators import publish as B
from palimpsest.operators import retrieval as R
from palimpsest.operators import segments as G
from palimpsest.operators.store import BUCKETS, PartitionedStore, Store
from palimpsest.plans.registry import bm25_sql, keywords_sql, query, words_sql
from palimpsest.plans.retrieval import GOAL, GOAL_SQL
from palimpsest.plans.spec import SearchSpec
from palimpsest.sources.exports import scratch, staged
from palimpsest.sources.views import ARCHIVE_SQL, EPOCH, derived, messages, table

KEY = ["chat_id", "message_id"]
ARCHIVE = f"WITH {ARCHIVE_SQL}"
SPEC = SearchSpec(query="er th", mode="hybrid", author_ids=("user", "assistant"), date_from=EPOCH + 86400, exclude_deleted=True)
SPEC_SQL = f"author_id IN ('user', 'assistant') AND timestamp >= {EPOCH + 86400} AND deleted = 0"
LIVE_SQL = """live AS (SELECT c.* FROM chunks c JOIN segments s USING (chat_id, day) WHERE c.space_id = 'space' AND c.generation = s.target_generation AND s.chunk_generation = s.target_generation AND s.dense_generation = s.target_generation)"""
WITNESS_SQL = f"""fit AS (SELECT * FROM messages WHERE {SPEC_SQL}),
eligible AS (SELECT * FROM live c WHERE EXISTS (SELECT 1 FROM parts p JOIN fit m ON m.chat_id = p.chat_id AND m.message_id = p.message_id WHERE p.chunk_id = c.chunk_id AND p.role <> 'borrowed_context')
 AND NOT EXISTS (SELECT 1 FROM parts p JOIN messages m ON m.chat_id = p.chat_id AND m.message_id = p.message_id WHERE p.chunk_id = c.chunk_id AND m.deleted = 1))"""


def archive(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [messages(spark, sf_dir) if n == "messages" else derived(spark, sf_dir, n) for n in names]


def written(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """As archive, but derived once: what a search uses several times is read, not made again."""
    return [staged(x, name) for x, name in zip(archive(spark, sf_dir, *names), names, strict=True)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.published(*archive(spark, sf_dir, "chunks", "segments"), "space")


@query(f"{ARCHIVE} SELECT m.chat_id, m.message_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT chat_id, 'assistant' AS author_id FROM messages WHERE chat_id % 3 = 0) x WHERE x.chat_id = m.chat_id AND x.author_id = m.author_id)")
def fil04_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that may be indexed: those of excluded authors are out, those without an author stay."""
    m = messages(spark, sf_dir)
    excluded = m.where("chat_id % 3 = 0").select("chat_id", F.lit("assistant").alias("author_id")).distinct()
    return G.indexable(m, excluded).select(*KEY)


@query(f"{ARCHIVE}, {LIVE_SQL} SELECT chunk_id FROM live")
def fil06_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).select("chunk_id")


@query(f"""{ARCHIVE}, {LIVE_SQL} SELECT chunk_id FROM live c WHERE EXISTS (SELECT 1 FROM parts p JOIN messages m ON m.chat_id = p.chat_id AND m.message_id = p.message_id
WHERE p.chunk_id = c.chunk_id AND p.role <> 'borrowed_context' AND m.author_id = 'user' AND m.has_photo = 1)""")
def fil07_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which one message of their own is a user's and has a photo: two messages with one of each don't do."""
    spec = SearchSpec(author_ids=("user",), content_type="photo")
    return H.witnessed(live(spark, sf_dir), *archive(spark, sf_dir, "parts", "messages"), spec).select("chunk_id")


@query(f"{ARCHIVE}, {LIVE_SQL}, {WITNESS_SQL} SELECT chunk_id FROM eligible")
def fil08_hide_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.witnessed(live(spark, sf_dir), *archive(spark, sf_dir, "parts", "messages"), SPEC).select("chunk_id")


@query(f"{ARCHIVE}, {LIVE_SQL}, {WITNESS_SQL} SELECT CAST(count(*) AS BIGINT) AS n, min(day) AS first_day, max(day) AS last_day, CASE WHEN min(chat_id) = max(chat_id) THEN min(chat_id) END AS chat_id FROM eligible")
def fil11_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.bounds(H.witnessed(live(spark, sf_dir), *archive(spark, sf_dir, "parts", "messages"), SPEC))


FIRST_SQL = "firsts AS (SELECT p.chat_id, p.message_id, arg_min(p.chunk_id, (p.number, p.chunk_id)) AS chunk_id FROM parts p SEMI JOIN live USING (chunk_id) GROUP BY 1, 2)"


@query(f"{ARCHIVE}, {LIVE_SQL}, {FIRST_SQL} SELECT m.chat_id, m.message_id, f.chunk_id FROM messages m LEFT JOIN firsts f USING (chat_id, message_id)")
def join09_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, parts = archive(spark, sf_dir, "messages", "parts")
    return m.select(*KEY).join(H.first_chunks(parts, live(spark, sf_dir)), KEY, "left")


@query(f"""{ARCHIVE}, titles AS (SELECT chat_id, min(author) AS title FROM messages GROUP BY chat_id)
SELECT w.chat_id, w.day, w.stage, t.title, s.dense_generation < s.target_generation AS behind FROM work w JOIN segments s ON s.chat_id = w.chat_id AND s.day = w.day AND s.target_generation = w.generation JOIN titles t ON t.chat_id = w.chat_id WHERE w.state IN ('pending', 'failed')""")
def join12_due_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that is due, with its segment's state and its chat."""
    work, segments, m = archive(spark, sf_dir, "work", "segments", "messages")
    return G.due(work, segments, m.groupBy("chat_id").agg(F.min("author").alias("title")))


@query(f"{ARCHIVE} SELECT chat_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (chunk_generation = target_generation AND dense_generation = target_generation) AS BIGINT) AS ready FROM segments GROUP BY chat_id")
def agg07_segment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.coverage_by_chat(derived(spark, sf_dir, "segments"))


@query(f"{ARCHIVE}, c AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (chunk_generation = target_generation AND dense_generation = target_generation) AS BIGINT) AS ready FROM segments) SELECT *, CASE WHEN ready < total THEN concat('meaning covers ', ready, ' of ', total, ' segments') END AS warning FROM c")
def ret13_coverage_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.coverage(derived(spark, sf_dir, "segments"))


@query(f"{ARCHIVE} SELECT state, stage, CAST(count(*) AS BIGINT) AS n FROM work GROUP BY state, stage")
def agg08_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "work").groupBy("state", "stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{ARCHIVE}, c AS (SELECT chat_id, day, count(*) AS n, sum(n_tokens) AS tokens FROM chunks GROUP BY 1, 2), o AS (SELECT chat_id, day, count(DISTINCT message_id) AS n FROM parts WHERE role <> 'borrowed_context' GROUP BY 1, 2),
m AS (SELECT chat_id, strftime(make_timestamp(CAST(timestamp AS BIGINT) * 1000000), '%Y-%m-%d') AS day, count(*) AS n FROM messages GROUP BY 1, 2)
SELECT m.chat_id, m.day, CAST(coalesce(c.n, 0) AS BIGINT) AS n_chunks, CAST(coalesce(c.tokens, 0) AS BIGINT) AS tokens, CAST(m.n AS BIGINT) AS source, CAST(m.n - coalesce(o.n, 0) AS BIGINT) AS skipped FROM m LEFT JOIN c USING (chat_id, day) LEFT JOIN o USING (chat_id, day)""")
def agg10_chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunk_totals(*archive(spark, sf_dir, "messages", "chunks", "parts"))


LEXICAL_SQL = f"""{bm25_sql(["er", "th"])}, lexical AS (SELECT s.chat_id, s.message_id, row_number() OVER (ORDER BY s.score, s.chat_id, s.message_id) AS rank FROM scored s JOIN fit USING (chat_id, message_id) ORDER BY rank LIMIT 100)"""
KEYS_SQL = f"""{FIRST_SQL}, lexical_keys AS (SELECT l.chat_id, l.message_id, l.rank, CASE WHEN f.chunk_id IS NOT NULL AND row_number() OVER (PARTITION BY f.chunk_id ORDER BY l.rank) = 1 THEN f.chunk_id ELSE concat('message:', l.chat_id, ':', l.message_id) END AS key
 FROM lexical l LEFT JOIN firsts f USING (chat_id, message_id))"""
DENSE_SQL = f"""dense AS (SELECT chunk_id AS key, row_number() OVER (ORDER BY distance, chunk_id DESC) AS rank FROM (SELECT chunk_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {GOAL_SQL}) AS distance FROM eligible JOIN embeddings USING (vec_id)) ORDER BY rank LIMIT 100)"""
FUSED_SQL = """votes AS (SELECT key, 1.0::DOUBLE / (60 + rank) AS vote, 'words' AS branch FROM lexical_keys UNION ALL SELECT key, 1.0::DOUBLE / (60 + rank), 'meaning' FROM dense),
fused AS (SELECT key, sum(vote) AS score, string_agg(branch, ',' ORDER BY CASE branch WHEN 'words' THEN 0 ELSE 1 END) AS matched_by FROM votes GROUP BY key)"""
ANCHOR_SQL = f"""chosen AS (SELECT p.chunk_id AS key, arg_min({{'chat_id': m.chat_id, 'message_id': m.message_id}}, (NOT list_has_any({words_sql("m.text")}, ['er', 'th']), p.role <> 'core', p.ordinal)) AS m
 FROM parts p JOIN fit m ON m.chat_id = p.chat_id AND m.message_id = p.message_id WHERE p.role <> 'borrowed_context' GROUP BY 1),
anchored AS (SELECT f.*, coalesce(l.chat_id, c.m.chat_id) AS chat_id, coalesce(l.message_id, c.m.message_id) AS message_id FROM fused f LEFT JOIN lexical_keys l USING (key) LEFT JOIN chosen c USING (key)),
shown AS (SELECT * FROM anchored WHERE message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chat_id, message_id ORDER BY score DESC, key) = 1)"""
HYBRID_SQL = f"{ARCHIVE}, {LIVE_SQL}, {WITNESS_SQL}, {LEXICAL_SQL}, {KEYS_SQL}, {DENSE_SQL}, {FUSED_SQL}, {ANCHOR_SQL}"


@query(f"{ARCHIVE}, {LIVE_SQL}, {WITNESS_SQL}, {LEXICAL_SQL} SELECT chat_id, message_id, CAST(rank AS BIGINT) AS rank FROM lexical")
def topk02_lexical_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.lexical_branch(messages(spark, sf_dir), SPEC, 100)
    return found.select(*KEY, F.col("rank").cast("long").alias("rank"))


@query(f"{ARCHIVE}, {LIVE_SQL}, {WITNESS_SQL}, {LEXICAL_SQL}, {KEYS_SQL} SELECT key, chat_id, message_id FROM lexical_keys")
def ret10_lexical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = H.lexical_branch(messages(spark, sf_dir), SPEC, 100)
    return H.lexical_keys(hits, derived(spark, sf_dir, "parts"), live(spark, sf_dir)).select("key", *KEY)


def parts_of_search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m, parts = archive(spark, sf_dir, "messages", "parts")
    lexical = H.lexical_keys(H.lexical_branch(m, SPEC, 100), parts, live(spark, sf_dir))
    dense = H.dense_branch(H.witnessed(live(spark, sf_dir), parts, m, SPEC), vectors(spark, sf_dir), GOAL, 100)
    return lexical, H.R.fused({"words": (lexical, 1.0), "meaning": (dense, 1.0)}, ["key"])


@query(f"{HYBRID_SQL} SELECT key, round(score, 9) AS score, matched_by, CAST(row_number() OVER (ORDER BY score DESC, key) AS BIGINT) AS place FROM fused")
def topk04_fused_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fused keys in their order: by score, then key."""
    keys = H.R.ranked(parts_of_search(spark, sf_dir)[1], F.col("score").desc(), F.col("key"), name="place")
    return keys.select("key", F.round("score", 9).alias("score"), "matched_by", F.col("place").cast("long").alias("place"))


@query(f"{HYBRID_SQL} SELECT key, chat_id, message_id FROM shown")
def ret11_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, keys = parts_of_search(spark, sf_dir)
    m, parts = archive(spark, sf_dir, "messages", "parts")
    return H.anchors(keys, lexical, parts, m, SPEC).select("key", *KEY)


@query(f"""{HYBRID_SQL}, spans AS (SELECT chunk_id AS key, list((message_id, chars) ORDER BY ordinal, message_id) AS spans FROM parts WHERE role <> 'borrowed_context' GROUP BY 1),
j AS (SELECT s.key, s.chat_id, s.message_id, s.matched_by, length(m.text) AS chars, coalesce(p.spans, []) AS spans FROM shown s LEFT JOIN spans p USING (key) JOIN messages m ON m.chat_id = s.chat_id AND m.message_id = s.message_id)
SELECT key, array_to_string(list_transform(CASE WHEN (contains(matched_by, 'words') OR len(spans) = 0) AND NOT list_contains(spans, (message_id, chars)) THEN list_append(spans, (message_id, chars)) ELSE spans END, lambda x: concat(x[1], ':0-', x[2])), ' ') AS spans FROM j""")
def ret12_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that matched, in the order of the chunk."""
    lexical, keys = parts_of_search(spark, sf_dir)
    m, parts = archive(spark, sf_dir, "messages", "parts")
    found = H.evidence(H.anchors(keys, lexical, parts, m, SPEC), parts, m)
    return found.select("key", F.array_join(F.transform("spans", lambda x: F.concat(x["message_id"].cast("string"), F.lit(":0-"), x["end"].cast("string"))), " ").alias("spans"))


@query(f"{HYBRID_SQL} SELECT key, round(score, 9) AS score, matched_by, chat_id, message_id, 'hybrid' AS mode FROM shown ORDER BY shown.score DESC, key LIMIT 20")
def ret13_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, chunks, parts, segments = written(spark, sf_dir, "messages", "chunks", "parts", "segments")
    return H.hybrid(m, chunks, parts, segments, vectors(spark, sf_dir), SPEC, GOAL).withColumn("score", F.round("score", 9))


@query(f"{HYBRID_SQL.replace(FUSED_SQL, FUSED_SQL.replace(chr(39) + 'words' + chr(39) + ' AS branch FROM lexical_keys', chr(39) + 'words' + chr(39) + ' AS branch FROM lexical_keys WHERE false')).replace('LEFT JOIN lexical_keys l USING (key)', 'LEFT JOIN (FROM lexical_keys WHERE false) l USING (key)')} SELECT key, round(score, 9) AS score, matched_by, chat_id, message_id, 'meaning' AS mode FROM shown ORDER BY shown.score DESC, key LIMIT 20")
def ret13_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, chunks, parts, segments = written(spark, sf_dir, "messages", "chunks", "parts", "segments")
    spec = SearchSpec(**(vars(SPEC) | {"mode": "meaning"}))
    return H.hybrid(m, chunks, parts, segments, vectors(spark, sf_dir), spec, GOAL).withColumn("score", F.round("score", 9))


@query(f"""{ARCHIVE}, fit AS (SELECT * FROM messages WHERE {SPEC_SQL}), {bm25_sql(["er", "th"])},
r AS (SELECT s.*, row_number() OVER (ORDER BY s.score, m.timestamp, s.message_id, s.chat_id) AS rank FROM scored s JOIN fit m USING (chat_id, message_id))
SELECT concat('message:', chat_id, ':', message_id) AS key, round(1.0::DOUBLE / (60 + rank), 9) AS score, 'words' AS matched_by, chat_id, message_id, 'words' AS mode FROM r WHERE rank <= 20""")
def ret13_words_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a query vector the hybrid mode goes by words."""
    m, chunks, parts, segments = archive(spark, sf_dir, "messages", "chunks", "parts", "segments")
    return H.hybrid(m, chunks, parts, segments, vectors(spark, sf_dir), SPEC, None).withColumn("score", F.round("score", 9))


CHANGED_SQL = "changed AS (SELECT chat_id, message_id, timestamp FROM messages WHERE edited IS NOT NULL AND has_photo = 1)"
RANGES_SQL = "ranges AS (SELECT chat_id, day, min(timestamp) - 120 AS since, max(timestamp) + 120 AS until FROM owned JOIN messages USING (chat_id, message_id) GROUP BY 1, 2)"


@query(f"""{ARCHIVE}, {CHANGED_SQL}, {RANGES_SQL}
SELECT p.chat_id, p.day FROM parts p JOIN changed c USING (chat_id, message_id) UNION SELECT r.chat_id, r.day FROM ranges r JOIN changed c ON c.chat_id = r.chat_id AND c.timestamp >= r.since AND c.timestamp < r.until""")
def str07_dependent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to rebuild after a change: those that hold or borrow the message, and those whose neighbourhood it falls into."""
    m, parts, own = archive(spark, sf_dir, "messages", "parts", "owned")
    changed = m.where("edited is not null and has_photo = 1").select(*KEY, "timestamp")
    times = own.select(*KEY, "day").join(m.select(*KEY, "timestamp"), KEY)
    ranges = times.groupBy("chat_id", "day").agg((F.min("timestamp") - 120).alias("since"), (F.max("timestamp") + 120).alias("until"))
    return G.dependent_days(changed, parts, ranges)


@query(f"""{ARCHIVE}, {CHANGED_SQL}, dirty AS (SELECT DISTINCT p.chat_id, p.day FROM parts p JOIN changed c USING (chat_id, message_id)),
v AS (SELECT c.chunk_id, c.chat_id, c.day, c.generation, d.chat_id IS NOT NULL AS rebuilt FROM chunks c LEFT JOIN dirty d USING (chat_id, day))
SELECT chunk_id, generation + CASE WHEN rebuilt THEN 1 ELSE 0 END AS generation, rebuilt FROM v""")
def str08_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of changed segments in a new generation, all others as they were."""
    m, parts, chunks = archive(spark, sf_dir, "messages", "parts", "chunks")
    changed = m.where("edited is not null and has_photo = 1").select(*KEY)
    dirty = parts.join(changed, KEY, "left_semi").select("chat_id", "day").distinct()
    return G.rebuilt(chunks, dirty).select("chunk_id", "generation", "rebuilt")


@query(f"{ARCHIVE} SELECT c.chunk_id AS id FROM chunks c JOIN segments s USING (chat_id, day) WHERE c.generation < s.target_generation AND s.dense_generation = s.target_generation")
def str09_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that a published generation has superseded: they may go."""
    return G.superseded(*archive(spark, sf_dir, "chunks", "segments"))


@query(f"""{ARCHIVE}, aims AS (SELECT chat_id, day, target_generation + 1 AS generation, chat_id % 3 = 1 AS moved FROM segments)
SELECT chat_id, day, generation, CASE WHEN moved THEN 'superseded' ELSE 'published' END AS state, CAST(CASE WHEN moved THEN 0 ELSE (SELECT count(*) FROM owned o WHERE o.chat_id = a.chat_id AND o.day = a.day) END AS BIGINT) AS n FROM aims a""")
def str08_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments built aside and published one by one: those whose target moved on while they were built are not."""
    segments, owned = archive(spark, sf_dir, "segments", "owned")
    root = scratch(spark, "segments")
    targets, chunks = Store(spark, f"{root}/targets"), PartitionedStore(spark, f"{root}/chunks", B.SEGMENT, BUCKETS)
    aims = segments.select(*B.SEGMENT, (F.col("target_generation") + 1).alias("target_generation"))
    targets.publish(aims)
    parts = owned.select(*B.SEGMENT, "message_id")
    chunks.publish(parts.join(segments, B.SEGMENT).where("message_id % 2 = 0").select(*parts.columns, F.col("target_generation").alias("generation")))

    def make(due: DataFrame) -> DataFrame:
        # while chunks are made, a third of the chats changes again
        targets.publish(aims.withColumn("target_generation", F.col("target_generation") + F.when(F.col("chat_id") % 3 == 1, 1).otherwise(0)))
        return parts.join(due, B.SEGMENT)

    judged = B.build(targets, chunks, make)
    held = chunks.read().groupBy(*B.SEGMENT, "generation").agg(F.count(F.lit(1)).alias("n"))
    return judged.join(held, [*B.SEGMENT, "generation"], "left").select(*judged.columns, F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""{ARCHIVE}, {bm25_sql(["er", "th"], keys="chat_id, message_id")} SELECT chat_id, message_id, round(score, 6) AS score, true AS changed, CAST(0 AS BIGINT) AS revision FROM scored""")
def ret20_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over the revision at which it began, while two others are published and old ones cleaned away; it says that something changed."""
    m = messages(spark, sf_dir).select(*KEY, "text")
    store = Store(spark, scratch(spark, "revisions"))
    store.publish(m)

    def search(frames: dict[str, DataFrame], eligible: DataFrame) -> DataFrame:
        for k in (2, 3):
            store.publish(m.where(F.col("message_id") % k == 0))
        store.clean(1)
        return R.bm25(eligible, "er th").select(*KEY, F.round("score", 6).alias("score"))

    found = B.pinned_search({"messages": store}, lambda frames: frames["messages"], search)
    return found.rows.withColumns({"changed": F.lit(bool(found.changed)), "revision": F.lit(found.revisions["messages"]).cast("long")})
