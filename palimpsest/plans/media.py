"""Stored files and recognised texts: documents play the texts, embeddings the image vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import encode as E
from palimpsest.operators import media as M
from palimpsest.plans.registry import bm25_sql, query
from palimpsest.plans.retrieval import GOAL, GOAL_SQL
from palimpsest.plans.spec import SearchSpec
from palimpsest.sources.views import ARCHIVE_SQL, EPOCH, derived, messages, table

KEY = ["chat_id", "message_id"]
ARCHIVE = f"WITH {ARCHIVE_SQL}"
SPEC = SearchSpec(query="er", author_ids=("user", "assistant"), exclude_deleted=True)
FIT_SQL = "fit AS (SELECT * FROM messages WHERE author_id IN ('user', 'assistant') AND deleted = 0)"
TEXTS_SQL = """texts AS (SELECT d.doc_id AS blob_id, d.text, CAST(length(d.text) AS BIGINT) AS chars, CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'done' END AS state,
 CAST(1 + d.doc_id % 4 AS BIGINT) AS attempts, CASE WHEN d.doc_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS version FROM documents d JOIN labels l USING (doc_id))"""
READY_SQL = "photos AS (SELECT * FROM refs WHERE status = 'ready' AND ref_kind = 'photo')"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts: a document with a label has a row; toxic ones failed."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("blob_id"), "text", F.length("text").cast("long").alias("chars"), F.when(F.col("toxic") == 1, "failed").otherwise("done").alias("state"), (1 + F.col("doc_id") % 4).alias("attempts"), F.when(F.col("doc_id") % 5 == 0, "v1").otherwise("v2").alias("version"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("blob_id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "image").otherwise("ocr").alias("kind"))


@query(f"{ARCHIVE}, {READY_SQL}, {FIT_SQL} SELECT doc_id AS blob_id FROM documents d WHERE EXISTS (SELECT 1 FROM photos p JOIN fit USING (chat_id, message_id) WHERE p.blob_id = d.doc_id)")
def fil09_media_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"))
    return M.witnessed(blobs, derived(spark, sf_dir, "refs"), messages(spark, sf_dir), SPEC)


@query(f"{ARCHIVE}, {READY_SQL}, {TEXTS_SQL} SELECT DISTINCT blob_id FROM photos WHERE blob_id NOT IN (SELECT blob_id FROM texts WHERE state = 'done' OR (state = 'failed' AND attempts >= 3))")
def fil13_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pending(derived(spark, sf_dir, "refs"), texts(spark, sf_dir))


@query(f"""{ARCHIVE}, {TEXTS_SQL}, b AS (SELECT r.*, coalesce(t.state, 'pending') AS state, t.chars, t.attempts FROM refs r LEFT JOIN texts t USING (blob_id)),
o AS (SELECT state, blob_id, any_value(chars) AS chars, any_value(attempts) AS attempts FROM b GROUP BY 1, 2)
SELECT state, (SELECT CAST(count(*) AS BIGINT) FROM o WHERE o.state = b.state) AS blobs, CAST(count(*) AS BIGINT) AS refs, CAST(count(DISTINCT (chat_id, message_id)) FILTER (ref_kind = 'photo') AS BIGINT) AS photo_messages,
 (SELECT CAST(coalesce(sum(chars), 0) AS BIGINT) FROM o WHERE o.state = b.state) AS chars, (SELECT CAST(coalesce(sum(greatest(attempts - 1, 0)), 0) AS BIGINT) FROM o WHERE o.state = b.state) AS retries FROM b GROUP BY state""")
def agg06_media_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.status(derived(spark, sf_dir, "refs"), texts(spark, sf_dir))


@query(f"""{ARCHIVE}, {READY_SQL}, {TEXTS_SQL}, b AS (SELECT DISTINCT blob_id FROM photos), j AS (SELECT b.blob_id, t.state, e.vec_id FROM b LEFT JOIN texts t USING (blob_id) LEFT JOIN embeddings e ON e.vec_id = b.blob_id)
SELECT CAST(count(*) AS BIGINT) AS blobs, CAST(count(*) FILTER (state = 'done') AS BIGINT) AS with_text, CAST(count(*) FILTER (state = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (vec_id IS NOT NULL) AS BIGINT) AS with_vector,
 CAST(count(*) FILTER (state IS NULL AND vec_id IS NULL) AS BIGINT) AS open FROM j""")
def ret16_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a media search covers."""
    return M.coverage(derived(spark, sf_dir, "refs"), texts(spark, sf_dir), vectors(spark, sf_dir))


SEARCH_SQL = f"""{READY_SQL}, {FIT_SQL}, {TEXTS_SQL}, done AS (SELECT * FROM texts WHERE state = 'done'), shown AS (SELECT blob_id, chat_id, message_id FROM photos JOIN fit USING (chat_id, message_id)),
{bm25_sql(["er"], "done", "blob_id")},
w AS (SELECT blob_id, row_number() OVER (ORDER BY score, blob_id) AS rank, 'words' AS channel, NULL::DOUBLE AS similarity FROM scored WHERE blob_id IN (SELECT blob_id FROM shown) ORDER BY rank LIMIT 100),
n AS (SELECT blob_id, row_number() OVER (ORDER BY distance, blob_id DESC) AS rank, 'vectors' AS channel, 1 - distance AS similarity FROM (SELECT vec_id AS blob_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {GOAL_SQL}) AS distance FROM embeddings WHERE vec_id IN (SELECT blob_id FROM shown)) ORDER BY rank LIMIT 100),
v AS (SELECT chat_id, message_id, channel, min(rank) AS rank, max(similarity) AS similarity FROM shown JOIN (FROM w UNION ALL FROM n) USING (blob_id) GROUP BY 1, 2, 3),
hits AS (SELECT chat_id, message_id, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(channel, ',' ORDER BY channel) AS channels, greatest(-1.0, least(1.0, max(similarity))) AS similarity FROM v GROUP BY 1, 2 ORDER BY score DESC, chat_id, message_id LIMIT 100)"""


@query(f"{ARCHIVE}, {SEARCH_SQL} SELECT chat_id, message_id, round(score, 9) AS score, channels, round(similarity, 6) AS similarity FROM hits")
def ret14_media_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.media_search(derived(spark, sf_dir, "refs"), texts(spark, sf_dir), vectors(spark, sf_dir), messages(spark, sf_dir), SPEC, GOAL)
    return found.withColumns({"score": F.round("score", 9), "similarity": F.round("similarity", 6)})


@query(f"""{ARCHIVE}, {SEARCH_SQL}, {bm25_sql(["er"], name="texted")},
t AS (SELECT s.chat_id, s.message_id, row_number() OVER (ORDER BY -s.score DESC, s.chat_id, s.message_id) AS rank FROM (SELECT texted.* FROM texted JOIN fit USING (chat_id, message_id) ORDER BY texted.score, fit.timestamp, texted.message_id, texted.chat_id LIMIT 100) s),
m AS (SELECT chat_id, message_id, row_number() OVER (ORDER BY score DESC, chat_id, message_id) AS rank, similarity FROM hits),
u AS (SELECT chat_id, message_id, 1.0::DOUBLE / (60 + rank) AS vote, 'text' AS branch, NULL::DOUBLE AS similarity FROM t UNION ALL SELECT chat_id, message_id, 1.0::DOUBLE / (60 + rank), 'images', similarity FROM m),
f AS (SELECT chat_id, message_id, sum(vote) AS score, string_agg(branch, ',' ORDER BY branch DESC) AS matched_by, max(similarity) AS similarity FROM u GROUP BY 1, 2 ORDER BY score DESC, chat_id, message_id LIMIT 20)
SELECT chat_id, message_id, round(score, 9) AS score, matched_by, round(similarity, 6) AS similarity FROM f""")
def ret15_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and images fused by rank."""
    m = messages(spark, sf_dir)
    images = M.media_search(derived(spark, sf_dir, "refs"), texts(spark, sf_dir), vectors(spark, sf_dir), m, SPEC, GOAL)
    words = M.R.search(m, SPEC, 100).select(*KEY, (-F.col("score")).alias("score"), F.lit(None).cast("double").alias("similarity"))
    found = M.unified({"text": words, "images": images})
    return found.withColumns({"score": F.round("score", 9), "similarity": F.round("similarity", 6)})


MORE_REFS_SQL = "many AS (SELECT * FROM refs UNION ALL SELECT chat_id, message_id, blob_id + 1, ref_kind, 'ready', ref_id + 1000000 FROM refs WHERE message_id % 2 = 0)"


def many_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = derived(spark, sf_dir, "refs")
    return refs.unionByName(refs.where("message_id % 2 = 0").withColumns({"blob_id": F.col("blob_id") + 1, "status": F.lit("ready"), "ref_id": F.col("ref_id") + 1000000}))


@query(f"""{ARCHIVE}, {MORE_REFS_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id, ref_kind ORDER BY status = 'ready' DESC, ref_id DESC) AS rn FROM many)
SELECT chat_id, message_id, string_agg(concat(ref_kind, ':', blob_id, ':', status), ',' ORDER BY ref_kind) AS files FROM one WHERE rn = 1 GROUP BY 1, 2""")
def ret19_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.of_messages(many_refs(spark, sf_dir))
    return found.select(*KEY, F.array_join(F.transform("files", lambda x: F.concat_ws(":", x["ref_kind"], x["blob_id"].cast("string"), x["status"])), ",").alias("files"))


@query(f"{ARCHIVE}, {READY_SQL}, {TEXTS_SQL} SELECT b.blob_id, coalesce(t.state, 'pending') AS state FROM (SELECT DISTINCT blob_id FROM photos) b LEFT JOIN (FROM texts WHERE version = 'v2') t USING (blob_id)")
def str10_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be recognised once version v2 is activated."""
    return M.queue(derived(spark, sf_dir, "refs"), texts(spark, sf_dir), "v2")


@query(f"{ARCHIVE} SELECT doc_id AS blob_id FROM documents WHERE {EPOCH} + doc_id * 60 < {EPOCH + 86400} AND doc_id NOT IN (SELECT blob_id FROM refs)")
def str13_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), (F.lit(EPOCH) + F.col("doc_id") * 60).alias("stored_at"))
    return M.orphans(blobs, derived(spark, sf_dir, "refs"), EPOCH + 86400).select("blob_id")


FILES_SQL = """files AS (SELECT page_id, CASE page_id % 7 WHEN 6 THEN concat('../', page_id) WHEN 5 THEN concat('/', page_id) ELSE concat('photos/', page_id) END AS path, CASE WHEN page_id % 5 = 1 THEN NULL WHEN page_id % 5 = 2 THEN 'old' ELSE md5(html) END AS digest FROM pages),
found AS (SELECT CASE page_id % 7 WHEN 6 THEN concat('../', page_id) WHEN 5 THEN concat('/', page_id) ELSE concat('photos/', page_id) END AS path, md5(html) AS digest, length(html) AS size, contains(html, '</') AND page_id % 11 <> 4 AS opens FROM pages WHERE page_id % 4 <> 3)"""


@query(f"""WITH {FILES_SQL} SELECT f.page_id, CASE WHEN f.page_id % 7 IN (5, 6) THEN 'unsafe' WHEN g.path IS NULL THEN 'missing' WHEN NOT g.opens THEN 'corrupt' WHEN f.digest IS NULL THEN 'unverified' WHEN f.digest = g.digest THEN 'ready' ELSE 'changed' END AS status FROM files f LEFT JOIN found g USING (path)""")
def src19_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded files against those that are there."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    path = F.when(k % 7 == 6, F.concat(F.lit("../"), k)).when(k % 7 == 5, F.concat(F.lit("/"), k)).otherwise(F.concat(F.lit("photos/"), k))
    digest = F.md5(F.col("html").cast("binary"))
    files = p.select("page_id", path.alias("path"), F.when(k % 5 == 1, None).when(k % 5 == 2, "old").otherwise(digest).alias("digest"))
    found = p.where("page_id % 4 <> 3").select(path.alias("path"), digest.alias("digest"), F.length("html").alias("size"), (F.col("html").contains("</") & (k % 11 != 4)).alias("opens"))
    return M.probed(files, found).select("page_id", "status")


@query(f"""{ARCHIVE}, u AS (SELECT blob_id, count(*) AS uses FROM refs GROUP BY 1), j AS (SELECT CASE WHEN label % 2 = 0 THEN 'image' ELSE 'ocr' END AS kind, uses, len(embedding) AS n FROM embeddings LEFT JOIN u ON blob_id = vec_id)
SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(4 * n) AS BIGINT) AS bytes, CAST(count(*) FILTER (uses > 1) AS BIGINT) AS shared, CAST(count(*) FILTER (uses = 1) AS BIGINT) AS exclusive, CAST(count(*) FILTER (uses IS NULL) AS BIGINT) AS unused FROM j GROUP BY kind""")
def src18_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.inventory(vectors(spark, sf_dir), derived(spark, sf_dir, "refs"))


@query("""WITH b AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS box, l_partkey % 100 AS x0, l_partkey % 100 + 20 AS x1, l_suppkey % 60 AS y0, l_suppkey % 60 + 5 + CAST(l_linenumber AS BIGINT) % 3 AS y1 FROM lineitem),
l AS (SELECT *, CASE WHEN y0 < max(y1) OVER (PARTITION BY page ORDER BY y0, y1, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM b),
g AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y0, y1, box ROWS UNBOUNDED PRECEDING) AS line FROM l)
SELECT page, box, CAST(line AS BIGINT) AS line, CAST(row_number() OVER (PARTITION BY page, line ORDER BY x0, y0, box) AS BIGINT) AS place FROM g""")
def fn29_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pages in the order in which they are read."""
    e = table(spark, sf_dir, "lineitem")
    part, supplier, number = F.col("l_partkey") % 100, F.col("l_suppkey") % 60, F.col("l_linenumber").cast("long")
    boxes = e.select(F.col("l_orderkey").alias("page"), number.alias("box"), part.alias("x0"), (part + 20).alias("x1"), supplier.alias("y0"), (supplier + 5 + number % 3).alias("y1"))
    return M.reading_order(boxes).select("page", "box", "line", "place")


@query("""WITH w AS (SELECT lang, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM documents), e AS (SELECT lang, w, range(1, len(w) + 1) AS i FROM w)
SELECT lang, CAST(sum(len(w)) AS BIGINT) AS words, CAST(sum(len(list_filter(i, lambda k: k % 127 = 5 OR k % 101 = 3))) AS BIGINT) AS errors, round(sum(len(list_filter(i, lambda k: k % 127 = 5 OR k % 101 = 3))) / sum(len(w)), 6) AS wer,
CAST(sum(len(list_filter(i, lambda k: regexp_matches(w[k], '[0-9]')))) AS BIGINT) AS controls,
round(sum(len(list_filter(i, lambda k: regexp_matches(w[k], '[0-9]') AND NOT (k % 127 = 5 OR k % 101 = 3)))) / nullif(sum(len(list_filter(i, lambda k: regexp_matches(w[k], '[0-9]')))), 0), 6) AS recall FROM e GROUP BY lang""")
def agg21_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rates and the recall of tokens with digits, of texts from which every 127th word is lost and every 101st is read as another."""
    found = table(spark, sf_dir, "documents").select("lang", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)).alias("truth"))
    placed = F.filter(F.transform("truth", lambda w, i: F.struct(F.when((i + 1) % 101 == 3, "\u0001").otherwise(w).alias("w"), (i + 1).alias("i"))), lambda x: x["i"] % 127 != 5)
    return E.recognition(found.withColumn("said", placed["w"]), "lang", "[0-9]")


MOVED_SQL = """moved AS (SELECT page_id % 40 AS source_id, page_id, concat('photos/', page_id) AS path, CASE WHEN page_id % 40 = 3 AND page_id % 5 = 3 THEN NULL WHEN page_id % 40 = 4 THEN 'old' ELSE md5(html) END AS digest, CASE WHEN page_id % 3 = 0 THEN 'missing' ELSE 'ready' END AS status, page_id % 9 <> 2 AS there FROM pages),
judged AS (SELECT *, CASE WHEN NOT there THEN 'missing' WHEN digest IS NULL THEN 'unverified' WHEN digest = 'old' THEN 'changed' ELSE 'ready' END AS now FROM moved),
sources AS (SELECT source_id, CAST(count(*) FILTER (now = 'ready') AS BIGINT) AS ready, CAST(count(*) FILTER (now = 'missing') AS BIGINT) AS missing, CAST(count(*) FILTER (now = 'changed') AS BIGINT) AS changed, CAST(count(*) FILTER (now = 'unverified') AS BIGINT) AS unverified FROM judged GROUP BY 1)"""


def moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What a move of every source's files would do; in two of them files have changed, or were never verified."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    digest, path = F.md5(F.col("html").cast("binary")), F.concat(F.lit("photos/"), k)
    refs = p.select((k % 40).alias("source_id"), "page_id", path.alias("path"), F.when((k % 40 == 3) & (k % 5 == 3), None).when(k % 40 == 4, "old").otherwise(digest).alias("digest"), F.when(k % 3 == 0, "missing").otherwise("ready").alias("status"))
    found = p.where("page_id % 9 <> 2").select(path.alias("path"), digest.alias("digest"), F.length("html").alias("size"), F.lit(True).alias("opens"))
    return M.relinked(refs, found)


@query(f"WITH {MOVED_SQL} SELECT *, changed = 0 AND unverified = 0 AS accepted FROM sources")
def src19_relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources may be moved: not those with changed or unverified files."""
    return moved(spark, sf_dir)[0]


@query(f"WITH {MOVED_SQL} SELECT page_id, now AS status FROM judged JOIN sources USING (source_id) WHERE changed = 0 AND unverified = 0 AND now <> status")
def src19_relinked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose state changes with an accepted move."""
    return moved(spark, sf_dir)[1].select("page_id", "status")


@query(f"""{ARCHIVE}, {FIT_SQL}, {bm25_sql(["er"], name="texted")}, t AS (SELECT s.chat_id, s.message_id, row_number() OVER (ORDER BY -s.score DESC, s.chat_id, s.message_id) AS rank FROM (SELECT texted.* FROM texted JOIN fit USING (chat_id, message_id) ORDER BY texted.score, fit.timestamp, texted.message_id, texted.chat_id LIMIT 100) s)
SELECT chat_id, message_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, 'text' AS matched_by, 'images' AS warnings FROM t WHERE rank <= 20""")
def ret15_best_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A modality that fails is told, and the others answer."""
    m = messages(spark, sf_dir)
    words = M.R.search(m, SPEC, 100).select(*KEY, (-F.col("score")).alias("score"), F.lit(None).cast("double").alias("similarity"))
    broken = m.select(*KEY, F.raise_error(F.lit("the image model is away")).cast("double").alias("score"), F.lit(None).cast("double").alias("similarity"))
    found = M.best_effort({"text": lambda: words, "images": lambda: broken})
    return found.select(*KEY, F.round("score", 9).alias("score"), "matched_by", F.array_join("warnings", ",").alias("warnings"))
