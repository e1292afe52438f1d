"""Windows, sessions, interval unions, quantiles and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import chunking as C
from palimpsest.operators import sequences as S
from palimpsest.plans.noise import CLASS_SQL
from palimpsest.plans.registry import WITH, day_sql, query
from palimpsest.sources.views import ARCHIVE_SQL, FEED_SQL, MESSAGES_SQL, feed, messages, table

KEY = ["chat_id", "message_id"]


@query(f"""WITH {FEED_SQL}, l AS (SELECT chat_id, message_id, ts, lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, message_id) AS was FROM feed)
SELECT chat_id, message_id, CAST(sum(CASE WHEN was IS NULL OR {day_sql("ts")} <> {day_sql("was")} OR ts - was > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY ts, message_id) AS BIGINT) AS episode FROM l""")
def win03_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feed(spark, sf_dir).withColumnRenamed("ts", "timestamp").withColumn("deleted", F.lit(0))
    return S.episodes(f).select(*KEY, "episode")


@query(f"""{WITH}, l AS (SELECT chat_id, message_id, timestamp, deleted, lag(timestamp) OVER (PARTITION BY chat_id ORDER BY timestamp, message_id) AS was, lag(deleted) OVER (PARTITION BY chat_id ORDER BY timestamp, message_id) AS was_deleted FROM messages)
SELECT chat_id, message_id, CAST(sum(CASE WHEN was IS NULL OR {day_sql("timestamp")} <> {day_sql("was")} OR deleted <> was_deleted OR timestamp - was > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY timestamp, message_id) AS BIGINT) AS episode FROM l""")
def win03_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of messages, ended by a midnight, a gap or a change between live and deleted ones; service rows move the clock."""
    return S.episodes(messages(spark, sf_dir)).select(*KEY, "episode")


@query(f"WITH {FEED_SQL} SELECT chat_id, message_id FROM feed QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, message_id DESC) <= 24")
def win08_last_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keep_last(feed(spark, sf_dir), ["chat_id"], [F.col("ts").desc(), F.col("message_id").desc()], 24).select(*KEY)


@query(f"""WITH {FEED_SQL}, w AS (SELECT kind, message_id, value, pow(0.5, (row_number() OVER (PARTITION BY kind ORDER BY ts DESC, message_id DESC) - 1) / 6.0) AS w FROM feed),
c AS (SELECT kind, value, sum(w) OVER (PARTITION BY kind ORDER BY value, message_id ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY kind) AS total FROM w)
SELECT kind, min(value) AS quantile FROM c WHERE cum >= 0.5 * total - 1e-12 GROUP BY kind""")
def agg18_decayed_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.decayed_quantile(feed(spark, sf_dir), ["kind"], "value", "ts", "message_id", 0.5)


@query(f"""WITH {FEED_SQL}, s AS (SELECT chat_id, message_id, ts AS a, ts + CAST(floor(value) AS BIGINT) * 30 AS b FROM feed),
m AS (SELECT *, max(b) OVER (PARTITION BY chat_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT chat_id, CAST(sum(greatest(0, b - greatest(a, coalesce(before, a)))) AS BIGINT) AS covered, CAST(count(*) AS BIGINT) AS spans FROM m GROUP BY chat_id""")
def agg19_covered_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = feed(spark, sf_dir).select("chat_id", F.col("ts").alias("a"), (F.col("ts") + F.floor("value") * 30).alias("b"))
    return S.covered_time(spans, ["chat_id"], "a", "b")


@query()
def chk03_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the whole archive, packed to the message and token budgets with borrowed context."""
    m = messages(spark, sf_dir).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    found = C.chunks(m)
    return found.select("chunk_id", "chat_id", "day", "ordinal", "n_tokens", F.transform("parts", lambda x: x["message_id"]).cast("string").alias("messages"))


@query(f"""WITH {ARCHIVE_SQL}, {CLASS_SQL} SELECT chat_id, {day_sql("timestamp")} AS day, CAST(count(*) AS BIGINT) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM roled WHERE role = 'core' GROUP BY 1, 2""")
def chk03_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day the core messages that chunks own, and their characters: parts of long ones overlap, and are counted once."""
    m = messages(spark, sf_dir).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    part = C.chunks(m).select("chat_id", "day", F.explode("parts").alias("p")).where("p.role = 'core'").select("chat_id", "day", "p.*").distinct()
    before = F.max("end").over(W.partitionBy("chat_id", "message_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    fresh = part.withColumn("_n", F.col("end") - F.greatest("start", F.coalesce(before, F.col("start"))))
    return fresh.groupBy("chat_id", "day").agg(F.countDistinct("message_id").alias("messages"), F.sum(F.greatest("_n", F.lit(0))).alias("chars"))


@query(f"""WITH {MESSAGES_SQL}, held AS (SELECT chat_id, {day_sql("timestamp")} AS day, message_id FROM messages WHERE kind = 'message' AND (trim(text, ' ') <> '' OR has_photo = 1)) SELECT chat_id, day, CAST(count(*) AS BIGINT) AS messages FROM held GROUP BY 1, 2""")
def chk02_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day the messages that the plain windows of the first policy hold."""
    m = messages(spark, sf_dir).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    found = C.chunks(m, C.ChunkPolicy(version=C.WINDOWS))
    return found.select("chat_id", "day", F.explode("parts.message_id").alias("message_id")).groupBy("chat_id", "day").agg(F.countDistinct("message_id").alias("messages"))


@query("""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) SELECT doc_id, CAST(ceil(n / 479.0) AS BIGINT) AS parts, CAST(n + ceil(n / 479.0) AS BIGINT) AS tokens FROM t WHERE n > 0""")
def chk09_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts in parts of 480 tokens, one of which is the prefix."""
    found = C.text_chunks(table(spark, sf_dir, "documents"), "doc_id")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("tokens"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST((l_linenumber - 1) // 3 AS BIGINT) AS batch FROM lineitem")
def win10_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.floor((F.col("l_linenumber") - 1) / 3).alias("batch"))
