"""Queries that run as streams over the change feed and end in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.encode import encoded
from palimpsest.plans.registry import query
from palimpsest.sources.exports import scratch
from palimpsest.sources.views import table
from palimpsest.streaming import keyed
from palimpsest.streaming.feed import latest_by_key, received

LAST_SQL = "last AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'delete' ELSE 'upsert' END AS op, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id)"


@query(f"WITH {LAST_SQL} SELECT user_id, event_id, ts, n FROM last")
def str01_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of every key, from micro-batches that are merged one by one."""
    return latest_by_key(spark, sf_dir).select("user_id", "event_id", "ts", "n")


@query(f"WITH {LAST_SQL} SELECT user_id, event_id, ts, n FROM last WHERE op = 'upsert'")
def str04_live_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose last change isn't a deletion."""
    return latest_by_key(spark, sf_dir).where("op = 'upsert'").select("user_id", "event_id", "ts", "n")


@query("SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events")
def src07_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return received(table(spark, sf_dir, "events")).select("event_id", "user_id", "op")


@query("SELECT vec_id, CASE WHEN label = 3 THEN NULL ELSE round(list_aggregate(embedding, 'sum'), 3) END AS encoded, CASE WHEN label = 3 THEN 'no encoder for this label' END AS failure FROM embeddings")
def str11_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that encodes whole batches: rows that fail carry why, and don't stop the others."""
    def total(vectors: list, labels: list) -> list:
        if 3 in labels:
            raise ValueError("no encoder for this label")
        return [float(sum(v)) for v in vectors]

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return encoded(rows, ["embedding", "label"], total, "encoded", "double").select("vec_id", F.round("encoded", 3).alias("encoded"), "failure")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events),
t AS (SELECT *, newest IS NULL OR ts > newest AS newer, min(CASE WHEN event_type = 'error' AND (newest IS NULL OR ts > newest) THEN event_id END) OVER (PARTITION BY user_id) AS gone FROM e)
SELECT event_id, CASE WHEN event_id > gone THEN 'rejected' WHEN newer THEN 'accepted' WHEN ts = newest THEN 'repeated' ELSE 'late' END AS fate FROM t""")
def str03_stream_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every revision, by a stream that holds the newest one of each key: a deletion is final."""
    schema = table(spark, sf_dir, "events").schema
    found = keyed.fates(spark, f"{sf_dir}/events.parque[t]", schema, scratch(spark, "fates"))
    return found.select(F.col("arrival").alias("event_id"), "fate")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
b AS (SELECT user_id, k, ts AS since, ts AS last, 1 AS burst FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.ts > least(b.since + INTERVAL 10 HOUR, b.last + INTERVAL 1 HOUR) THEN e.ts ELSE b.since END, e.ts, b.burst + CASE WHEN e.ts > least(b.since + INTERVAL 10 HOUR, b.last + INTERVAL 1 HOUR) THEN 1 ELSE 0 END
 FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1),
g AS (SELECT user_id, burst, min(since) AS since, least(min(since) + INTERVAL 10 HOUR, max(last) + INTERVAL 1 HOUR) AS due, CAST(count(*) AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id ORDER BY burst DESC) AS rn FROM b GROUP BY 1, 2)
SELECT user_id AS chat_id, epoch_us(since) AS since, epoch_us(due) AS due, n FROM g WHERE rn > 1 OR due <= (SELECT max(ts) FROM events)""")
def str05_stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of changes as timers close them: after a quiet hour, ten hours after their first change at the latest. Those still open at the stream's end stay in its state."""
    schema = table(spark, sf_dir, "events").schema
    found = keyed.bursts(spark, f"{sf_dir}/events.parque[t]", schema, scratch(spark, "bursts"), 3_600_000, 36_000_000)
    return found.select(F.col("key").alias("chat_id"), F.unix_micros("since").alias("since"), F.unix_micros("due").alias("due"), "n")
