"""Joins and set operations over the archive's views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import chunking as C
from palimpsest.operators import sequences as S
from palimpsest.plans.registry import WITH, query
from palimpsest.sources.views import EPOCH, FEED_SQL, feed, messages, table

KEY = ["chat_id", "message_id"]


@query("""SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000""")
def join01_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.where("o_totalprice > 100000").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("""SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def join02_left_with_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every customer, those without orders too; orders are summed before they are joined."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("s"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@query("SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)")
def join03_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "quality")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49))")
def join04_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def join05_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query(f"""{WITH} SELECT m.chat_id, m.message_id, a.message_id AS parent_id, b.message_id AS grandparent_id FROM messages m
LEFT JOIN messages a ON a.chat_id = m.chat_id AND a.message_id = m.reply_to AND m.timestamp - a.timestamp <= 2592000
LEFT JOIN messages b ON b.chat_id = m.chat_id AND b.message_id = a.reply_to AND m.timestamp - b.timestamp <= 2592000 AND b.message_id <> m.message_id""")
def join06_reply_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ancestors(messages(spark, sf_dir))


@query(f"""{WITH} SELECT m.chat_id, m.message_id, (SELECT p.message_id FROM messages p WHERE p.chat_id = m.chat_id AND (p.timestamp < m.timestamp OR (p.timestamp = m.timestamp AND p.message_id < m.message_id))
 AND p.deleted = 0 AND p.text <> '' AND p.kind = 'message' AND p.timestamp >= m.timestamp - 120 ORDER BY p.timestamp DESC, p.message_id DESC LIMIT 1) AS prior_id FROM messages m""")
def join07_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("content_hash", F.lit(None).cast("string"))
    return C.prior(m).select(*KEY, F.col("prior.message_id").alias("prior_id"))


RANGES_SQL = f"SELECT DISTINCT user_id AS chat_id, {EPOCH} + (user_id % 20) * 86400 AS a, {EPOCH} + (user_id % 20) * 86400 + 180000 AS b FROM events"


@query(f"WITH {FEED_SQL}, r AS ({RANGES_SQL}) SELECT f.chat_id, f.message_id, r.a AS starts FROM feed f JOIN r ON r.chat_id = f.chat_id AND f.ts >= r.a AND f.ts < r.b")
def join08_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feed(spark, sf_dir)
    first = F.lit(EPOCH) + (F.col("chat_id") % 20) * 86400
    ranges = f.select("chat_id").distinct().select("chat_id", first.alias("a"), (first + 180000).alias("b"))
    return S.within(f, ranges, "chat_id", "ts", "a", "b").select("chat_id", "message_id", F.col("a").alias("starts"))


@query("SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY l_orderkey")
def join09_lowest_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))


@query("""SELECT l_partkey, l_orderkey, CAST(min(l_linenumber) AS BIGINT) AS line FROM lineitem GROUP BY l_partkey, l_orderkey QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) <= 10""")
def join10_bounded_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten orders for each part, one line for each."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min("l_linenumber").cast("long").alias("line"))
    return S.keep_last(one, ["l_partkey"], [F.col("l_orderkey")], 10)


@query("SELECT doc_id, round(n_chars / (SELECT avg(n_chars) FROM documents), 6) AS share FROM documents")
def join11_single_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row beside the table's one row of statistics."""
    d = table(spark, sf_dir, "documents")
    return d.join(F.broadcast(d.agg(F.avg("n_chars").alias("mean"))), F.lit(True)).select("doc_id", F.round(F.col("n_chars") / F.col("mean"), 6).alias("share"))


CHATS = {"photo": "has_photo = 1", "removed": "deleted = 1"}


def chats(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return messages(spark, sf_dir).where(CHATS[which]).select("chat_id")


def _sets(operation: str) -> str:
    return f"{WITH} SELECT chat_id FROM messages WHERE {CHATS['photo']} {operation} SELECT chat_id FROM messages WHERE {CHATS['removed']}"


@query(_sets("UNION"))
def set01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir, "photo").union(chats(spark, sf_dir, "removed")).distinct()


@query(_sets("UNION ALL"))
def set02_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir, "photo").unionAll(chats(spark, sf_dir, "removed"))


@query(f"""{WITH}, a AS (SELECT DISTINCT chat_id FROM messages WHERE {CHATS["photo"]}), b AS (SELECT DISTINCT chat_id FROM messages WHERE {CHATS["removed"]})
SELECT 'left' AS side, CAST(count(*) AS BIGINT) AS n FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'right', CAST(count(*) AS BIGINT) FROM (FROM b EXCEPT FROM a)""")
def set03_except_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = chats(spark, sf_dir, "photo"), chats(spark, sf_dir, "removed")
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(a.subtract(b), "left").union(count(b.subtract(a), "right"))


@query(_sets("INTERSECT"))
def set05_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir, "photo").intersect(chats(spark, sf_dir, "removed"))
