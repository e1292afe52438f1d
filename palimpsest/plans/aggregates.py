"""Aggregates: overviews, facets, coverage, workload and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import folded, utc_day
from palimpsest.operators import noise as N
from palimpsest.plans.registry import WITH, day_sql, folded_sql, query
from palimpsest.sources.views import messages, table


@query(f"{WITH} SELECT chat_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(has_photo) AS BIGINT) AS photos, min(timestamp) AS first, max(timestamp) AS last FROM messages GROUP BY chat_id")
def agg01_chat_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.sum("has_photo").alias("photos"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query(f"{WITH} SELECT author_id, CAST(count(*) AS BIGINT) AS n FROM messages WHERE author_id IS NOT NULL GROUP BY author_id")
def agg02_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("author_id is not null").groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT forwarded_from, CAST(count(*) AS BIGINT) AS n FROM messages WHERE forwarded_from IS NOT NULL GROUP BY 1 ORDER BY {folded_sql('forwarded_from')}, 1 LIMIT 2 OFFSET 1")
def agg03_source_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the facet: two names after the first."""
    found = messages(spark, sf_dir).where("forwarded_from is not null").groupBy("forwarded_from").agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(folded(F.col("forwarded_from")), "forwarded_from").offset(1).limit(2)


@query(f"{WITH} SELECT CAST(count(*) AS BIGINT) AS n, min(chat_id) AS first_chat, max(chat_id) AS last_chat, min({day_sql('timestamp')}) AS first_day, max({day_sql('timestamp')}) AS last_day FROM messages WHERE deleted = 0")
def agg04_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = utc_day(F.col("timestamp"))
    return messages(spark, sf_dir).where("deleted = 0").agg(F.count(F.lit(1)).alias("n"), F.min("chat_id").alias("first_chat"), F.max("chat_id").alias("last_chat"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("""SELECT source, CAST(count(DISTINCT md5(text)) AS BIGINT) AS blobs, CAST(count(*) AS BIGINT) AS refs, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS failed,
CAST(count(*) FILTER (l.doc_id IS NULL) AS BIGINT) AS pending, CAST(coalesce(sum(greatest(quality - 1, 0)), 0) AS BIGINT) AS retries FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def agg05_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    both = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("blob")).join(labels, "doc_id", "left")
    return both.groupBy("source").agg(F.countDistinct("blob").alias("blobs"), F.count(F.lit(1)).alias("refs"), F.count_if(F.col("toxic") == 1).alias("failed"), F.count_if(F.col("there").isNull()).alias("pending"), F.coalesce(F.sum(F.greatest(F.col("quality") - 1, F.lit(0))), F.lit(0)).alias("retries"))


@query(f"{WITH} SELECT chat_id, {day_sql('timestamp')} AS day, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (deleted = 0) AS BIGINT) AS ready FROM messages GROUP BY 1, 2")
def agg09_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("chat_id", utc_day(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("deleted = 0")).alias("ready"))


@query("""WITH b AS (SELECT l_orderkey, (l_linenumber - 1) // 4 AS batch, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY 1, 2)
SELECT CAST(n AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS batches, CAST(sum(n * most) AS BIGINT) AS slots FROM b GROUP BY 1""")
def agg11_padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in batches of four within an order, padded to the largest: batches and slots by batch size."""
    batch = F.floor((F.col("l_linenumber") - 1) / 4).alias("batch")
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", batch).agg(F.count(F.lit(1)).alias("size"), F.max("l_quantity").alias("most"))
    return b.groupBy("size").agg(F.count(F.lit(1)).alias("batches"), F.sum(F.col("size") * F.col("most")).cast("long").alias("slots"))


@query("SELECT owner, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_partkey, min(l_suppkey) AS owner FROM lineitem GROUP BY 1) GROUP BY owner")
def agg12_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("owner"))
    return owner.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


CASES_SQL = "SELECT CAST(n_chars > 2000 AS INT) AS predicted, l.quality AS label FROM documents d JOIN labels l USING (doc_id)"


@query(f"""WITH c AS ({CASES_SQL}), s AS (SELECT CAST(count(*) FILTER (predicted = 1 AND label = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (predicted = 1 AND label = 0) AS BIGINT) AS fp,
CAST(count(*) FILTER (predicted = 0 AND label = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (predicted = 0 AND label = 0) AS BIGINT) AS tn FROM c)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM s""")
def agg15_decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("predicted"))
    return N.precision(d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"))


@query("""WITH r AS (SELECT source AS query, doc_id, CAST(quality + 2 * toxic AS INT) AS grade, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc_id) AS best FROM r),
s AS (SELECT query, count(*) FILTER (grade > 0 AND rank <= 10) AS found, count(*) FILTER (grade > 0) AS relevant,
 sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN (2 ** grade - 1) / log2(best + 1.0) ELSE 0 END) AS idcg FROM g GROUP BY query)
SELECT query, round(found / nullif(relevant, 0), 6) AS recall, round(dcg / CASE WHEN idcg > 0 THEN idcg END, 6) AS ndcg FROM s""")
def agg16_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    order = N.W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    return N.ranking(d.select(F.col("source").alias("query"), "doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("grade"), F.row_number().over(order).alias("rank")))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def agg17_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median as the mean of the middle two, and the nearest-rank 95th percentile."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.expr("percentile_cont(0.5) within group (order by value)"), 6).alias("p50"), F.round(F.expr("percentile_disc(0.95) within group (order by value)"), 6).alias("p95"))


@query("SELECT event_type, round(1 / sum(1 / (value + 1)), 9) AS rate FROM events GROUP BY 1")
def agg20_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(1 / F.sum(1 / (F.col("value") + 1)), 9).alias("rate"))


@query("""SELECT p_brand, round(sum(levenshtein(p_name, p_type)) / sum(length(p_name)), 6) AS cer FROM part GROUP BY 1""")
def agg21_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.sum(F.levenshtein("p_name", "p_type")) / F.sum(F.length("p_name")), 6).alias("cer"))


@query("""WITH b AS (SELECT md5(text) AS blob, max(length(text)) AS size, count(*) FILTER (lang = 'en') AS own, count(*) FILTER (lang <> 'en') AS others FROM documents GROUP BY 1)
SELECT CAST(sum(own) AS BIGINT) AS refs, CAST(count(*) FILTER (others = 0) AS BIGINT) AS exclusive, CAST(count(*) FILTER (others > 0) AS BIGINT) AS shared, CAST(coalesce(sum(size) FILTER (others = 0), 0) AS BIGINT) AS freed FROM b WHERE own > 0""")
def agg22_deletion_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes if one language is deleted: blobs only it refers to, and those others share."""
    d = table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("blob"))
    b = d.agg(F.max(F.length("text")).alias("size"), F.count_if(F.col("lang") == "en").alias("own"), F.count_if(F.col("lang") != "en").alias("others")).where("own > 0")
    return b.agg(F.sum("own").alias("refs"), F.count_if(F.expr("others = 0")).alias("exclusive"), F.count_if(F.expr("others > 0")).alias("shared"), F.coalesce(F.sum(F.when(F.col("others") == 0, F.col("size"))), F.lit(0)).alias("freed"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg00_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return found.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
