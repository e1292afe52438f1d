"""Queries that apply the text and vector functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.vectors import norm
from palimpsest.plans.registry import WITH, day_sql, folded_sql, form_sql, keywords_sql, query, quoted, single_sql, words_sql
from palimpsest.sources.views import messages, table

KEY = ["chat_id", "message_id"]


@query(f"SELECT doc_id, md5({folded_sql('text')}) AS folded_md5 FROM documents")
def fn01_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.folded(F.col("text")).cast("binary")).alias("folded_md5"))


@query(f"{WITH} SELECT chat_id, message_id, {day_sql('timestamp')} AS day FROM messages")
def fn08_utc_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(*KEY, T.utc_day(F.col("timestamp")).alias("day"))


@query("""SELECT event_id, CAST(floor(epoch(CAST(strftime(ts, '%Y-%m-%d') AS DATE))) AS BIGINT) AS first, CAST(floor(epoch(CAST(strftime(ts, '%Y-%m-%d') AS DATE))) AS BIGINT) + 86400 AS last FROM events""")
def fn09_date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select("event_id", T.date_bound(day, False).alias("first"), T.date_bound(day, True).cast("long").alias("last"))


@query(f"SELECT doc_id, CAST(len({words_sql('text')}) AS BIGINT) AS n_words, md5(array_to_string({words_sql('text')}, ' ')) AS words_md5 FROM documents")
def fn10_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.md5(F.array_join(w, " ").cast("binary")).alias("words_md5"))


@query(f"SELECT doc_id, md5(array_to_string({keywords_sql('text')}, ' ')) AS words_md5 FROM documents")
def fn11_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.keyword_terms(F.col("text")), " ").cast("binary")).alias("words_md5"))


@query(f"{WITH} SELECT chat_id, message_id, array_to_string({keywords_sql('text')}, ' ') AS terms FROM messages")
def fn11_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words, negations and contractions of messages."""
    return messages(spark, sf_dir).select(*KEY, F.array_join(T.keyword_terms(F.col("text")), " ").alias("terms"))


@query(f"""WITH w AS (SELECT item_id, unnest({words_sql("text")}) AS w FROM benchmark),
g AS (SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS g FROM w UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) FROM w)
SELECT item_id, CAST(count(DISTINCT g) AS BIGINT) AS n_grams, string_agg(DISTINCT hex(encode(g)), ' ' ORDER BY hex(encode(g))) AS grams FROM g GROUP BY item_id""")
def fn12_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.grams(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(g).cast("long").alias("n_grams"), F.array_join(F.array_sort(g), " ").alias("grams"))


@query(f"{WITH} SELECT chat_id, message_id, {single_sql('text')} AS word FROM messages")
def fn14_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(*KEY, T.whole_word(F.col("text")).alias("word"))


@query(f"{WITH} SELECT chat_id, message_id, {form_sql('text')} AS form FROM messages")
def fn15_message_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(*KEY, T.message_form(F.col("text")).alias("form"))


@query(f"""WITH w AS (SELECT DISTINCT unnest({words_sql("text")}) AS w FROM documents)
SELECT w AS word, array_to_string(list_filter(string_split(w, ''), lambda c, i: i = 1 OR c <> w[i - 1]), '') AS run_key,
 CASE WHEN length(w) >= 2 AND repeat(w[1:1], length(w)) = w THEN w[1:1] WHEN length(w) >= 4 AND length(w) % 2 = 0 AND repeat(w[1:2], length(w) // 2) = w THEN w[1:2]
  WHEN length(w) >= 6 AND length(w) % 3 = 0 AND repeat(w[1:3], length(w) // 3) = w THEN w[1:3] WHEN length(w) >= 8 AND length(w) % 4 = 0 AND repeat(w[1:4], length(w) // 4) = w THEN w[1:4] END AS seed FROM w""")
def fn16_runs_and_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return w.select("word", T.run_key(F.col("word")).alias("run_key"), T.repeated_seed(F.col("word")).alias("seed"))


@query(f"""WITH w AS (SELECT DISTINCT unnest({words_sql("text")}) AS w FROM benchmark)
SELECT DISTINCT w AS word, unnest(list_transform(range(1, length(w) + 1), lambda i: concat(w[1:i - 1], w[i + 1:length(w)]))) AS signature FROM w""")
def fn22_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return w.select("word", F.explode(T.deletions(F.col("word"))).alias("signature"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IS NOT NULL AS has_k FROM events")
def fn23_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), k.isNotNull().alias("has_k"))


@query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def fn27_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha256(html) AS content_hash FROM pages")
def src04_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw attachments with host, size and content hash."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.octet_length("html").cast("long").alias("n_bytes"), F.sha2("html", 256).alias("content_hash"))


#: Where the runs of equal letters of a form begin.
RUNS_SQL = "list_filter(range(1, length({0}) + 1), lambda i: i = 1 OR {0}[i] <> {0}[i - 1])"


@query(f"""WITH w AS (SELECT DISTINCT unnest({words_sql("text")}) AS w FROM documents), s AS (SELECT w, {RUNS_SQL.format("w")} AS s FROM w),
r AS MATERIALIZED (SELECT w, array_to_string(list_transform(s, lambda i: w[i]), '') AS letters, list_transform(range(1, len(s) + 1), lambda k: coalesce(s[k + 1], length(w) + 1) - s[k]) AS n FROM s)
SELECT a.w AS observed, b.w AS original FROM (FROM r WHERE length(w) > length(letters)) a JOIN r b ON a.letters = b.letters AND a.w <> b.w WHERE len(list_filter(range(1, len(a.n) + 1), lambda i: a.n[i] < b.n[i])) = 0""")
def fn17_lengthening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of words of which one is the other with longer runs, met by their run key."""
    w = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).distinct().withColumn("k", T.run_key(F.col("w")))
    pairs = w.withColumnRenamed("w", "observed").join(w.withColumnRenamed("w", "original"), "k")
    return pairs.where(T.is_lengthening(F.col("observed"), F.col("original"))).select("observed", "original")


@query(f"""{WITH}, f AS (SELECT DISTINCT {single_sql("text")} AS form FROM messages)
SELECT form, CASE WHEN length(form) >= 4 AND regexp_full_match(form, '[ах]+') AND len(list_filter(range(2, length(form) + 1), lambda i: form[i] = form[i - 1])) = 0 THEN 'хаха' END AS seed FROM f WHERE form IS NOT NULL""")
def fn18_laughter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = messages(spark, sf_dir).select(T.whole_word(F.col("text")).alias("form")).where("form is not null").distinct()
    return f.select("form", T.laughter_seed(F.col("form")).alias("seed"))


def flags_sql(text: str, form: str) -> str:
    tests = (
        ("uppercase", f"regexp_matches({text}, '\\p{{Lu}}') AND NOT regexp_matches({text}, '\\p{{Ll}}') AND len(regexp_extract_all({text}, '\\p{{L}}')) >= 2"),
        ("titlecase", f"regexp_matches({text}, '\\p{{Lu}}') AND NOT regexp_matches({text}, '(^|[^\\p{{L}}])\\p{{Ll}}|\\p{{L}}\\p{{Lu}}')"),
        ("number", f"regexp_full_match({form}, '\\p{{Nd}}+')"),
        ("alphanumeric", f"regexp_matches({form}, '\\p{{Nd}}') AND NOT regexp_full_match({form}, '\\p{{Nd}}+')"),
        ("mixed_scripts", f"regexp_matches({form}, '\\p{{Latin}}') AND regexp_matches({form}, '\\p{{Cyrillic}}')"),
    )
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests) + "], lambda x: x IS NOT NULL)"


@query(f"{WITH}, f AS (SELECT chat_id, message_id, text, {single_sql('text')} AS form FROM messages) SELECT chat_id, message_id, array_to_string({flags_sql('text', 'form')}, ',') AS flags FROM f WHERE form IS NOT NULL")
def fn19_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = messages(spark, sf_dir).select(*KEY, "text", T.whole_word(F.col("text")).alias("form")).where("form is not null")
    return f.select(*KEY, F.array_join(T.structural_flags(F.col("text"), F.col("form")), ",").alias("flags"))


@query(f"""{WITH}, f AS (SELECT DISTINCT {form_sql("text")} AS form FROM messages), k AS (SELECT form, trim(form, {quoted(T.EDGE)}) AS key FROM f WHERE form IS NOT NULL)
SELECT form, CASE WHEN {form_sql("key")} = key THEN key ELSE form END AS key FROM k""")
def fn20_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = messages(spark, sf_dir).select(T.message_form(F.col("text")).alias("form")).where("form is not null").distinct()
    return f.select("form", T.punctuation_key(F.col("form")).alias("key"))
