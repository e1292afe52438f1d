"""Forecasts and metrics over the change feed, vectors by approximate search, exports, and pages of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import exports as X
from palimpsest.operators import forecast as P
from palimpsest.operators import history as Y
from palimpsest.operators import store as S
from palimpsest.operators import vectors as V
from palimpsest.plans.registry import WITH, bm25_sql, query
from palimpsest.plans.retrieval import GOAL, GOAL_SQL, KEY
from palimpsest.sources import live as L
from palimpsest.sources.exports import scratch, staged
from palimpsest.sources.views import ARCHIVE_SQL, FEED_SQL, derived, feed, messages, table

#: Samples of work: each change is one, its lane is its kind, its time a thousandth of the feed's; now is the feed's end.
SAMPLES_SQL = f"""{FEED_SQL}, samples AS (SELECT kind AS lane, message_id AS sample_id, ts / 1000.0::DOUBLE AS observed_at, 1.0 + message_id % 5 AS work, value + 0.01 AS seconds FROM feed), clock AS (SELECT max(observed_at) AS now FROM samples)"""
RECENT_SQL = """last AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY observed_at DESC, sample_id DESC) AS rn FROM samples, clock WHERE work > 0 AND seconds > 0 AND now - observed_at BETWEEN 0 AND 3600 QUALIFY rn <= 24),
middle AS (SELECT lane, quantile_cont(seconds, 0.5) AS m FROM last GROUP BY lane), recent AS (SELECT l.* FROM last l JOIN middle USING (lane) WHERE now - observed_at <= least(3600, greatest(60, m * 10)))"""
LANES_SQL = """rates AS (SELECT lane, seconds / work AS rate, work * pow(0.5, (row_number() OVER (PARTITION BY lane ORDER BY observed_at DESC, sample_id DESC) - 1) / 6.0) AS weight FROM recent),
c AS (SELECT lane, min(rate) AS centre FROM (SELECT *, sum(weight) OVER (PARTITION BY lane ORDER BY rate, weight ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER (PARTITION BY lane) AS total FROM rates) WHERE cum >= 0.5 * total - 1e-12 GROUP BY lane),
b AS (SELECT lane, weight, least(centre * 2, greatest(centre / 2, rate)) AS bounded FROM rates JOIN c USING (lane)),
q AS (SELECT *, sum(weight) OVER (PARTITION BY lane ORDER BY bounded, weight ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER (PARTITION BY lane) AS total FROM b),
lanes AS (SELECT lane, CAST(count(*) AS BIGINT) AS samples, sum(bounded * weight) / sum(weight) AS r, min(bounded) FILTER (cum >= 0.2 * total - 1e-12) AS low, min(bounded) FILTER (cum >= 0.8 * total - 1e-12) AS high FROM q GROUP BY lane),
forecasts AS (SELECT lane, samples, CASE WHEN samples >= 3 THEN r END AS rate, CASE WHEN samples >= 3 THEN round(500 * r, 4) END AS seconds, CASE WHEN samples >= 3 THEN round(500 * least(r * 0.8, low) * 0.9, 4) END AS lower, CASE WHEN samples >= 3 THEN round(500 * greatest(r * 1.2, high) * 1.1, 4) END AS upper FROM lanes)"""


def samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    s = feed(spark, sf_dir).select(F.col("kind").alias("lane"), F.col("message_id").alias("sample_id"), (F.col("ts") / 1000.0).alias("observed_at"), (1.0 + F.col("message_id") % 5).alias("work"), (F.col("value") + 0.01).alias("seconds"))
    return s, s.agg(F.max("observed_at")).first()[0] or 0.0


@query(f"WITH {SAMPLES_SQL}, {RECENT_SQL}, {LANES_SQL} SELECT lane, samples, round(rate, 6) AS rate, seconds, lower, upper FROM forecasts")
def for01_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that 500 units take in each lane, a fifth of them guessed."""
    rows, now = samples(spark, sf_dir)
    return P.lanes(rows, ["lane"], F.lit(now), 500, 0.2, 4).withColumn("rate", F.round("rate", 6))


@query(f"WITH {SAMPLES_SQL}, {RECENT_SQL}, {LANES_SQL} SELECT CAST(sum(samples) AS BIGINT) AS samples, CASE WHEN count(*) = count(rate) THEN round(1 / sum(1 / rate), 6) END AS rate, CASE WHEN count(*) = count(rate) THEN round(1 / sum(1 / seconds), 4) END AS seconds FROM forecasts HAVING count(*) > 0")
def agg20_combined_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lanes side by side."""
    rows, now = samples(spark, sf_dir)
    both = P.combined(P.lanes(rows, ["lane"], F.lit(now), 500, 0.2, 4).withColumn("all", F.lit(1)), ["all"], 4)
    return both.select("samples", F.round("rate", 6).alias("rate"), "seconds")


@query(f"""WITH {ARCHIVE_SQL}, b AS (SELECT 2 + chat_id % 2 AS size, chat_id, day, (number // (2 + chat_id % 2)) AS batch, count(*) AS n, max(n_tokens) AS longest, sum(n_tokens) AS tokens FROM chunks WHERE number > 0 GROUP BY 1, 2, 3, 4),
s AS (SELECT size, sum(n * longest) AS slots, sum(tokens) AS tokens FROM b GROUP BY size), u AS (SELECT 2 + chat_id % 3 AS size, sum(length(text) + length(author) + 32) AS chars FROM messages WHERE deleted = 0 GROUP BY 1),
e AS (SELECT greatest(0.02, least(4.0, (SELECT sum(n_tokens) FROM chunks) / (SELECT sum(length(text) + length(author) + 32) FROM messages WHERE kind = 'message'))) AS x),
g AS (SELECT size, coalesce(slots, 0)::DOUBLE AS known, coalesce(chars * x * coalesce(slots / tokens, 1.1), 0) AS guessed FROM s FULL JOIN u USING (size), e)
SELECT size, round(known + guessed, 4) AS work, round(guessed / greatest(1, known + guessed), 6) AS projection FROM g""")
def for01_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work by batch size: padded batches of built chunks, and what unbuilt texts are thought to take."""
    c, m = derived(spark, sf_dir, "chunks"), messages(spark, sf_dir)
    size = 2 + F.col("chat_id") % 2
    batches = c.where("number > 0").groupBy(size.alias("size"), "chat_id", "day", F.floor(F.col("number") / size)).agg(F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("tokens"))
    batches = batches.groupBy("size").agg(F.sum(F.col("n") * F.col("longest")).alias("slots"), F.sum("tokens").alias("tokens"))
    chars = F.length("text") + F.length("author") + 32
    unbuilt = m.where("deleted = 0").groupBy((2 + F.col("chat_id") % 3).alias("size")).agg(F.sum(chars).alias("chars"))
    tokens, built = c.agg(F.sum("n_tokens")).first()[0], m.where("kind = 'message'").agg(F.sum(chars)).first()[0]
    found = P.workload(batches, unbuilt, F.lit(tokens), F.lit(built))
    return found.select("size", F.round("work", 4).alias("work"), F.round("projection", 6).alias("projection"))


@query(f"WITH {SAMPLES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY observed_at DESC, sample_id DESC) AS rn FROM samples, clock WHERE now - observed_at <= 86400) SELECT lane, sample_id FROM k WHERE rn <= 24 ORDER BY observed_at DESC, sample_id DESC LIMIT 100")
def for02_kept_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, now = samples(spark, sf_dir)
    return P.kept_samples(rows, ["lane"], F.lit(now), most=100).select("lane", "sample_id")


@query(f"""WITH {FEED_SQL}, s AS (SELECT kind AS stage, ts AS started, ts + 1 + CAST(floor(value) AS BIGINT) AS finished, 1 + message_id % 4 AS units, CAST(message_id % 50 = 0 AS INT) AS errors FROM feed),
m AS (SELECT *, coalesce(max(finished) OVER (PARTITION BY stage ORDER BY started, finished ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), started) AS before, (finished - started) / units AS unit FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY unit, started, finished) AS rn, count(*) OVER (PARTITION BY stage) AS n FROM m)
SELECT stage, CAST(count(*) AS BIGINT) AS samples, CAST(sum(units) AS BIGINT) AS units, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(greatest(0, finished - greatest(started, before))) AS BIGINT) AS covered,
 round(max(unit) FILTER (rn = n // 2 + 1), 4) AS p50, round(max(unit) FILTER (rn = ceil(n * 0.95)), 4) AS p95, round(sum(units) / sum(greatest(0, finished - greatest(started, before))) * 60, 2) AS per_minute FROM r GROUP BY stage""")
def for03_stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feed(spark, sf_dir)
    spans = f.select(F.col("kind").alias("stage"), F.col("ts").alias("started"), (F.col("ts") + 1 + F.floor("value")).alias("finished"), (1 + F.col("message_id") % 4).alias("units"), (F.col("message_id") % 50 == 0).cast("int").alias("errors"))
    return P.stage_metrics(spans, ["stage"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def index(spark: SparkSession, sf_dir: str):
    store = S.Store(spark, scratch(spark, "ann"))
    centres = V.built(store, vectors(spark, sf_dir))
    return store.read(), centres


@query()
def ret07_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of the probed cells; the recall is tested."""
    rows, centres = index(spark, sf_dir)
    return V.nearest(rows, centres, GOAL, 10, probes=max(1, len(centres) // 2)).select("id", F.round("distance", 6).alias("distance"))


@query(f"""WITH away AS (SELECT vec_id AS id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {GOAL_SQL}) AS distance FROM embeddings WHERE label = 3) SELECT id, round(distance, 6) AS distance, 'exact' AS strategy, 'small_scope' AS reasons FROM away ORDER BY away.distance, id DESC LIMIT 10""")
def ret06_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An approximate search of a small scope, which is answered exactly, and says so."""
    rows, centres = index(spark, sf_dir)
    small = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    found, strategy, reasons = V.search(rows, centres, GOAL, 10, small)
    return found.select("id", F.round("distance", 6).alias("distance"), F.lit(strategy).alias("strategy"), F.lit(",".join(reasons)).alias("reasons"))


@query("WITH c AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 4 = 0) AS tail FROM embeddings) SELECT CAST(n AS BIGINT) AS n, CAST(tail AS BIGINT) AS tail, greatest(1, least(64, n // 32)) <> 15 OR tail >= greatest(1024, 0.1 * n) AS rebuild FROM c")
def ret08_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an index of fifteen cells, of which a quarter of the rows are not part, is to be built anew."""
    rows = vectors(spark, sf_dir).withColumn("cell", F.when(F.col("id") % 4 != 0, F.lit(1)))
    return V.stale(rows, 15)


@query(f"""WITH away AS (SELECT vec_id AS id, label, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {GOAL_SQL}) AS distance FROM embeddings),
e AS (SELECT id FROM away ORDER BY distance, id DESC LIMIT 50), f AS (SELECT id FROM away WHERE label <> 2 ORDER BY distance, id DESC LIMIT 50) SELECT round(count(f.id) / nullif(count(*), 0), 6) AS recall FROM e LEFT JOIN f USING (id)""")
def agg17_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the fifty nearest that a search without one label finds."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = V.recall(V.R.nearest(rows.select("id", "vector"), GOAL, 50), V.R.nearest(rows.where("label <> 2").select("id", "vector"), GOAL, 50))
    return found.select(F.round("recall", 6).alias("recall"))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive as export documents, one a chat: texts as a string or as a list of runs, times as unix or ISO."""
    m = messages(spark, sf_dir)
    half = F.floor(F.length("text") / 2).cast("int")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    text = F.when(F.col("message_id") % 2 == 0, quoted(F.col("text"))).otherwise(F.concat(F.lit("["), quoted(first), F.lit(',{"type":"bold","text":'), quoted(rest), F.lit("}]")))
    time = F.when(F.col("message_id") % 3 == 0, F.concat(F.lit('"date_unixtime":"'), "timestamp", F.lit('"'))).when(F.col("message_id") % 3 == 1, F.concat(F.lit('"date":"'), F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"'))).otherwise(F.concat(F.lit('"date":"'), F.date_format(F.timestamp_seconds(F.col("timestamp") + 7200), "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+02:00"')))
    one = F.concat(F.lit('{"id":'), F.col("message_id"), F.lit(',"type":"'), F.col("kind"), F.lit('",'), time, F.lit(',"text":'), text, F.lit("}"))
    listed = m.select("chat_id", "message_id", one.alias("j")).groupBy("chat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_id", "j"))), lambda x: x["j"]), ",").alias("all"))
    return listed.select(F.concat(F.lit('{"id":'), F.col("chat_id"), F.lit(',"name":"Chat '), F.col("chat_id"), F.lit('","type":"private_group","messages":['), F.col("all"), F.lit("]}")).alias("raw"))


@query(f"{WITH} SELECT chat_id AS external_id, concat('Chat ', chat_id) AS name, 'private_group' AS type, CAST(count(*) AS INT) AS n_messages FROM messages GROUP BY chat_id")
def src01_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports as files, each read as a whole, with what they say of themselves."""
    path = f"{scratch(spark, 'exports')}/files"
    exported(spark, sf_dir).write.text(path, lineSep="\n")
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    return X.summaries(lines).select("external_id", "name", "type", "n_messages")


@query(f"{WITH}, o AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY message_id) - 1 AS ordinal FROM messages) SELECT chat_id AS external_id, message_id, CAST(ordinal // 10 AS BIGINT) AS batch FROM o WHERE ordinal > 6")
def src02_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages behind a checkpoint, in batches of ten."""
    rows = X.message_rows(exported(spark, sf_dir), after=6, batch=10)
    return rows.select("external_id", X.part("message", "$.id", "long").alias("message_id"), "batch")


@query(f"{WITH}, o AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY message_id) - 1 AS ordinal FROM messages) SELECT chat_id AS external_id, CAST(ordinal AS INT) AS ordinal, message_id, timestamp, md5(text) AS text_md5 FROM o")
def src03_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of accounts with up to 50 chats each: messages with their flattened texts (FN-02) and times (FN-03)."""
    account = F.floor(F.get_json_object("raw", "$.id").cast("long") / 50)
    chats = exported(spark, sf_dir).groupBy(account).agg(F.array_join(F.collect_list("raw"), ",").alias("all"))
    rows = X.account_rows(chats.select(F.concat(F.lit('{"chats":{"list":['), "all", F.lit("]}}")).alias("raw")))
    return rows.select("external_id", "ordinal", X.part("message", "$.id", "long").alias("message_id"), X.sent_at("message").alias("timestamp"), F.md5(X.flat_text(X.part("message", "$.text", "variant")).cast("binary")).alias("text_md5"))


@query("""WITH k AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'personal_chat' WHEN 1 THEN 'private_group' WHEN 2 THEN 'public_supergroup' WHEN 3 THEN 'private_channel' WHEN 4 THEN 'saved_messages' WHEN 5 THEN 'bot_chat' ELSE 'odd' END AS kind,
CASE WHEN p_partkey % 7 IN (2, 3) THEN -1000000000000 - p_partkey WHEN p_partkey % 7 = 1 THEN -p_partkey ELSE p_partkey END AS raw FROM part)
SELECT p_partkey, CASE WHEN kind IN ('personal_chat', 'saved_messages', 'bot_chat') THEN 'user' WHEN kind = 'private_group' THEN 'chat' WHEN kind IN ('public_supergroup', 'private_channel') THEN 'channel' END AS peer_kind, CASE WHEN raw <= -1000000000000 THEN -raw - 1000000000000 ELSE abs(raw) END AS peer_id FROM k""")
def src10_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.when(k % 7 == 0, "personal_chat").when(k % 7 == 1, "private_group").when(k % 7 == 2, "public_supergroup").when(k % 7 == 3, "private_channel").when(k % 7 == 4, "saved_messages").when(k % 7 == 5, "bot_chat").otherwise("odd")
    raw = F.when((k % 7).isin(2, 3), -1000000000000 - k).when(k % 7 == 1, -k).otherwise(k)
    peer, id_ = X.typed_peer(raw, kind)
    return p.select("p_partkey", peer.alias("peer_kind"), id_.alias("peer_id"))


@query("""WITH o AS (SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, CASE WHEN event_id % 10 = 0 THEN event_id - 70 ELSE event_id END AS message_id FROM events), l AS (SELECT *, lag(message_id) OVER (PARTITION BY page ORDER BY ordinal) AS was FROM o)
SELECT page, ordinal, message_id FROM l WHERE message_id <= was OR message_id <= 5 OR message_id > 990""")
def src09_invalid_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break their page's order or leave its bounds."""
    e = table(spark, sf_dir, "events")
    id_ = F.when(F.col("event_id") % 10 == 0, F.col("event_id") - 70).otherwise(F.col("event_id"))
    rows = e.select(F.col("user_id").alias("page"), F.row_number().over(X.W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("ordinal"), id_.alias("message_id"))
    return X.invalid_page(rows, 5, 990)


@query(f"{WITH}, c AS (SELECT author_id, max(author) AS author, CAST(count(*) AS BIGINT) AS n FROM messages WHERE author_id IS NOT NULL GROUP BY author_id) SELECT *, CAST(row_number() OVER (ORDER BY author, author_id) AS BIGINT) AS place FROM c")
def agg02_author_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors with their last name in the alphabet, in its order."""
    c = messages(spark, sf_dir).where("author_id is not null").groupBy("author_id").agg(F.max("author").alias("author"), F.count(F.lit(1)).alias("n"))
    return V.R.ranked(c, F.col("author"), F.col("author_id"), name="place").withColumn("place", F.col("place").cast("long"))


@query(f"""{WITH}, c AS (SELECT forwarded_from, CAST(count(*) AS BIGINT) AS n FROM messages WHERE forwarded_from IS NOT NULL GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY lower(forwarded_from), forwarded_from) AS rn, count(*) OVER () AS total FROM c)
SELECT forwarded_from, n, total > 2 AS has_more, CASE WHEN total > 2 THEN 2 END AS next_offset FROM p WHERE rn <= 2""")
def topk08_source_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of forwarded sources, with where the next one begins."""
    c = messages(spark, sf_dir).where("forwarded_from is not null").groupBy("forwarded_from").agg(F.count(F.lit(1)).alias("n"))
    return Y.facet_page(c, F.lower("forwarded_from"), F.col("forwarded_from"), offset=0, limit=2)


@query(f"{WITH}, {bm25_sql(['er'])}, f AS (SELECT chat_id, message_id, row_number() OVER (ORDER BY score, chat_id, message_id) AS place FROM scored) SELECT chat_id, message_id, CAST(place AS BIGINT) AS place, (SELECT max(place) FROM f WHERE place <= 100) > 15 AS has_more FROM f WHERE place > 5 AND place <= 15")
def topk07_snapshot_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a result that was frozen when it was found."""
    found = V.R.bm25(messages(spark, sf_dir), "er")
    frozen = staged(Y.snapshot(found.select(*KEY, "score"), F.col("score"), *map(F.col, KEY)), "snapshot")
    return Y.snapshot_page(frozen, 5, 10).select(*KEY, F.col("place").cast("long").alias("place"), "has_more")


@query(f"""{WITH} SELECT timestamp, chat_id, message_id, count(*) OVER () > 20 AS has_more FROM (SELECT timestamp, chat_id, message_id FROM messages WHERE kind = 'message' AND text <> '' AND deleted = 0 ORDER BY timestamp DESC, chat_id DESC, message_id DESC LIMIT 21) QUALIFY row_number() OVER (ORDER BY timestamp DESC, chat_id DESC, message_id DESC) <= 20""")
def topk05_has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first page, with whether another follows."""
    return Y.browse_page(messages(spark, sf_dir), Y.SearchSpec(content_type="text", exclude_deleted=True)).select("timestamp", *KEY, "has_more")


@query(f"""WITH {FEED_SQL}, h AS (SELECT message_id AS search_id, chat_id AS owner, ts AS searched_at, message_id % 40 = 0 AS favourite, message_id % 97 AS snapshot_id FROM feed),
k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY searched_at DESC, search_id DESC) AS rn FROM h) SELECT search_id, owner, favourite FROM k WHERE rn <= 10 OR favourite""")
def ses04_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten searches of each owner, and their favourites."""
    return Y.kept(history(spark, sf_dir)).select("search_id", "owner", "favourite")


@query(f"""WITH {FEED_SQL}, h AS (SELECT message_id AS search_id, chat_id AS owner, ts AS searched_at, message_id % 40 = 0 AS favourite, message_id AS snapshot_id FROM feed),
k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY searched_at DESC, search_id DESC) AS rn FROM h) SELECT snapshot_id FROM h WHERE snapshot_id NOT IN (SELECT snapshot_id FROM k WHERE rn <= 10 OR favourite)""")
def ses04_unowned_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that no kept search owns: they may go."""
    h = history(spark, sf_dir)
    return Y.unowned(h.select("snapshot_id"), Y.kept(h))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feed(spark, sf_dir)
    return f.select(F.col("message_id").alias("search_id"), F.col("chat_id").alias("owner"), F.col("ts").alias("searched_at"), (F.col("message_id") % 40 == 0).alias("favourite"), F.col("message_id").alias("snapshot_id"))


@query(f"{WITH}, p AS (SELECT timestamp, chat_id, message_id, row_number() OVER (ORDER BY timestamp DESC, chat_id DESC, message_id DESC) AS place FROM messages) SELECT timestamp, chat_id, message_id, CAST(place AS BIGINT) AS place FROM p WHERE place > 15 AND place <= 45")
def ses06_browse_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages appended, of which the last thirty rows stay."""
    placed = V.R.ranked(messages(spark, sf_dir).select("timestamp", *KEY), F.col("timestamp").desc(), F.col("chat_id").desc(), F.col("message_id").desc(), name="place").withColumn("place", F.col("place").cast("long"))
    return Y.appended(placed.where("place <= 25"), placed.where("place > 25 and place <= 45"), 30)


@query(f"""{WITH} SELECT 'chat' AS peer_kind, chat_id AS peer_id, message_id, timestamp AS sent, edited, CASE WHEN author_id IS NOT NULL THEN concat('user:', author_id) END AS sender, forwarded_from, md5(text) AS text_md5,
CASE WHEN text LIKE '/%' THEN 'bot_command' WHEN has_photo = 1 THEN 'Odd' ELSE 'bold' END AS entity, CASE WHEN has_photo = 1 THEN sha256(concat('photo:', CAST(chat_id * 1000 + message_id AS VARCHAR))) END AS media_id FROM messages""")
def src06_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a live source pages them, each page with the end of the one before: normalised, and taken in once."""
    m, k = messages(spark, sf_dir), F.col("message_id")
    kind = F.when(F.col("text").startswith("/"), "BotCommand").when(F.col("has_photo") == 1, "Odd").otherwise("Bold")
    said = F.to_json(F.struct(
        k.alias("id"), F.col("timestamp").alias("date"), "edited", F.when(F.col("author_id").isNotNull(), F.struct(F.lit("user").alias("kind"), F.col("author_id").alias("id"))).alias("from"), F.struct(F.col("forwarded_from").alias("name")).alias("forward"), "text",
        F.array(F.struct(kind.alias("type"), F.lit(0).alias("offset"), F.lit(1).alias("length"))).alias("entities"), F.when(F.col("has_photo") == 1, F.struct(F.lit("photo").alias("kind"), (F.col("chat_id") * 1000 + k).cast("string").alias("id"), F.lit(7).alias("access_hash"))).alias("media"),
    ))
    # pages of 30 ids; ids of the last 20 of a page stand on the next one as well. Where conversations of a chat are long, ids occur again: these messages have pages of their own
    again = F.row_number().over(X.W.partitionBy(*KEY).orderBy("timestamp", "text"))
    each = m.select("chat_id", again.alias("again"), k.alias("i"), said.alias("j"), F.explode(F.array_distinct(F.array(F.floor(k / 30), F.floor((k + L.OVERLAP - 1) / 30)))).alias("page"))
    pages = each.groupBy("chat_id", "again", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j"))), lambda x: x["j"]), ",").alias("all"))
    text = F.concat(F.lit('{"peer":{"kind":"chat","id":'), F.col("chat_id"), F.lit('},"cursor":'), F.col("page") * 30 , F.lit(',"upper":'), F.col("page") * 30 + 29, F.lit(',"messages":['), F.col("all"), F.lit("]}"))
    root = scratch(spark, "live")
    # a page a line: files grow with the archive, their number with its bytes alone
    pages.select(text.alias("value")).write.text(f"{root}/pages", lineSep="\n")
    found = L.received(spark, f"{root}/pages", f"{root}/state", lines=True)
    return found.select("peer_kind", "peer_id", "message_id", "sent", "edited", "sender", "forwarded_from", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("entities")[0]["type"].alias("entity"), "media_id")
