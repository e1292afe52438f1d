"""Merging revisions: a later state of the archive against the stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import exports as X
from palimpsest.operators import ingest as I
from palimpsest.operators import store as V
from palimpsest.plans.registry import WITH, day_sql, query
from palimpsest.sources.exports import scratch, staged
from palimpsest.sources.views import ARCHIVE_SQL, FEED_SQL, derived, feed, messages, table

STORED_SQL = """stored AS (SELECT chat_id, message_id, timestamp, md5(text) AS content_hash, edited, deleted FROM messages WHERE (chat_id + message_id) % 7 <> 0),
incoming AS (SELECT chat_id, message_id, timestamp + CASE WHEN message_id % 4 = 1 THEN 86400 ELSE 0 END AS timestamp, md5(CASE WHEN message_id % 3 = 0 THEN text || '!' ELSE text END) AS content_hash,
  CASE WHEN message_id % 4 = 0 THEN timestamp + 5 WHEN message_id % 4 = 2 THEN timestamp + 20 WHEN message_id % 8 = 3 THEN timestamp + 1 END AS edited, deleted FROM messages),
gone AS (SELECT chat_id, message_id FROM messages WHERE deleted = 1), live AS (SELECT chat_id, message_id FROM messages WHERE (chat_id + message_id) % 4 = 1)"""


def classified_sql(policy: str = "uncertain_revision") -> str:
    """policy: what becomes of a revision without an edit time."""
    return f"""{WITH}, {STORED_SQL}, classified AS (SELECT i.*, s.content_hash AS base_hash, CASE WHEN g.chat_id IS NOT NULL THEN 'remote_deleted' WHEN s.chat_id IS NULL THEN 'added' WHEN s.content_hash = i.content_hash THEN 'unchanged'
  WHEN i.edited < s.edited THEN 'older_revision' WHEN i.edited > coalesce(s.edited, 0) THEN 'updated' WHEN l.chat_id IS NOT NULL THEN 'uncertain_revision' ELSE '{policy}' END AS outcome
  FROM incoming i LEFT JOIN stored s USING (chat_id, message_id) LEFT JOIN gone g USING (chat_id, message_id) LEFT JOIN live l USING (chat_id, message_id))"""


CLASSIFIED_SQL = classified_sql()
COLUMNS = "chat_id, message_id, timestamp, content_hash, edited, deleted"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Incoming and stored messages, tombstones, and those that the live source has written."""
    m, turn = messages(spark, sf_dir), F.col("message_id")
    digest = lambda c: F.md5(c.cast("binary"))
    stored = m.where("(chat_id + message_id) % 7 <> 0").select(*I.KEY, "timestamp", digest(F.col("text")).alias("content_hash"), "edited", "deleted")
    text = F.when(turn % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    edited = F.when(turn % 4 == 0, F.col("timestamp") + 5).when(turn % 4 == 2, F.col("timestamp") + 20).when(turn % 8 == 3, F.col("timestamp") + 1)
    incoming = m.select(*I.KEY, (F.col("timestamp") + F.when(turn % 4 == 1, 86400).otherwise(0)).alias("timestamp"), digest(text).alias("content_hash"), edited.alias("edited"), "deleted")
    return incoming, stored, m.where("deleted = 1").select(*I.KEY), m.where("(chat_id + message_id) % 4 = 1").select(*I.KEY)


def classified(spark: SparkSession, sf_dir: str, policy: str = "preserve") -> tuple[DataFrame, DataFrame]:
    incoming, stored, gone, live = sides(spark, sf_dir)
    return I.classify(incoming, stored, gone, policy, live), stored


@query(f"{CLASSIFIED_SQL} SELECT chat_id, message_id, outcome FROM classified")
def ing01_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir)[0].select(*I.KEY, "outcome")


@query(f"{classified_sql('updated')} SELECT chat_id, message_id, outcome FROM classified")
def ing01_prefer_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy that takes revisions without an edit time: older ones and those the live source has written stay conflicts."""
    return classified(spark, sf_dir, "prefer_imported")[0].select(*I.KEY, "outcome")


APPLIED_SQL = f"""fresh AS (SELECT {COLUMNS} FROM classified WHERE outcome IN ('added', 'updated')), later AS (SELECT chat_id, message_id, edited AS seen FROM classified WHERE outcome = 'unchanged' AND edited IS NOT NULL),
applied AS (SELECT * FROM fresh UNION ALL SELECT s.chat_id, s.message_id, s.timestamp, s.content_hash, coalesce(greatest(s.edited, l.seen), s.edited, l.seen), s.deleted FROM stored s LEFT JOIN later l USING (chat_id, message_id) ANTI JOIN fresh f USING (chat_id, message_id))"""


@query(f"{CLASSIFIED_SQL}, {APPLIED_SQL} SELECT * FROM applied")
def ing02_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.apply(*classified(spark, sf_dir))


#: Incoming messages say where they were forwarded from more often than stored ones.
ORIGIN = "CASE WHEN message_id % 3 = 1 THEN 'Feed' END"
KNOWN = "CASE WHEN message_id % 6 = 1 THEN 'Old feed' END"


def partitioned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, V.PartitionedStore]:
    """The classified change-set and the stored messages in buckets of a chat's days, after the change-set was merged into them."""
    changes, stored = classified(spark, sf_dir)
    store = V.PartitionedStore(spark, scratch(spark, "messages"), ["chat_id", "day"], V.BUCKETS)
    store.publish(stored.select("*", F.expr(KNOWN).alias("forwarded_from"), F.lit(1).cast("long").alias("revision"), I.utc_day(F.col("timestamp")).alias("day")))
    changes = changes.withColumn("forwarded_from", F.expr(ORIGIN))
    I.merged_into(store, changes)
    return changes, store


@query(f"""{CLASSIFIED_SQL}, old AS (SELECT *, {KNOWN} AS forwarded_from FROM stored), new AS (SELECT *, {ORIGIN} AS forwarded_from FROM classified WHERE outcome IN ('added', 'updated', 'unchanged'))
SELECT chat_id, message_id, CASE WHEN n.outcome IN ('added', 'updated') THEN n.timestamp ELSE o.timestamp END AS timestamp, CASE WHEN n.outcome IN ('added', 'updated') THEN n.content_hash ELSE o.content_hash END AS content_hash,
CASE WHEN n.outcome IN ('added', 'updated') THEN n.edited ELSE coalesce(greatest(n.edited, o.edited), n.edited, o.edited) END AS edited,
CASE WHEN n.outcome IN ('added', 'updated') THEN coalesce(n.forwarded_from, o.forwarded_from) ELSE coalesce(o.forwarded_from, n.forwarded_from) END AS forwarded_from,
CAST(CASE WHEN n.outcome = 'updated' THEN 2 ELSE 1 END AS BIGINT) AS revision FROM old o FULL JOIN new n USING (chat_id, message_id)""")
def ing02_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages after a merge that rewrites only the buckets of days it touches: revisions, edit times and origins."""
    return partitioned(spark, sf_dir)[1].read().select(*I.KEY, "timestamp", "content_hash", "edited", "forwarded_from", "revision")


@query(f"""{CLASSIFIED_SQL}, fresh AS (SELECT * FROM classified WHERE outcome IN ('added', 'updated'))
SELECT chat_id, {day_sql("timestamp")} AS day, CAST(1 AS BIGINT) AS version FROM fresh UNION SELECT s.chat_id, {day_sql("s.timestamp")}, CAST(1 AS BIGINT) FROM stored s SEMI JOIN fresh f USING (chat_id, message_id)""")
def str04_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that the merge's version told others to index anew: what its outbox holds, committed with its rows."""
    return partitioned(spark, sf_dir)[1].told().select("chat_id", "day", "version")


@query(f"{CLASSIFIED_SQL} SELECT chat_id, message_id, outcome, CASE WHEN outcome <> 'remote_deleted' THEN content_hash END AS content_hash FROM classified WHERE outcome NOT IN ('added', 'unchanged', 'updated')")
def ing05_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts; those with a deleted message keep no content."""
    return I.conflicts(classified(spark, sf_dir)[0]).select(*I.KEY, "outcome", "content_hash")


@query(f"{CLASSIFIED_SQL}, moved AS (SELECT chat_id, message_id, CASE WHEN message_id % 5 = 0 THEN 'moved' ELSE content_hash END AS content_hash FROM stored) SELECT c.chat_id, c.message_id, CASE WHEN m.content_hash IS NOT DISTINCT FROM c.base_hash THEN c.outcome ELSE 'stale' END AS outcome FROM classified c LEFT JOIN moved m USING (chat_id, message_id)")
def ing06_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored preview applied after the archive has moved on: rows whose base has changed are stale."""
    changes, stored = classified(spark, sf_dir)
    base = stored.select(*I.KEY, F.col("content_hash").alias("base_hash"))
    preview = staged(changes.join(base, I.KEY, "left"), "preview")
    moved = stored.withColumn("content_hash", F.when(F.col("message_id") % 5 == 0, "moved").otherwise(F.col("content_hash")))
    return I.confirmed(preview, moved).select(*I.KEY, "outcome")


@query(f"{CLASSIFIED_SQL} SELECT chat_id, message_id, outcome FROM classified WHERE outcome NOT IN ('added', 'unchanged', 'updated') AND (chat_id, message_id) > (0, 5) ORDER BY chat_id, message_id LIMIT 11")
def ing07_conflict_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of open conflicts behind a key, and one row that tells whether more follow."""
    behind = "chat_id > 0 or (chat_id = 0 and message_id > 5)"
    return I.conflicts(classified(spark, sf_dir)[0]).where(behind).orderBy(*I.KEY).limit(11).select(*I.KEY, "outcome")


@query(f"""{CLASSIFIED_SQL}, o AS (SELECT * FROM classified WHERE outcome IN ('older_revision', 'uncertain_revision') AND message_id % 2 = 1)
SELECT s.chat_id, s.message_id, s.timestamp, CASE WHEN o.chat_id IS NOT NULL AND s.message_id % 3 <> 1 THEN o.content_hash ELSE s.content_hash END AS content_hash, CASE WHEN o.chat_id IS NOT NULL AND s.message_id % 3 <> 1 THEN o.edited ELSE s.edited END AS edited, s.deleted FROM stored s LEFT JOIN o USING (chat_id, message_id)""")
def ing07_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd messages take what was imported, unless what is stored isn't what the choice was made on; even ones stay."""
    changes, stored = classified(spark, sf_dir)
    expected = F.when(F.col("message_id") % 3 == 1, "another version").otherwise(F.col("content_hash"))
    choices = stored.select(*I.KEY, F.when(F.col("message_id") % 2 == 1, "use_imported").otherwise("keep_current").alias("choice"), expected.alias("expected"))
    return I.resolved(stored, I.conflicts(changes), choices)


@query(f"""{WITH}, b AS (SELECT DISTINCT chat_id, chat_id % 3 AS peer_id, CASE WHEN chat_id % 2 = 0 THEN 'archive' ELSE 'mirror' END AS policy FROM messages WHERE chat_id % 4 <> 2 AND chat_id < 3 OR chat_id = 3),
one AS (SELECT peer_id, any_value(chat_id) AS chat_id, any_value(policy) AS policy FROM b GROUP BY 1 HAVING count(*) = 1), d AS (SELECT DISTINCT o.chat_id, m.message_id, o.policy FROM one o JOIN messages m ON m.chat_id = o.chat_id AND m.message_id % 3 = 0)
SELECT m.chat_id, m.message_id, CASE WHEN d.policy = 'archive' THEN 1 ELSE m.deleted END AS deleted FROM messages m LEFT JOIN d USING (chat_id, message_id) WHERE d.policy IS DISTINCT FROM 'mirror'""")
def ing08_remote_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions under both policies; a peer that two chats are bound to is ignored."""
    m = messages(spark, sf_dir)
    bound = m.where("chat_id % 4 <> 2 and chat_id < 3 or chat_id = 3").select("chat_id").distinct()
    bindings = bound.select("chat_id", (F.col("chat_id") % 3).alias("peer_id"), F.when(F.col("chat_id") % 2 == 0, "archive").otherwise("mirror").alias("policy"))
    gone = m.where("message_id % 3 = 0").select((F.col("chat_id") % 3).alias("peer_id"), "message_id").distinct()
    return I.deleted(m.select(*I.KEY, "deleted"), gone, bindings)


@query(f"""{WITH} SELECT chat_id, message_id, max(e) AS edited, CAST(sum(seen) AS BIGINT) AS seen FROM (SELECT chat_id, message_id, edited AS e, 2 AS seen FROM messages WHERE has_photo = 0 UNION ALL SELECT chat_id, message_id, timestamp + 15, 1 FROM messages WHERE message_id % 3 = 0) GROUP BY 1, 2""")
def ing09_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    known = m.where("has_photo = 0").select(*I.KEY, "edited", F.lit(2).cast("long").alias("seen"))
    return I.provenance(known, m.where("message_id % 3 = 0").select(*I.KEY, (F.col("timestamp") + 15).alias("edited")))


FILES_SQL = """kept AS (SELECT chat_id, message_id, ref_kind, ref_id, CASE WHEN blob_id % 3 <> 0 THEN md5(CAST(blob_id AS VARCHAR)) END AS sha256, concat('photos/', blob_id) AS path FROM refs),
new AS (SELECT chat_id, message_id, ref_kind, CASE WHEN blob_id % 3 = 1 THEN md5(CAST(blob_id AS VARCHAR)) WHEN blob_id % 6 = 2 THEN 'other' END AS sha256, concat('photos/', blob_id + CASE WHEN blob_id % 5 = 0 THEN 1 ELSE 0 END) AS path FROM refs WHERE message_id % 2 = 0)"""


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs, blob = derived(spark, sf_dir, "refs"), F.col("blob_id")
    digest = F.md5(blob.cast("string").cast("binary"))
    kept = refs.select(*I.KEY, "ref_kind", "ref_id", F.when(blob % 3 != 0, digest).alias("sha256"), F.concat(F.lit("photos/"), blob).alias("path"))
    new = refs.where("message_id % 2 = 0").select(*I.KEY, "ref_kind", F.when(blob % 3 == 1, digest).when(blob % 6 == 2, "other").alias("sha256"), F.concat(F.lit("photos/"), blob + F.when(blob % 5 == 0, 1).otherwise(0)).alias("path"))
    return kept, new


@query(f"""WITH {ARCHIVE_SQL}, {FILES_SQL} SELECT k.ref_id FROM kept k WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.chat_id = k.chat_id AND n.message_id = k.message_id)
OR EXISTS (SELECT 1 FROM new n WHERE n.chat_id = k.chat_id AND n.message_id = k.message_id AND n.ref_kind = k.ref_kind AND CASE WHEN n.sha256 IS NOT NULL THEN n.sha256 = k.sha256 ELSE n.path = k.path END)""")
def ing04_pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pruned(*files(spark, sf_dir)).select("ref_id")


@query(f"""WITH {ARCHIVE_SQL}, {FILES_SQL}, a AS (SELECT chat_id, message_id, list({{'kind': ref_kind, 'sha256': sha256, 'path': path}}) AS f FROM kept GROUP BY 1, 2), b AS (SELECT chat_id, message_id, list({{'kind': ref_kind, 'sha256': sha256, 'path': path}}) AS g FROM new GROUP BY 1, 2)
SELECT chat_id, message_id, message_id % 7 <> 0 AND list_sort(list_distinct(list_transform(f, lambda x: x.kind))) = list_sort(list_distinct(list_transform(g, lambda x: x.kind)))
 AND len(list_filter(g, lambda x: NOT CASE WHEN x.sha256 IS NOT NULL AND len(list_filter(f, lambda y: y.kind = x.kind AND y.sha256 IS NOT NULL)) > 0 THEN len(list_filter(f, lambda y: y.kind = x.kind AND y.sha256 = x.sha256)) > 0
  ELSE len(list_filter(f, lambda y: y.kind = x.kind AND y.path = x.path)) > 0 END)) = 0 AS same FROM a JOIN b USING (chat_id, message_id)""")
def ing03_same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose files were restored or renamed are the same; others are edits."""
    kept, new = files(spark, sf_dir)
    listed = lambda df, name: df.groupBy(*I.KEY).agg(F.collect_list(F.struct(F.col("ref_kind").alias("kind"), "sha256", "path")).alias(name))
    pairs = listed(kept, "files").join(listed(new, "other_files"), I.KEY).withColumns({"hash": F.lit("a"), "other_hash": F.when(F.col("message_id") % 7 == 0, "b").otherwise("a")})
    return I.same_content(pairs).select(*I.KEY, "same")


@query(f"""WITH {ARCHIVE_SQL}, {STORED_SQL}, f AS (SELECT chat_id, message_id, list_sort(list(DISTINCT concat_ws(':', ref_kind, md5(CAST(blob_id AS VARCHAR))))) AS files FROM refs WHERE status = 'ready' GROUP BY 1, 2)
SELECT s.chat_id, s.message_id, sha256(concat_ws('|', 'message', s.content_hash, coalesce(CAST(s.edited AS VARCHAR), ''), coalesce(array_to_string(f.files, ','), ''))) AS version FROM stored s LEFT JOIN f USING (chat_id, message_id)
UNION ALL SELECT m.chat_id, m.message_id, sha256(concat_ws('|', 'deleted', m.chat_id, m.message_id, m.timestamp, 'archive')) FROM messages m WHERE m.deleted = 1 AND (m.chat_id + m.message_id) % 7 = 0""")
def fn07_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token for each message that changes with its content, its edit time and its files."""
    _, stored, _, _ = sides(spark, sf_dir)
    refs = derived(spark, sf_dir, "refs").where("status = 'ready'").withColumn("sha256", F.md5(F.col("blob_id").cast("string").cast("binary")))
    gone = messages(spark, sf_dir).where("deleted = 1").select(*I.KEY, F.col("timestamp").alias("observed_at"), F.lit("archive").alias("policy"))
    return X.versions(stored, refs, gone)


@query(f"""{CLASSIFIED_SQL.replace(WITH, "WITH " + ARCHIVE_SQL, 1)}, r AS (SELECT CASE WHEN status = 'missing' THEN 'missing' WHEN ref_id % 5 = 0 THEN 'corrupt' ELSE status END AS status FROM refs)
SELECT CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (outcome = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (outcome = 'unchanged') AS BIGINT) AS unchanged,
CAST(count(*) FILTER (outcome = 'updated') AS BIGINT) AS updated, CAST(count(*) FILTER (outcome NOT IN ('added', 'unchanged', 'updated')) AS BIGINT) AS conflicts,
(SELECT CAST(count(*) FILTER (status = 'missing') AS BIGINT) FROM r) AS missing, (SELECT CAST(count(*) FILTER (status = 'corrupt') AS BIGINT) FROM r) AS invalid FROM classified""")
def agg26_import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = derived(spark, sf_dir, "refs").withColumn("status", F.when((F.col("status") != "missing") & (F.col("ref_id") % 5 == 0), "corrupt").otherwise(F.col("status")))
    return I.counters(classified(spark, sf_dir)[0], refs.select(*I.KEY, "status"))


@query(f"""{CLASSIFIED_SQL} SELECT CASE WHEN outcome IN ('added', 'updated') THEN 'accepted' WHEN outcome = 'unchanged' THEN 'repeated' WHEN outcome = 'older_revision' THEN 'late' ELSE 'rejected' END AS fate, CAST(count(*) AS BIGINT) AS n FROM classified GROUP BY 1""")
def str03_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of late and doubtful changes."""
    fate = F.when(F.col("outcome").isin("added", "updated"), "accepted").when(F.col("outcome") == "unchanged", "repeated").when(F.col("outcome") == "older_revision", "late").otherwise("rejected")
    return classified(spark, sf_dir)[0].groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{CLASSIFIED_SQL.replace(WITH, "WITH " + ARCHIVE_SQL, 1)}, a AS (SELECT status AS state, 'asset' AS what FROM refs UNION ALL SELECT outcome, 'conflict' FROM classified WHERE outcome NOT IN ('added', 'unchanged', 'updated')) SELECT what, state, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1, 2""")
def agg25_sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = derived(spark, sf_dir, "refs").select(F.lit("asset").alias("what"), F.col("status").alias("state"))
    open_ = I.conflicts(classified(spark, sf_dir)[0]).select(F.lit("conflict").alias("what"), F.col("outcome").alias("state"))
    return assets.union(open_).groupBy("what", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}, l AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY message_id DESC) AS rn FROM messages), r AS (SELECT chat_id, message_id, timestamp + CASE WHEN message_id % 6 = 0 THEN 1 ELSE 0 END AS timestamp, CASE WHEN message_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM messages WHERE message_id % 9 <> 5)
SELECT l.chat_id, CASE WHEN r.chat_id IS NULL THEN 'unavailable' WHEN r.timestamp <> l.timestamp THEN 'mismatch' WHEN r.text <> l.text THEN 'edited' ELSE 'matched' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM l LEFT JOIN r USING (chat_id, message_id) WHERE rn <= 20 GROUP BY 1, 2""")
def join13_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty messages of each chat against the remote ones."""
    m, turn = messages(spark, sf_dir), F.col("message_id")
    remote = m.where("message_id % 9 <> 5").select(*I.KEY, (F.col("timestamp") + F.when(turn % 6 == 0, 1).otherwise(0)).alias("timestamp"), F.when(turn % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return I.overlap(m, remote, 20)


@query(f"{WITH}, t AS (SELECT max(timestamp) AS now FROM messages) SELECT chat_id, message_id FROM messages, t WHERE timestamp >= now - 7 * 86400 AND timestamp <= now")
def str02_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read again for late edits: the last seven days of the archive."""
    m = messages(spark, sf_dir)
    return I.reconcilable(m, 7).select(*I.KEY)


@query(f"""WITH {FEED_SQL}, l AS (SELECT chat_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, message_id) <= 3600 THEN 0 ELSE 1 END AS new FROM feed),
g AS (SELECT chat_id, ts, sum(new) OVER (PARTITION BY chat_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM l)
SELECT chat_id, CAST(burst AS BIGINT) AS burst, min(ts) AS since, least(min(ts) + 36000, max(ts) + 3600) AS due, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1, 2""")
def str05_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When work falls due: a quiet time after the last change of a burst, but no later than a bound after its first."""
    return I.debounced(feed(spark, sf_dir), 3600, 36000)


@query(f"""{CLASSIFIED_SQL}, fresh AS (SELECT * FROM classified WHERE outcome IN ('added', 'updated')),
dirty AS (SELECT chat_id, {day_sql("timestamp")} AS day FROM fresh UNION SELECT s.chat_id, {day_sql("s.timestamp")} FROM stored s SEMI JOIN fresh f USING (chat_id, message_id)),
segments AS (SELECT DISTINCT chat_id, {day_sql("timestamp")} AS day, 1 AS g FROM stored)
SELECT chat_id, day, CAST(coalesce(g, 0) + CASE WHEN d.chat_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS generation FROM segments s FULL JOIN dirty d USING (chat_id, day)""")
def str06_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after the merge: the changed days, before and after, in a new generation."""
    changes, stored = classified(spark, sf_dir)
    segments = stored.select("chat_id", I.utc_day(F.col("timestamp")).alias("day")).distinct().withColumn("generation", F.lit(1))
    return I.generations(segments, I.dirty_days(changes, stored)).withColumn("generation", F.col("generation").cast("long"))


@query("SELECT user_id AS chat_id, arg_max(event_id, (ts, event_id)) AS message_id, max(ts) AS ts FROM events GROUP BY 1")
def str03_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("chat_id")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("message_id"), F.max("ts").alias("ts"))


@query("SELECT vec_id AS id, label * CASE WHEN vec_id % 3 = 0 THEN 10 ELSE 1 END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label * 10 FROM embeddings WHERE vec_id % 3 = 0")
def src12_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows merged into a stored table by id: matched ones replaced, others added, as a new version of it."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    rows = e.where("id % 3 = 0").withColumn("label", F.col("label") * 10)
    store = V.Store(spark, scratch(spark, "vectors"))
    store.publish(e)
    store.publish(I.upsert(store.read(), rows.union(rows.withColumn("id", F.col("id") + 1000000))))
    return store.read()


@query("SELECT vec_id AS id FROM embeddings WHERE label <> 1 AND vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def src13_vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a chat and of blobs that are gone deleted from a stored table."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("chat_id"))
    store = V.Store(spark, scratch(spark, "vectors"))
    store.publish(e)
    store.publish(store.read().where("chat_id <> 1"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    store.publish(store.read().join(gone, "id", "left_anti"))
    return store.read().select("id")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS labels, 1 AS files FROM embeddings")
def src14_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of many small files rewritten into few; readers of the version before are not disturbed."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    store = V.Store(spark, scratch(spark, "vectors"))
    store.publish(e.repartition(16))
    store.compact(64 << 20)
    found = store.read().withColumn("_file", F.input_file_name())
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"), F.countDistinct("_file").cast("int").alias("files"))
