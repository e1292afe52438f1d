"""Merging message revisions: classification, application, conflicts, invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import utc_day
from palimpsest.operators.store import PartitionedStore
from palimpsest.sources.exports import staged

KEY = ["chat_id", "message_id"]


def classify(incoming: DataFrame, stored: DataFrame, tombstones: DataFrame | None = None, policy: str = "preserve", provenance: DataFrame | None = None) -> DataFrame:
    """incoming with outcome: added, unchanged, updated, or a conflict (remote_deleted, older_revision, uncertain_revision).

    Both sides have chat_id, message_id, content_hash and edited (null if never). A message that the live source has written
    (provenance) takes only revisions that are newer; any other takes those without an edit time too under prefer_imported. Older ones are never taken.
    """
    old = stored.select(*KEY, F.col("content_hash").alias("_hash"), F.col("edited").alias("_edited"), F.lit(True).alias("_there"))
    joined = incoming.join(old, KEY, "left")
    for name, rows in (("_gone", tombstones), ("_live", provenance)):
        flag = F.lit(None).cast("boolean")
        joined = joined.withColumn(name, flag) if rows is None else joined.join(rows.select(*KEY, F.lit(True).alias(name)).distinct(), KEY, "left")
    newer = F.coalesce(F.col("edited") > F.coalesce("_edited", F.lit(0)), F.lit(False))
    outcome = (
        F.when(F.col("_gone"), "remote_deleted")
        .when(F.col("_there").isNull(), "added")
        .when(F.col("_hash") == F.col("content_hash"), "unchanged")
        .when(F.col("edited") < F.col("_edited"), "older_revision")
        .when(newer, "updated")
        .when(F.col("_live"), "uncertain_revision")
        .otherwise("updated" if policy == "prefer_imported" else "uncertain_revision")
    )
    return joined.withColumn("outcome", outcome).drop("_hash", "_edited", "_there", "_gone", "_live")


def apply(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """stored after changes: added and updated rows replace their keys; an unchanged one may bring an edit time that was not known."""
    fresh = changes.where("outcome in ('added', 'updated')").select(*stored.columns)
    later = changes.where("outcome = 'unchanged' and edited is not null").select(*KEY, F.col("edited").alias("_edited"))
    kept = stored.join(fresh.select(*KEY), KEY, "left_anti").join(later, KEY, "left").withColumn("edited", F.coalesce(F.greatest("edited", "_edited"), "edited", "_edited"))
    return kept.select(*stored.columns).unionByName(fresh)


def merged_into(store: PartitionedStore, changes: DataFrame) -> set[tuple]:
    """Merge a classified change-set into stored messages (content_hash, edited, forwarded_from, revision, day and more) by chat and day; returns the days rewritten.

    Added messages begin at revision 1, updated ones go up by one. An unchanged one may bring a later edit time, or where a message was forwarded from if that was
    not known; that is no new revision. Only messages that differ are written, with the rest of their days; the outbox says which days to index anew.
    """
    stored = store.read()
    old = stored.select(*KEY, F.col("revision").alias("_revision"), F.col("edited").alias("_edited"), F.col("forwarded_from").alias("_from"), *(F.col(c).alias(f"_old_{c}") for c in stored.columns if c not in KEY))
    both = changes.where("outcome in ('added', 'updated', 'unchanged')").join(old, KEY, "left").withColumn("day", utc_day(F.col("timestamp")))
    fresh = F.col("outcome").isin("added", "updated")
    later = F.coalesce(F.greatest("edited", "_edited"), "edited", "_edited")
    origin = F.coalesce(F.col("_from"), F.col("forwarded_from"))
    more = {
        "edited": F.when(fresh, F.col("edited")).otherwise(later),
        "forwarded_from": F.when(fresh, F.coalesce("forwarded_from", "_from")).otherwise(origin),
        "revision": F.when(fresh, F.coalesce("_revision", F.lit(0)) + 1).otherwise(F.col("_revision")).cast(stored.schema["revision"].dataType),
    }
    kept = lambda c: F.col(c) if c in KEY else F.when(fresh, F.col(c)).otherwise(F.col(f"_old_{c}"))
    rows = both.select(*((more[c] if c in more else kept(c)).alias(c) for c in stored.columns), fresh.alias("_fresh"), F.col("_edited"), F.col("_from"))
    differs = F.col("_fresh") | ~F.col("edited").eqNullSafe(F.col("_edited")) | ~F.col("forwarded_from").eqNullSafe(F.col("_from"))
    changed = staged(rows.where(differs).drop("_edited", "_from"), "changed")
    days = changed.where("_fresh").select("chat_id", "day").union(stored.join(changed.where("_fresh").select(*KEY), KEY, "left_semi").select("chat_id", "day")).distinct()
    return store.upsert(changed.drop("_fresh"), changed.limit(0).select(*KEY), KEY, outbox=days)


def pruned(refs: DataFrame, incoming: DataFrame) -> DataFrame:
    """refs of messages in incoming without those that no incoming file of their kind fits: by digest, or by path where the incoming one has none."""
    new = incoming.select(*KEY, "ref_kind", F.col("sha256").alias("_sha"), F.col("path").alias("_path"))
    met = refs.join(new, [*KEY, "ref_kind"]).where("(_sha is not null and _sha = sha256) or (_sha is null and _path = path)").select("ref_id")
    touched = incoming.select(*KEY).distinct()
    return refs.join(touched, KEY, "left_anti").unionByName(refs.join(touched, KEY, "left_semi").join(met.distinct(), "ref_id", "left_semi").select(*refs.columns))


def same_content(pairs: DataFrame) -> DataFrame:
    """pairs (hash and other_hash, both without files; files and other_files, arrays of kind, sha256 and path) with same: a restored or renamed file is no edit.

    Kinds must agree. A file with a digest must be among the known digests of its kind, if there are any; else its path must be known.
    """

    def fits(x: Column) -> Column:
        own = F.filter("files", lambda y: y["kind"] == x["kind"])
        known = F.filter(own, lambda y: y["sha256"].isNotNull())
        by_digest = F.exists(known, lambda y: y["sha256"] == x["sha256"])
        return F.when(x["sha256"].isNotNull() & (F.size(known) > 0), by_digest).otherwise(F.exists(own, lambda y: y["path"] == x["path"]))

    kinds = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["kind"])))
    same = (F.col("hash") == F.col("other_hash")) & (kinds("files") == kinds("other_files")) & F.forall("other_files", lambda x: F.coalesce(fits(x), F.lit(False)))
    return pairs.withColumn("same", same)


def conflicts(changes: DataFrame) -> DataFrame:
    """What a change-set leaves open; a deleted message's body is not kept."""
    open_ = changes.where(~F.col("outcome").isin("added", "unchanged", "updated"))
    return open_.withColumn("content_hash", F.when(F.col("outcome") != "remote_deleted", F.col("content_hash")))


def confirmed(preview: DataFrame, stored: DataFrame) -> DataFrame:
    """A preview (a classified change-set with base_hash, the stored content it was made against) as it applies now: rows whose base has changed since are stale."""
    now = stored.select(*KEY, F.col("content_hash").alias("_now"))
    joined = preview.join(now, KEY, "left")
    return joined.withColumn("outcome", F.when(F.col("_now").eqNullSafe(F.col("base_hash")), F.col("outcome")).otherwise("stale")).drop("_now")


def resolved(stored: DataFrame, open_: DataFrame, choices: DataFrame) -> DataFrame:
    """stored after choices (key, choice, expected): use_imported takes the conflict's content if stored still has the content expected; keep_current changes nothing."""
    taken = open_.join(choices.where("choice = 'use_imported'").select(*KEY, "expected"), KEY).where("outcome <> 'remote_deleted'").select(*KEY, "expected", F.col("content_hash").alias("_new"), F.col("edited").alias("_edited"))
    joined = stored.join(taken, KEY, "left").withColumn("_ok", F.coalesce(F.col("content_hash") == F.col("expected"), F.lit(False)))
    pick = lambda a, b: F.when(F.col("_ok"), F.col(a)).otherwise(F.col(b)).alias(b)
    return joined.select(*(pick({"content_hash": "_new", "edited": "_edited"}[c], c) if c in ("content_hash", "edited") else F.col(c) for c in stored.columns))


def deleted(stored: DataFrame, deletions: DataFrame, bindings: DataFrame) -> DataFrame:
    """stored after remote deletions (peer_id, message_id) under the policy of the chat bound to the peer: archive flags a message, mirror removes it.

    A peer that several chats are bound to is ambiguous, and its deletions are ignored.
    """
    one = bindings.groupBy("peer_id").agg(F.count(F.lit(1)).alias("_n"), F.first("chat_id").alias("chat_id"), F.first("policy").alias("_policy")).where("_n = 1")
    gone = deletions.join(one, "peer_id").select(*KEY, "_policy").distinct()
    marked = stored.join(gone, KEY, "left").where("_policy is null or _policy <> 'mirror'")
    return marked.withColumn("deleted", F.when(F.col("_policy") == "archive", 1).otherwise(F.col("deleted"))).select(*stored.columns)


def provenance(known: DataFrame, synced: DataFrame) -> DataFrame:
    """The latest edit the live source has shown for each message, and how often it was seen."""
    both = known.select(*KEY, "edited", "seen").unionByName(synced.select(*KEY, "edited", F.lit(1).cast("long").alias("seen")))
    return both.groupBy(*KEY).agg(F.max("edited").alias("edited"), F.sum("seen").alias("seen"))


def folded(incoming: DataFrame, ordinal: str) -> DataFrame:
    """The last revision of each key within a batch: by edit time, then by position."""
    order = W.partitionBy(*KEY).orderBy(F.col("edited").desc_nulls_last(), F.col(ordinal).desc())
    return incoming.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def counters(changes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Counters of an import; files (key, status) adds missing and invalid ones."""
    names = ("added", "unchanged", "updated")
    conflict = ~F.col("outcome").isin(*names)
    out = changes.agg(F.count(F.lit(1)).alias("processed"), *(F.count_if(F.col("outcome") == n).alias(n) for n in names), F.count_if(conflict).alias("conflicts"))
    if files is None:
        return out
    own = files.join(changes.select(*KEY), KEY, "left_semi").agg(F.count_if(F.expr("status = 'missing'")).alias("missing"), F.count_if(F.expr("status in ('corrupt', 'unsafe')")).alias("invalid"))
    return out.join(F.broadcast(own), F.lit(True))


def dirty_days(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """(chat, day) segments to rebuild: the days before and after of every change."""
    fresh = changes.where("outcome in ('added', 'updated')")
    before = stored.join(fresh.select(*KEY), KEY, "left_semi")
    days = fresh.select("chat_id", utc_day(F.col("timestamp")).alias("day")).union(before.select("chat_id", utc_day(F.col("timestamp")).alias("day")))
    return days.distinct()


def generations(segments: DataFrame, dirty: DataFrame) -> DataFrame:
    """Segments with the generation of dirty ones raised by one; new ones begin at 1."""
    both = segments.withColumn("_g", F.col("generation")).select("chat_id", "day", "_g").join(dirty.withColumn("_dirty", F.lit(1)), ["chat_id", "day"], "full")
    return both.select("chat_id", "day", (F.coalesce("_g", F.lit(0)) + F.coalesce("_dirty", F.lit(0))).alias("generation"))


def upsert(stored: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Vector rows: matched ones replaced, others added."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows.select(*stored.columns))


def overlap(stored: DataFrame, remote: DataFrame, last: int) -> DataFrame:
    """By chat how many of its last messages stand remotely as they do here: matched, edited, mismatch (another time) or unavailable."""
    order = W.partitionBy("chat_id").orderBy(F.col("message_id").desc())
    own = stored.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= last)
    other = remote.select(*KEY, F.col("timestamp").alias("_time"), F.col("text").alias("_text"))
    outcome = F.when(F.col("_time").isNull(), "unavailable").when(F.col("_time") != F.col("timestamp"), "mismatch").when(F.col("_text") != F.col("text"), "edited").otherwise("matched")
    return own.join(other, KEY, "left").groupBy("chat_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def reconcilable(messages: DataFrame, days: int, now: int | None = None) -> DataFrame:
    """Messages of the last days before now (the newest message if not given), which late edits may still change."""
    if not 1 <= days <= 30:
        raise ValueError("days out of range")
    if now is not None:
        return messages.where(F.col("timestamp").between(now - days * 86400, now))
    newest = messages.agg(F.max("timestamp").alias("_now"))
    return messages.join(F.broadcast(newest), F.lit(True)).where(F.col("timestamp") >= F.col("_now") - days * 86400).drop("_now")


def debounced(changes: DataFrame, quiet: int, most: int) -> DataFrame:
    """By chat its bursts of changes (no more than quiet seconds apart) and when each falls due: quiet after its last change, most after its first at the latest."""
    order = W.partitionBy("chat_id").orderBy("ts", "message_id")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(order) > quiet).cast("int"), F.lit(1))
    placed = changes.withColumn("_new", new).withColumn("burst", F.sum("_new").over(order))
    return placed.groupBy("chat_id", "burst").agg(F.min("ts").alias("since"), F.least(F.min("ts") + most, F.max("ts") + quiet).alias("due"), F.count(F.lit(1)).alias("n"))
