"""Stored files and recognised texts: witnesses, coverage, queues, media search, fusion of modalities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import retrieval as R
from palimpsest.plans.spec import SearchSpec
from palimpsest.sources.exports import staged

KEY = ["chat_id", "message_id"]


def ready_photos(refs: DataFrame) -> DataFrame:
    return refs.where("status = 'ready' and ref_kind = 'photo'")


def witnessed(blobs: DataFrame, refs: DataFrame, messages: DataFrame, spec: SearchSpec) -> DataFrame:
    """Blobs to which a ready photo of a message that meets the filters refers."""
    fit = ready_photos(refs).join(messages.where(spec.filters()).select(*KEY), KEY, "left_semi")
    return blobs.join(fit.select("blob_id"), "blob_id", "left_semi")


def pending(refs: DataFrame, done: DataFrame) -> DataFrame:
    """Blobs of ready photos that a stage has not done: those without a row in done, or with a failed one behind fewer than three attempts."""
    finished = done.where("state = 'done' or (state = 'failed' and attempts >= 3)").select("blob_id")
    return ready_photos(refs).select("blob_id").distinct().join(finished, "blob_id", "left_anti")


def status(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """By state of a stage: distinct blobs, references, messages with a photo, characters and retries. A blob without a row is pending."""
    both = refs.join(texts.select("blob_id", "state", "chars", "attempts"), "blob_id", "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    of_blob = both.groupBy("state", "blob_id").agg(F.first("chars").alias("chars"), F.first("attempts").alias("attempts"), F.count(F.lit(1)).alias("refs"))
    photos = both.where("ref_kind = 'photo'").groupBy("state").agg(F.countDistinct(*KEY).alias("photo_messages"))
    sums = of_blob.groupBy("state").agg(F.count(F.lit(1)).alias("blobs"), F.sum("refs").alias("refs"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).alias("retries"))
    return sums.join(photos, "state", "left").withColumn("photo_messages", F.coalesce("photo_messages", F.lit(0)))


def coverage(refs: DataFrame, texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct blobs of ready photos: all, with text, failed, with a vector, and with neither."""
    blobs = ready_photos(refs).select("blob_id").distinct()
    marked = blobs.join(texts.select("blob_id", "state"), "blob_id", "left").join(vectors.select("blob_id", F.lit(True).alias("seen")), "blob_id", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("blobs"), F.count_if(F.col("state") == "done").alias("with_text"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if("seen").alias("with_vector"), F.count_if(F.col("state").isNull() & F.col("seen").isNull()).alias("open"),
    )


def media_search(refs: DataFrame, texts: DataFrame, vectors: DataFrame, messages: DataFrame, spec: SearchSpec, goal: list[float], most: int = 100, k: int = 60) -> DataFrame:
    """Messages by the words and by the vectors of their photos: one vote a channel (the best rank of their blobs), with the best similarity in [-1, 1].

    A blob stands for all messages that show it and meet the filters.
    """
    shown = ready_photos(refs).join(messages.where(spec.filters()).select(*KEY), KEY, "left_semi").select("blob_id", *KEY)
    eligible = shown.select("blob_id").distinct()
    words = R.bm25(texts.where("state = 'done'"), spec.query).join(eligible, "blob_id", "left_semi").orderBy("score", "blob_id").limit(most)
    words = R.ranked(words, F.col("score"), F.col("blob_id")).select("blob_id", "rank", F.lit("words").alias("channel"), F.lit(None).cast("double").alias("similarity"))
    near = R.nearest(vectors.select(F.col("blob_id").alias("id"), "vector").join(eligible.withColumnRenamed("blob_id", "id"), "id", "left_semi"), goal, most)
    near = R.ranked(near, F.col("distance"), F.col("id").desc()).select(F.col("id").alias("blob_id"), "rank", F.lit("vectors").alias("channel"), (1 - F.col("distance")).alias("similarity"))
    votes = shown.join(words.union(near), "blob_id").groupBy(*KEY, "channel").agg(F.min("rank").alias("rank"), F.max("similarity").alias("similarity"))
    best = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.max("similarity")))
    return votes.groupBy(*KEY).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), best.alias("similarity")).orderBy(F.col("score").desc(), *KEY).limit(most)


def unified(branches: dict[str, DataFrame], limit: int = 20, k: int = 60) -> DataFrame:
    """Modalities fused by rank (each with chat_id, message_id, score, similarity); one alone passes as it is. similarity is the first that is known, in the order of branches."""
    placed = {name: R.ranked(rows, F.col("score").desc(), *map(F.col, KEY)) for name, rows in branches.items()}
    keys = R.fused({name: (rows, 1.0) for name, rows in placed.items()}, KEY, k)
    known = reduce(DataFrame.unionByName, (rows.select(*KEY, F.lit(i).alias("_place"), "similarity") for i, rows in enumerate(placed.values())))
    first = known.where("similarity is not null").groupBy(*KEY).agg(F.min_by("similarity", "_place").alias("similarity"))
    return keys.join(first, KEY, "left").orderBy(F.col("score").desc(), *KEY).limit(limit)


def attempted(branches: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Pages of those branches that can be had, written, and for each that fails its name with the first line of why. All failing is a failure."""
    pages, failed = {}, {}
    for name, make in branches.items():
        try:
            pages[name] = staged(make(), name)
        except PySparkException as e:
            failed[name] = str(e).splitlines()[0]
    if not pages:
        raise ValueError(f"no branch answered: {failed}")
    return pages, failed


def best_effort(branches: dict[str, Callable[[], DataFrame]], limit: int = 20, k: int = 60) -> DataFrame:
    """unified over the branches that answer, with warnings, the names of those that didn't."""
    pages, failed = attempted(branches)
    return unified(pages, limit, k).withColumn("warnings", F.array(*map(F.lit, sorted(failed))).cast("array<string>"))


def relinked(refs: DataFrame, found: DataFrame, source: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """What moving each source's files to where found lists them would do: a row a source, and the refs whose state changes.

    Rows have the number of files by state (a corrupt one has changed, one at an unsafe path is missing) and whether the move is accepted: not if a file has changed or was never
    verified. Of a refused source nothing changes. refs: source, path, digest and status as it is known.
    """
    state = F.when(F.col("_now") == "corrupt", "changed").when(F.col("_now") == "unsafe", "missing").otherwise(F.col("_now"))
    now = probed(refs.withColumnRenamed("status", "_was"), found).withColumnRenamed("status", "_now").withColumn("status", state)
    counts = now.groupBy(source).agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("ready", "missing", "changed", "unverified")))
    judged = counts.withColumn("accepted", (F.col("changed") == 0) & (F.col("unverified") == 0))
    changes = now.where("status <> _was").join(judged.where("accepted").select(source), source, "left_semi")
    return judged, changes.select(*(c for c in refs.columns))


def of_messages(refs: DataFrame) -> DataFrame:
    """A message's files, one of each kind: a ready one before others, then the newest."""
    best = F.max_by(F.struct("blob_id", "status"), F.struct((F.col("status") == "ready").alias("a"), F.col("ref_id").alias("b"))).alias("file")
    one = refs.groupBy(*KEY, "ref_kind").agg(best)
    return one.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ref_kind", "file.blob_id", "file.status"))).alias("files"))


def probed(refs: DataFrame, found: DataFrame) -> DataFrame:
    """refs (path, recorded digest) against found files (path, digest, size, whether they open): ready, missing, changed, corrupt or unverified (nothing recorded), unsafe for paths that leave the root."""
    joined = refs.join(found.select("path", F.col("digest").alias("_digest"), "size", "opens"), "path", "left")
    return joined.withColumn("status", file_status(F.col("path"), F.col("digest"), F.col("_digest"), F.col("opens"))).drop("_digest", "opens")


def file_status(path: Column, recorded: Column, digest: Column, opens: Column) -> Column:
    unsafe = path.startswith("/") | path.contains("\\") | F.exists(F.split(path, "/"), lambda x: x.isin("..", "."))
    return F.when(unsafe, "unsafe").when(digest.isNull(), "missing").when(~opens, "corrupt").when(recorded.isNull(), "unverified").when(recorded == digest, "ready").otherwise("changed")


def queue(refs: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """State of each ready photo's blob for one version of the recogniser: done, failed or pending. A row of another version counts as none."""
    own = cache.where(F.col("version") == version).select("blob_id", "state")
    return ready_photos(refs).select("blob_id").distinct().join(own, "blob_id", "left").select("blob_id", F.coalesce("state", F.lit("pending")).alias("state"))


def orphans(blobs: DataFrame, refs: DataFrame, before: int) -> DataFrame:
    """Blobs older than before (epoch seconds) that nothing refers to."""
    return blobs.where(F.col("stored_at") < before).join(refs.select("blob_id"), "blob_id", "left_anti")


def inventory(vectors: DataFrame, refs: DataFrame) -> DataFrame:
    """Vectors by kind: how many, their bytes, those that several references share and those with one alone."""
    uses = refs.groupBy("blob_id").agg(F.count(F.lit(1)).alias("uses"))
    both = vectors.join(uses, "blob_id", "left")
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(4 * F.size("vector")).alias("bytes"), F.count_if(F.col("uses") > 1).alias("shared"), F.count_if(F.col("uses") == 1).alias("exclusive"), F.count_if(F.col("uses").isNull()).alias("unused"))


def reading_order(boxes: DataFrame, page: str = "page") -> DataFrame:
    """boxes (page, box, x0, y0, x1, y1) with line and place, both from 1: boxes whose heights overlap, directly or by way of others, are a line, and are read from the left; equal ones by box."""
    down = W.partitionBy(page).orderBy("y0", "y1", "box")
    above = F.max("y1").over(down.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col("y0") >= above, F.lit(True)).cast("int")
    lines = boxes.withColumn("line", F.sum(new).over(down.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return lines.withColumn("place", F.row_number().over(W.partitionBy(page, "line").orderBy("x0", "y0", "box")).cast("long"))
