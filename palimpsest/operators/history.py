"""Pages and histories of results: snapshots, look-ahead, kept searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.noise import page
from palimpsest.operators.retrieval import browse, ranked
from palimpsest.plans.spec import SearchSpec

MOST = 100


def snapshot(rows: DataFrame, *order: Column, most: int = MOST) -> DataFrame:
    """A result as it is frozen: its first rows with their place."""
    return ranked(rows.orderBy(*order).limit(most), *order, name="place")


def snapshot_page(frozen: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows of a frozen result behind offset, with whether more follow."""
    more = frozen.agg((F.coalesce(F.max("place"), F.lit(0)) > offset + limit).alias("has_more"))
    return frozen.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).join(F.broadcast(more), F.lit(True))


def facet_page(counts: DataFrame, *order: Column, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of a facet, with whether more follow and where the next page begins."""
    found = page(counts, *order, offset=offset, limit=limit)
    return found.withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit)))


def browse_page(messages: DataFrame, spec: SearchSpec, cursor: tuple | None = None) -> DataFrame:
    """A page of messages in time, with whether another follows: one row more is read than is shown."""
    rows = browse(messages, spec, cursor)
    keys = [F.col(k).desc() if spec.sort == "newest" else F.col(k) for k in ("timestamp", "chat_id", "message_id")]
    more = rows.agg((F.count(F.lit(1)) > spec.page_size).alias("has_more"))
    return rows.orderBy(*keys).limit(spec.page_size).join(F.broadcast(more), F.lit(True))


def kept(searches: DataFrame, last: int = 10) -> DataFrame:
    """The last searches of each owner, and all favourites."""
    newest = W.partitionBy("owner").orderBy(F.col("searched_at").desc(), F.col("search_id").desc())
    return searches.withColumn("_rn", F.row_number().over(newest)).where((F.col("_rn") <= last) | F.col("favourite")).drop("_rn")


def unowned(snapshots: DataFrame, searches: DataFrame) -> DataFrame:
    """Snapshots that no search refers to."""
    return snapshots.distinct().join(searches.select("snapshot_id"), "snapshot_id", "left_anti")


def appended(window: DataFrame, more: DataFrame, last: int = MOST) -> DataFrame:
    """A browse window with a page behind it; only the last rows by place stay."""
    both = window.unionByName(more)
    return both.orderBy(F.col("place").desc()).limit(last)
