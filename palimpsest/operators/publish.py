"""Work that is built aside and published by segment, and searches over revisions that are held while they run."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.store import PartitionedStore, Store, Superseded
from palimpsest.sources.exports import staged

SEGMENT = ["chat_id", "day"]


def due(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments (chat_id, day, generation) whose target is beyond what is published of them."""
    done = chunks.groupBy(*SEGMENT).agg(F.max("generation").alias("_done"))
    aims = targets.select(*SEGMENT, F.col("target_generation").alias("generation"))
    return aims.join(done, SEGMENT, "left").where("_done is null or _done < generation").drop("_done")


def build(targets: Store, chunks: PartitionedStore, make: Callable[[DataFrame], DataFrame], encode: Callable[[DataFrame], DataFrame] | None = None, times: int = 3) -> DataFrame:
    """Build what is due and publish it; returns chat_id, day, generation and state (published or superseded) of each segment that was due.

    make gives the chunk rows (chat_id, day and more) of the segments it gets, encode adds their vectors; both are written to the shared folder before anything is
    published, so a lost executor or a second attempt repeats neither. A segment is published if its target is still the one that was read:
    all of its chunks in one version, with a row in the version's outbox, or none. Another publisher in between means another look at the targets.
    """
    with targets.pin() as read:
        aims = staged(due(read.read(), chunks.read()), "due")
        rows = make(aims.select(*SEGMENT)).join(aims, SEGMENT)
        rows = staged(encode(rows) if encode else rows, "built")
    for k in range(times):
        now = targets.read().select(*SEGMENT, F.col("target_generation").alias("_now"))
        fit = staged(aims.join(now, SEGMENT, "left").select(*aims.columns, F.when(F.col("_now") == F.col("generation"), "published").otherwise("superseded").alias("state")), "fit")
        good = fit.where("state = 'published'").drop("state")
        touched = chunks.touched(good)
        if not touched:
            return fit
        base = chunks.at()
        old = chunks.only(base, chunks.named(touched, base))
        # a publisher of a later generation may have come first
        beyond = old.groupBy(*SEGMENT).agg(F.max("generation").alias("_there")).join(good, SEGMENT).where("_there > generation")
        if beyond.limit(1).count():
            fit = staged(fit.join(beyond.select(*SEGMENT, F.lit(True).alias("_beyond")), SEGMENT, "left").select(*aims.columns, F.when(F.col("_beyond"), "superseded").otherwise(F.col("state")).alias("state")), "fit")
            good = fit.where("state = 'published'").drop("state")
            touched = chunks.touched(good)
            old = chunks.only(base, chunks.named(touched, base))
        try:
            # other segments of the same folders stay as they are
            rest = old.join(good, SEGMENT, "left_anti")
            chunks.replace(rest.unionByName(rows.join(good, [*SEGMENT, "generation"], "left_semi").select(*old.columns)), touched, base, outbox=good)
            return fit
        except Superseded:
            if k == times - 1:
                raise
    raise ValueError("times must be positive")


@dataclass(frozen=True)
class Found:
    """rows: a page, written; scope: rows that were eligible; revisions: the versions that were read; changed: stores that had gone on when the search ended."""

    rows: DataFrame
    scope: int
    revisions: dict[str, int]
    changed: list[str]


def pinned_search(stores: dict[str, Store], scope: Callable[[dict[str, DataFrame]], DataFrame], search: Callable[[dict[str, DataFrame], DataFrame], DataFrame]) -> Found:
    """search over the versions of all stores that counted when it began, whatever is published or cleaned meanwhile.

    scope gives the eligible rows; if there are none, nothing is searched. A caller whose page must be of the latest revision searches again if something changed.
    """
    with ExitStack() as held:
        pins = {name: held.enter_context(store.pin()) for name, store in stores.items()}
        frames = {name: pin.read() for name, pin in pins.items()}
        eligible = scope(frames)
        n = eligible.count()
        found = search(frames, eligible)
        rows = staged(found, "page") if n else found.limit(0)
        changed = [name for name, pin in pins.items() if pin.moved()]
        return Found(rows, n, {name: pin.version.number for name, pin in pins.items()}, changed)
