"""Benchmark decontamination over a positional inverted index of the training tokens (operator 9).

The index is a table of segments. A segment holds a run of whole documents: a number of its own, the sorted hashes of its distinct
terms, for each term the ascending positions at which it stands in the segment (the postings), and where each document
starts. Segments are built where the documents are read, so building needs no shuffle, and they are queried one by
one. All phrases of a block of test items are found at once: each starts from the postings of its rarest term, shifted by that term's
place in the phrase, and keeps what it meets in the shifted postings of the other terms, rarest first. A proximity match takes
the terms in any order within a span.

Test items are taken in blocks of bounded size, each broadcast and run against all segments; with several blocks a document's
finds are brought together by segment and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import raw, scratch_root, ship, slices, trimmed
from palimpsest.llm.words import NOT_ALNUM, word_hashes

#: Bytes of text in a segment (a longer document is a segment by itself), and of test items in a broadcast block.
SEGMENT_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20
#: Places that are intersected at once.
AT_ONCE = 1 << 19
INDEX = "segment long, docs binary, nulls binary, first binary, terms binary, counts binary, gaps binary"
HITS = "doc_id long, segment long, place long, n_words long, runs binary, items array<string>"


def build_index(docs: DataFrame, out: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the segments of all rows of docs to the folder out and return them as read back."""
    spark = docs.sparkSession
    ship(spark)

    @trimmed
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, segment_bytes):
            words, first = word_hashes(*raw(batch.column(1)), NOT_ALNUM)
            order = np.argsort(words, kind="stable")
            ranked = words[order]
            new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
            gaps = np.diff(order, prepend=0)
            gaps[new] = order[new]
            ids = batch.column(0)
            row = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), np.asarray(ids.is_null()).astype(np.uint8), first.astype("<i8"), ranked[new].astype("<u8"), np.diff(np.append(new, len(ranked))).astype("<u4"), gaps.astype("<u4")]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=["segment", "docs", "nulls", "first", "terms", "counts", "gaps"])
            number += 1

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow.mapInArrow(segments, INDEX).write.option("compression", "zstd").parquet(out)
    return spark.read.schema(INDEX).parquet(out)


@dataclass
class Segment:
    """One record of the index, opened. at: where each term's postings begin; positions: all postings, term after term."""

    number: int
    docs: np.ndarray
    nulls: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    at: np.ndarray
    positions: np.ndarray
    keys: np.ndarray = field(repr=False)

    @staticmethod
    def of(row: dict) -> "Segment":
        get = lambda name, kind: np.frombuffer(row[name], kind)
        counts = get("counts", "<u4").astype(np.int64)
        at = np.concatenate([[0], np.cumsum(counts)])
        sums = np.cumsum(get("gaps", "<u4"), dtype=np.int64)
        before = np.concatenate([[0], sums])[at[:-1]]
        positions = sums - np.repeat(before, counts)
        # term and position in one number: ascending, so any posting is found by binary search
        keys = np.repeat(np.arange(len(counts)), counts) << 32 | positions
        return Segment(row["segment"], get("docs", "<i8"), get("nulls", np.uint8), get("first", "<i8"), get("terms", "<u8"), at, positions, keys)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Index of each term in this segment, -1 if it doesn't occur."""
        if not len(self.terms):
            return np.full(len(terms), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, place: int) -> np.ndarray:
        return self.positions[self.at[place] : self.at[place + 1]]

    def sizes(self, places: np.ndarray) -> np.ndarray:
        return self.at[places + 1] - self.at[places]

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def listed(self, places: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position stands in the postings of its term."""
        asked = places << 32 | positions
        return self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """windows: a row of places for each phrase, all of which occur here. Pairs of arrays: a phrase and a position at which it starts, within one document."""
        width = windows.shape[1]
        sizes = self.sizes(windows)
        order = np.argsort(sizes, axis=1, kind="stable")
        many = sizes[np.arange(len(windows)), order[:, 0]]
        ends = np.cumsum(many)
        i = 0
        while i < len(windows):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, side="right")))
            own = np.repeat(np.arange(i, j), many[i:j])
            step = np.arange(len(own)) - np.repeat(ends[i:j] - many[i:j] - (ends[i] - many[i]), many[i:j])
            rarest = order[own, 0]
            start = self.positions[self.at[windows[own, rarest]] + step] - rarest
            ok = (start >= 0) & (start + width <= len(self.positions))
            own, start = own[ok], start[ok]
            for k in range(1, width):
                there = order[own, k]
                ok = self.listed(windows[own, there], start + there)
                own, start = own[ok], start[ok]
            ok = self.document(start) == self.document(start + width - 1)
            yield own[ok], start[ok]
            i = j

    def near(self, places: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term around which every term stands within span words (before or after), within one document."""
        order = np.argsort(self.sizes(places), kind="stable")
        centre = self.postings(int(places[order[0]]))
        for k in order[1:]:
            listed = self.postings(int(places[k]))
            here = self.document(centre)
            low = np.searchsorted(listed, np.maximum(centre - span, self.first[here]))
            high = np.searchsorted(listed, np.minimum(centre + span, self.first[here + 1] - 1), side="right")
            centre = centre[high > low]
            if not len(centre):
                break
        return centre


def item_terms(texts: list[str]) -> list[np.ndarray]:
    words, first = word_hashes(*raw(pa.array(texts, pa.string())), NOT_ALNUM)
    return [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """The test items with words as (id, terms), in blocks whose size is bounded; the driver holds one block at a time."""

    def opened(block: list) -> list[tuple[str | None, np.ndarray]]:
        return [(i, t) for (i, _), t in zip(block, item_terms([x for _, x in block]), strict=True) if len(t)]

    block: list = []
    size = 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text)
        if size >= block_bytes:
            yield opened(block)
            block, size = [], 0
    yield opened(block)


def windows_of(sizes: np.ndarray, window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: the item and the first word (in all items end to end) of every window."""
    at = np.cumsum(sizes) - sizes
    out = {}
    for width in np.unique(np.minimum(sizes, window)).tolist():
        own = np.flatnonzero(np.minimum(sizes, window) == width)
        many = sizes[own] - width + 1
        item = np.repeat(own, many)
        out[width] = item, at[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    return out


def search(index: DataFrame, block: list[tuple[str | None, np.ndarray]], window: int, span: int | None) -> DataFrame:
    """A row for each document: its words, the runs of hit words (start and end in the document) and the items found."""
    asked = index.sparkSession.sparkContext.broadcast(([i for i, _ in block], np.concatenate([np.zeros(0, np.uint64), *(t for _, t in block)]), np.array([len(t) for _, t in block], np.int64)))

    def hits_in(segment: Segment, flat: np.ndarray, windows: dict) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Item and position of each find, and the number of words it hits."""
        places = segment.places(flat)
        missing = np.concatenate([[0], np.cumsum(places < 0)])
        for width, (item, start) in windows.items():
            here = np.flatnonzero(missing[start + width] == missing[start])
            own = places[start[here][:, None] + np.arange(width)]
            if span is None:
                for which, position in segment.phrases(own):
                    yield item[here[which]], position, width
            else:
                for k, terms in zip(here.tolist(), own, strict=True):
                    position = segment.near(terms, span)
                    yield np.full(len(position), item[k]), position, 1

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, flat, sizes = asked.value
        windows = windows_of(sizes, window)
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment.of(batch.slice(k, 1).to_pylist()[0])
                n, words = len(segment.docs), int(segment.first[-1])
                mark, pairs = np.zeros(words + 1, np.int64), [np.zeros(0, np.int64)]
                for item, position, length in hits_in(segment, flat, windows):
                    mark += np.bincount(position, minlength=words + 1) - np.bincount(position + length, minlength=words + 1)
                    pairs.append(np.unique(segment.document(position) * len(names) + item))
                hit = np.concatenate([[0], np.cumsum(mark)[:-1] > 0, [0]]).astype(np.int8)
                items: dict[int, list[str | None]] = {}
                for d, i in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(pairs)), max(1, len(names)))), strict=True):
                    items.setdefault(d, []).append(names[i])
                runs = []
                for d in range(n):
                    own = hit[segment.first[d] + 1 : segment.first[d + 1] + 1] if d in items else hit[:0]
                    edges = np.diff(np.concatenate([[0], own, [0]]))
                    runs.append(np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1).astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.docs, mask=segment.nulls.astype(bool)), pa.array(np.full(n, segment.number)), pa.array(np.arange(n)), pa.array(np.diff(segment.first)), pa.array(runs, pa.binary()), pa.array([items.get(d, []) for d in range(n)], pa.list_(pa.string()))],
                    names=["doc_id", "segment", "place", "n_words", "runs", "items"],
                )

    return index.mapInArrow(run, HITS)


def summed(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from the runs and items of each document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digests = [], [], []
            for runs, items in zip(batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                spans = np.frombuffer(runs, "<i8").reshape(-1, 2)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                before = np.concatenate([[0], np.maximum.accumulate(spans[:, 1])[:-1]]) if len(spans) else np.zeros(0, np.int64)
                n_hit.append(int(np.maximum(0, spans[:, 1] - np.maximum(spans[:, 0], before)).sum()))
                names = set(items)
                n_items.append(len(names))
                digests.append(hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest())
            words = batch.column("n_words").to_numpy(zero_copy_only=False)
            hit = np.array(n_hit, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit), pa.array(n_items, pa.int64()), pa.array(digests), pa.array((hit > 0) & (20 * hit >= words))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return hits.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, span: int | None = None, out: str | None = None, block_bytes: int = BLOCK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """For each row of docs its words, the words inside any occurrence of a window of a test item, and those items.

    A window is window consecutive words of an item, or the whole item if it has fewer but some. With span, a window
    matches by proximity instead: around a place of its rarest word, every word within span words; that place alone is hit. Null texts have no
    words; null item texts and items without words match nothing. Items with a null id are searched and hit as others: together they count as
    one item, and their name is left out of items_sha256. Items that share an id count once. Rows that share a doc_id each give a row; an
    empty table on either side is fine; other columns are ignored.
    """
    index = build_index(docs, out or f"{scratch_root(docs.sparkSession)}/index", segment_bytes)
    found = [search(index, block, window, span) for block in blocks(items, block_bytes)]
    if len(found) == 1:
        return summed(found[0])
    union = found[0]
    for more in found[1:]:
        union = union.union(more)
    merged = union.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_join(F.collect_list(F.hex("runs")), "").alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    return summed(merged.select("doc_id", "n_words", F.unhex("runs").alias("runs"), "items"))
