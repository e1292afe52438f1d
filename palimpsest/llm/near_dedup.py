"""Near-duplicate documents by one-permutation MinHash (operator 2).

1. Each document becomes a set of word shingles (64-bit hashes). Equal sets are one class, whatever their number.
2. One hash splits a class's shingles over bins; the least hash of a bin is its value. An empty bin takes the value
   of a bin that a fixed random sequence of bins meets first (optimal densification).
3. Bands of bins give bucket keys. A bucket links its members to one hub: a star, not all pairs.
4. Every candidate pair is confirmed on full sets, built again from the two texts.
5. A star can miss a link between two members that are both unlike the hub. All members of buckets that still span
   several components are therefore joined once more, exactly, by prefix filtering on their rarest shingles.
   So a link is lost only if the two sets share no bucket.

With 40 bands of 5 bins two sets of similarity 0.8 share no bucket with probability 1.2e-7. Small sets hold too few
values for that estimate, but a similar one can only have one shingle more or less, so their keys are
exact: the set itself, and the set without each of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import numbered, raw, scratch_root, shards_for, ship, slices, staged, text_bytes, trimmed, unstage
from palimpsest.llm.components import components
from palimpsest.llm.words import mix, word_hashes

BANDS, ROWS = 40, 5
#: Sets below LEAST shingles are similar to equal ones only. Up to SMALL, a similar one has one shingle more or less.
LEAST, SMALL = 4, 8
#: Bits of the table that orders shingles by rarity, and sets of a shingle beyond which its entries are dealt to several ranges.
ORDER_BITS = 20
HOT = 4096
#: Bytes of text for each range of shingles, pairs that are compared at once, members that meet one copy of their hub.
RANGE_BYTES = 16 << 20
AT_ONCE = 1 << 20
MEMBERS = 256
#: Ids that travel to the texts instead of the texts to them: 8 MB.
FEW = 1_000_000
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than width are one shingle."""
    if not len(words):
        return words
    width_here = min(width, len(words))
    out = words[: len(words) - width_here + 1].copy()
    for k in range(1, width_here):
        out = mix(out * _ODD + words[k : len(words) - width_here + 1 + k])
    return np.unique(mix(out + np.uint64(width_here)))


def densified(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Bin values of a sorted set: the least hash in each of bins equal ranges, empty ones filled from others."""
    width = np.uint64(2**64 // bins + 1)
    own = (hashes // width).astype(np.int64)
    first = np.searchsorted(own, np.arange(bins))
    full = np.zeros(bins, bool)
    full[own] = True
    values = hashes[np.minimum(first, len(hashes) - 1)]
    empty = np.flatnonzero(~full)
    attempt = 0
    source = np.arange(bins)
    while len(empty):
        attempt += 1
        pick = (mix(empty.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        found = full[pick]
        source[empty[found]] = pick[found]
        empty = empty[~found]
    return values[source]


def keys_of(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket keys of a set."""
    n, total = len(hashes), hashes.sum(dtype=np.uint64)
    exact = []
    if LEAST <= n <= SMALL:
        exact.append(np.array([total]))
    if LEAST < n <= SMALL + 1:
        exact.append(total - hashes)
    keys = [mix(x ^ np.uint64(0xA5A5A5A5)) for x in exact]
    if n >= SMALL:
        values = densified(hashes, bands * rows).reshape(bands, rows)
        banded = np.arange(1, bands + 1, dtype=np.uint64) * _ODD
        for k in range(rows):
            banded = mix(banded ^ values[:, k])
        keys.append(banded)
    return np.concatenate([*keys, np.zeros(0, np.uint64)])


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """row, doc_id, n_shingles, a 128-bit hash of the set (hi, lo) and its bucket keys."""

    @trimmed
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            words, first = word_hashes(*raw(batch.column(2)))
            sets = [shingles(words[a:b], width) for a, b in zip(first[:-1], first[1:], strict=True)]
            keys = [keys_of(x, bands, rows) if len(x) else np.zeros(0, np.uint64) for x in sets]
            lo = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
            hi = np.array([np.bitwise_xor.reduce(mix(x + _ODD)) if len(x) else 0 for x in sets], np.uint64)
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                names=["row", "doc_id", "n_shingles", "hi", "lo", "keys"],
            )

    return docs.mapInArrow(sign, "row long, doc_id long, n_shingles long, hi long, lo long, keys array<long>")


def among(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose row is in asked (staged). Up to FEW ids travel to the rows; of more, both sides are shuffled."""
    few = asked.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(asked) if few else asked, "row", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, root: str, name: str) -> DataFrame:
    """The pairs (a, b) of rows whose full sets reach the similarity. pairs: distinct, and staged.

    A hub's members are dealt to blocks of about MEMBERS; the hub's text goes to each block once, in front of its members' texts.
    """
    asked = staged(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), f"asked_{name}", root)
    texts = staged(among(docs, asked).select("row", "text"), f"texts_{name}", root)
    many = staged(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("blocks")), f"hubs_{name}", root)
    placed = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
    members = placed.join(texts.withColumnRenamed("row", "b"), "b").select("a", "block", "b", "text")
    hubs = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(texts.withColumnRenamed("row", "a"), "a")
    both = members.union(hubs.select("a", "block", F.lit(None).cast("long").alias("b"), "text"))
    met = both.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    @trimmed
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set = np.zeros(0, np.uint64)
        for batch in slices(batches, 1 << 20):
            words, first = word_hashes(*raw(batch.column("text")))
            keep = []
            for i, hub in enumerate(batch.column("b").is_null().to_pylist()):
                mine = shingles(words[first[i] : first[i + 1]], width)
                if hub:
                    hub_set = mine
                    continue
                short, long = (mine, hub_set) if len(mine) < len(hub_set) else (hub_set, mine)
                at = np.searchsorted(long, short)
                n = int((long[np.minimum(at, len(long) - 1)] == short).sum()) if len(short) else 0
                if n and 100 * n >= percent * (len(mine) + len(hub_set) - n):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return staged(met.mapInArrow(check, "a long, b long"), f"links_{name}", root)


def completed(rest: DataFrame, docs: DataFrame, size: int, width: int, percent: int, root: str) -> DataFrame:
    """All links between different components of rest (row, component), whether their sets share a bucket or not. size: bytes of all texts.

    Exact, by prefix filtering: with shingles in one order, rarest first, two similar sets share one within the first
    n - ceil(2 s n / (1 + s)) + 1 of the smaller and the first n - ceil(s n) + 1 of the larger, s the similarity asked for. The order goes
    by counts of hash buckets of fixed number. Copies of one base with too many edits of their own have these edits in front and meet
    nobody. Shingles travel as packed arrays by ranges of their hash; within a range, those of one component alone are dropped.
    A shingle of more than HOT sets has its larger sides dealt to several ranges, and its smaller sides sent to each of them.
    """
    spark = docs.sparkSession
    texts = staged(among(docs, rest.select("row")).select("row", "text").join(rest, "row").select("row", "component", "text"), "rest_texts", root)
    parts = shards_for(size, RANGE_BYTES, 8)
    share = percent / 100

    def sets(batch: pa.RecordBatch) -> list[np.ndarray]:
        words, first = word_hashes(*raw(batch.column("text")))
        return [shingles(words[a:b], width) for a, b in zip(first[:-1], first[1:], strict=True)]

    @trimmed
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in slices(batches, 1 << 20):
            for x in sets(batch):
                seen += np.bincount((x >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], names=["slot", "n"])

    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for r in texts.select("text").mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.slot] = r.n
    shared = spark.sparkContext.broadcast(counts)

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, 1 << 20):
            columns: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in (np.uint64, "<i8", "<i8", "<u4", "<u4", "u1", "<i8")]
            rows, components = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "component"))
            for row, component, x in zip(rows, components, sets(batch), strict=True):
                n, often = len(x), known[(x >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                order = np.lexsort((x, often))
                wide = n - int(np.ceil(share * n - 1e-9)) + 1
                small = n - int(np.ceil(2 * share / (1 + share) * n - 1e-9)) + 1
                tokens, often = x[order[:wide]], often[order[:wide]]
                spread = -(-often // HOT)
                for kind, some in ((0, slice(0, small)), (1, slice(0, wide))):
                    own, times = tokens[some], spread[some]
                    copies = times if kind == 0 else np.ones_like(times)
                    key = np.repeat(own, copies)
                    lane = np.arange(len(key)) - np.repeat(np.cumsum(copies) - copies, copies) if kind == 0 else int(mix(np.array([row]).astype(np.uint64))[0] >> np.uint64(8)) % times
                    place = np.repeat(np.arange(len(own)), copies)
                    for k, v in enumerate((key, np.full(len(key), row), np.full(len(key), component), np.full(len(key), n), place, np.full(len(key), kind), lane)):
                        columns[k].append(v)
            key, row, component, n, place, kind, lane = (np.concatenate(x) for x in columns)
            part = (mix(key + lane.astype(np.uint64) * _ODD) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cuts))
            packed = {"part": pa.array(full, pa.int32())}
            for name, v in (("key", key.astype("<u8")), ("row", row.astype("<i8")), ("component", component.astype("<i8")), ("n", n.astype("<u4")), ("place", place.astype("<u4")), ("kind", kind.astype("u1"))):
                own = v[order]
                packed[name] = pa.array([own[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())
            yield pa.RecordBatch.from_pydict(packed)

    @trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["part"], []).append(r)
        for records in held.values():
            got = {k: np.concatenate([np.frombuffer(r[k], kind) for r in records]) for k, kind in (("key", "<u8"), ("row", "<i8"), ("component", "<i8"), ("n", "<u4"), ("place", "<u4"), ("kind", "u1"))}
            yield from pairs_of(got, share)

    found = texts.mapInArrow(cut, "part int, key binary, row binary, component binary, n binary, place binary, kind binary").repartition(parts, "part")
    pairs = staged(found.mapInArrow(meet, "a long, b long").distinct(), "pairs", root)
    return confirmed(pairs, docs, width, percent, root, "rest")


def pairs_of(got: dict[str, np.ndarray], share: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of different components that share a shingle at places which leave the overlap their sizes need. kind 0: smaller sides, 1: larger ones."""
    order = np.lexsort((got["kind"], got["key"]))
    got = {k: v[order] for k, v in got.items()}
    start = np.flatnonzero(np.concatenate([[True], got["key"][1:] != got["key"][:-1]])) if len(order) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(order))
    open_ = np.minimum.reduceat(got["component"], start) != np.maximum.reduceat(got["component"], start) if len(start) else np.zeros(0, bool)
    start, end = start[open_], end[open_]
    larger = np.concatenate([[0], np.cumsum(got["kind"], dtype=np.int64)])
    middle = end - (larger[end] - larger[start])
    for a, m, b in zip(start.tolist(), middle.tolist(), end.tolist(), strict=True):
        step = max(1, AT_ONCE // max(1, b - m))
        for i in range(a, m, step):
            x, y = np.divmod(np.arange(min(step, m - i) * (b - m)), max(1, b - m))
            x, y = x + i, y + m
            n, other = got["n"][x].astype(np.int64), got["n"][y].astype(np.int64)
            ok = (got["component"][x] != got["component"][y]) & (n >= np.ceil(share * other - 1e-9)) & ((n < other) | ((n == other) & (got["row"][x] < got["row"][y])))
            reach = np.minimum(n - got["place"][x], other - got["place"][y])
            ok &= reach >= np.ceil(share / (1 + share) * (n + other) - 1e-9)
            one, two = got["row"][x[ok]], got["row"][y[ok]]
            if len(one):
                code = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(code[0]), pa.array(code[1])], names=["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept of each row of docs.

    Two rows are linked if 100 * |A & B| >= percent * |A | B| for their sets of width-word shingles over
    ASCII-lower-cased words parted by ASCII white space; a text of fewer words is one shingle. Null texts and texts
    without words have an empty set, link with nothing and are their own component. Equal sets are linked. Rows that share a doc_id
    are documents of their own, each linked by its own text; kept is doc_id = component_id for each of them. Null doc_ids come
    last: a row with one gets a null component, and isn't kept, unless a row with an id is reachable. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    root = scratch_root(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = numbered(given, root, nulls_first=False)
    size = text_bytes(docs)[1]
    signed = staged(signatures(docs.select("row", "doc_id", "text"), width, bands, rows), "signatures", root)
    some = signed.where("n_shingles > 0")
    # a class of equal sets is stood for by its smallest row; it is written, so that a large class can be split where it is joined
    classes = staged(some.groupBy("hi", "lo", "n_shingles").agg(F.min("row").alias("node"), F.min("doc_id").alias("id")), "classes", root)
    first = classes.select(F.col("node").alias("row"))
    entries = staged(among(some, first).select(F.col("row").alias("node"), F.explode(F.array_distinct("keys")).alias("key")), "entries", root)
    # buckets with more than one class link their members to one hub
    hubs = staged(entries.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub"), "hubs", root)
    shared = staged(entries.join(hubs, "key").select("key", "node", "hub"), "shared", root)
    stars = staged(shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars", root)
    unstage(spark, root, "entries", "hubs")
    links = confirmed(stars, docs, width, percent, root, "stars")
    labels = staged(components(links), "labels", root)
    unstage(spark, root, "stars", "texts_stars")
    # what stands in a bucket that still spans components
    placed = shared.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("two")).where("one <> two").select("key")
    rest = staged(placed.join(mixed, "key", "left_semi").select(F.col("node").alias("row"), "component").distinct(), "rest", root)
    more = completed(rest, docs, size, width, percent, root)
    joined = staged(components(links.union(more)), "components", root)
    ids = classes.select(F.col("node").alias("component"), F.col("id").alias("component_id"))
    # a component's smallest doc_id is that of its smallest row, for null doc_ids come last
    named = classes.join(joined, "node", "left").select("hi", "lo", "n_shingles", F.coalesce("component", "node").alias("component")).join(ids, "component").select("hi", "lo", "n_shingles", "component_id")
    named = staged(named, "named", root)
    found = signed.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
