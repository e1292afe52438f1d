"""Collocations of two to five words for each language (operator 12).

Texts are read in shards of some million word places. A shard counts its phrases in a trie of limited depth; a trie is serialised as the sorted
table of its paths (one hash a word, zero beyond a node's depth) with counts, cut into ranges by the first two words of a path, and the ranges of all
shards are merged in order. Three scans: words, pairs of words that are frequent by themselves, phrases of three to five words all of whose
pairs are frequent (a phrase is never more frequent than a part of it). What is frequent goes to the next scan as a table of bits of fixed
size: a bit too many costs time, never a result. The first scan also counts pairs in a table of fixed size by their hash: a pair whose slot has too few
occurrences of all pairs together is not frequent, and not counted again.

A node's parent (the path without its last word) is the left part of its last cut, its suffix link (the path without its first word) the right part of its
first. Counts of all left parts are collected along the walk down, those of all right parts along the suffix links, depth by depth.

Words are told apart by 64-bit hashes of language and bytes. The texts behind every hash that matters are compared; if two differ, all is done again with another salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from palimpsest.llm.common import packed, raw, scratch_root, shards_for, ship, slices, staged, text_bytes, trimmed, unpacked
from palimpsest.llm.words import bounds, lowered, mix, span_hashes, whole_hash

#: Words of the longest phrase, least count of a phrase, ranks of a language.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Word places of a shard, bytes of text for each range of paths and most ranges, paths that a merge holds before it sums them.
SHARD = 1 << 21
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 15
HELD = 1 << 21
#: Bits of the table of frequent paths (8 MB), and of one piece of it.
FILTER_BITS, PIECE_BITS = 26, 19

#: Slots of the table of pairs' counts (a byte each in a shard), and of one piece of it.
PAIR_BITS, SLICE_BITS = 23, 18

#: Pieces end at [.,;:!?\x0A-\x0D], words there and at blanks and tabs.
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD_ENDS = PIECE_ENDS.copy()
WORD_ENDS[[0x20, 0x09]] = True
_ODD = np.uint64(0x9FB21C651E98DF25)
PATH = [f"h{k}" for k in range(1, DEPTH + 1)]


class Shard:
    """Word places in order: hash, whether a new piece begins, and, if asked for, where each word stands."""

    def __init__(self, salt: int, texts: bool):
        self.salt, self.texts = np.uint64(salt), texts
        self.hashes: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.places: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.langs: list[str] = []
        self.words: dict[str, int] = {}
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = raw(batch.column("text"))
        low = lowered(data)
        starts, ends, first = bounds(low, offsets, WORD_ENDS)
        langs = batch.column("lang").to_pylist()
        counts = np.diff(first)
        codes = {x: mix(whole_hash(np.frombuffer(x.encode(), np.uint8)) + self.salt * _ODD)[0] for x in set(langs)}
        own = np.repeat(np.array([codes[x] for x in langs], np.uint64), counts)
        for x, n in zip(langs, counts.tolist(), strict=True):
            self.words[x] = self.words.get(x, 0) + n
        hashes = mix((span_hashes(low, starts, ends) ^ own) * _ODD)
        ended = np.concatenate([[0], np.cumsum(PIECE_ENDS[low])])
        begins = np.zeros(len(starts), bool)
        begins[first[:-1][counts > 0]] = True
        begins[1:] |= ended[starts[1:]] != ended[starts[:-1]]
        self.hashes.append(np.maximum(hashes, 1))
        self.begins.append(begins)
        if self.texts:
            self.places.append((low, starts, ends, np.repeat(np.arange(len(langs)) + len(self.langs), counts)))
            self.langs += langs
        self.size += len(starts)

    def word(self, at: int) -> tuple[str, str]:
        """Language and text of the word at a place."""
        for low, starts, ends, langs in self.places:
            if at < len(starts):
                return self.langs[langs[at]], low[starts[at] : ends[at]].tobytes().decode()
            at -= len(starts)
        raise IndexError(at)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and beginnings of all places. The shard lets go of its own."""
        found = np.concatenate([*self.hashes, np.zeros(0, np.uint64)]), np.concatenate([*self.begins, np.zeros(0, bool)])
        self.hashes, self.begins = [], []
        return found


def shards(batches: Iterator[pa.RecordBatch], salt: int, texts: bool = False) -> Iterator[Shard]:
    own = Shard(salt, texts)
    for batch in slices(batches, 1 << 20):
        own.add(batch)
        if own.size >= SHARD:
            yield own
            own = Shard(salt, texts)
    yield own


def slots(path: list[np.ndarray]) -> np.ndarray:
    """Bits of the table of frequent paths."""
    code = np.zeros(len(path[0]), np.uint64)
    for h in path:
        code = mix((code ^ h) * _ODD)
    return (code >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def pair_slots(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (mix((one * _ODD) ^ two) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def marked(bits: np.ndarray, path: list[np.ndarray]) -> np.ndarray:
    at = slots(path)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def numbers(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct rows of two columns of numbers below 2**32, or of one: a place of each, the number of each row, counts."""
    key = columns[0] if len(columns) == 1 else columns[0].astype(np.int64) << 32 | columns[1].astype(np.int64)
    _, at, number, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return at, number, n


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Paths in order, each once, with the sum of its counts. Sorted runs that stand one after the other are merged."""
    columns = [x for x in columns]
    used = [x for x in columns if x.any()] or columns[:1]
    order = np.argsort(used[0], kind="stable") if len(used) == 1 else np.lexsort(used[::-1])
    columns, counts = [x[order] for x in columns], counts[order]
    new = np.zeros(len(counts), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return [x[at] for x in columns], np.add.reduceat(counts, at) if len(at) else counts


def cut(paths: list[np.ndarray], counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A shard's trie as one serialised, sorted run a range. A range is told by the first word and, so that a frequent one is split, three bits of the second."""
    part = (mix((paths[0] * _ODD) ^ (paths[1] >> np.uint64(61) if len(paths) > 1 else np.uint64(0))) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort([*paths[::-1], part]) if len(paths) <= 2 else np.lexsort([*[x for x in paths[::-1] if x.any()], part])
    part = part[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    columns = [x[order] for x in paths]
    counts = counts[order]
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[k], cuts[k + 1])
        run = pa.RecordBatch.from_arrays([*(pa.array(x[own]) for x in columns), pa.array(counts[own])], names=[*PATH[: len(columns)], "n"])
        yield row(k, packed(run))


def row(part: int, data: bytes | None = None, h: int | None = None, lang: str | None = None, word: str | None = None, n: int | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((part, pa.int32()), (data, pa.binary()), (h, pa.int64()), (lang, pa.string()), (word, pa.string()), (n, pa.int64()))], names=["part", "data", "h", "lang", "word", "n"])


RUN = "part int, data binary, h long, lang string, word string, n long"


def frequent(runs: DataFrame, parts: int, least: int) -> DataFrame:
    """Paths of at least least occurrences: h1 to h5, depth, n, slot. Every range is merged by itself, and holds its distinct paths and HELD more at most."""

    def found(held: list[pa.Table]) -> tuple[list[np.ndarray], np.ndarray]:
        names = held[0].column_names[:-1]
        return summed([np.concatenate([t[c].to_numpy() for t in held]) for c in names], np.concatenate([t["n"].to_numpy() for t in held]))

    def out(held: list[pa.Table]) -> pa.RecordBatch:
        paths, n = found(held)
        often = n >= least
        paths, n = [x[often] for x in paths], n[often]
        depth = sum((x > 0).astype(np.int32) for x in paths)
        whole = [*paths, *([np.zeros(len(n), np.uint64)] * (DEPTH - len(paths)))]
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in whole), pa.array(depth, pa.int32()), pa.array(n), pa.array(slots(paths))], names=[*PATH, "depth", "n", "slot"])

    @trimmed
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, part = 0, None
        for batch in batches:
            for own, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if held and own != part:
                    yield out(held)
                    held, size = [], 0
                part = own
                held.append(unpacked(data.as_buffer()))
                size += held[-1].num_rows
                if size > 2 * HELD:
                    paths, n = found(held)
                    held = [pa.table([*paths, n], names=held[0].column_names)]
                    size = max(0, len(n) - HELD)  # what is distinct stays
        if held:
            yield out(held)

    met = runs.where("part >= 0").select("part", "data").repartition(parts, "part").sortWithinPartitions("part")
    return met.mapInArrow(merge, ", ".join(f"{x} long" for x in PATH) + ", depth int, n long, slot long")


def table_of_bits(paths: DataFrame) -> Broadcast:
    """The table of frequent paths, of 2**FILTER_BITS bits whatever their number, for every worker."""

    def pack(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PIECE_BITS, np.uint8)
        bits[group["slot"].to_numpy() & ((1 << PIECE_BITS) - 1)] = 1
        return pa.table({"piece": pa.array([group["piece"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    pieces = paths.select("slot", F.shiftright("slot", PIECE_BITS).alias("piece")).distinct().groupBy("piece").applyInArrow(pack, "piece long, bits binary")
    whole = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    step = (1 << PIECE_BITS) // 8
    for r in pieces.toLocalIterator():
        whole[r.piece * step : (r.piece + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return paths.sparkSession.sparkContext.broadcast(whole)


def counted_words(docs: DataFrame, parts: int, salt: int) -> DataFrame:
    """Runs of depth 1, the number of words of each language (part -1), and the counts of pairs by slots (parts from -2 downwards)."""

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in shards(batches, salt):
            hashes, begins = own.arrays()
            for lang, n in own.words.items():
                yield row(-1, lang=lang, n=n)
            if not len(hashes):
                continue
            words, n = np.unique(hashes, return_counts=True)
            yield from cut([words], n, parts)
            at = np.flatnonzero(~begins[1:])
            slot = pair_slots(hashes[at], hashes[at + 1])
            del hashes, words, n, at
            slot, n = np.unique(slot, return_counts=True)
            table = np.zeros(1 << PAIR_BITS, np.uint8)
            table[slot] = np.minimum(n, 255)
            del slot, n
            for k, piece in enumerate(table.reshape(-1, 1 << SLICE_BITS)):
                if piece.any():
                    yield row(-2 - k, pa.compress(piece.tobytes(), codec="zstd", asbytes=True))

    return docs.mapInArrow(scan, RUN)


def heavy_pairs(runs: DataFrame, least: int) -> Broadcast:
    """The slots of pairs with at least least occurrences (of 255, where shards stop counting), as a table of bits: 1 MB."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                piece = pa.decompress(data.as_buffer(), decompressed_size=1 << SLICE_BITS, codec="zstd")
                sums[part] = sums.get(part, 0) + np.frombuffer(piece, np.uint8).astype(np.int64)
        for part, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(n >= min(least, 255), bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    pieces = 1 << (PAIR_BITS - SLICE_BITS)
    whole, step = np.zeros((1 << PAIR_BITS) // 8, np.uint8), (1 << SLICE_BITS) // 8
    found = runs.where("part < -1").select("part", "data").repartition(pieces, "part").mapInArrow(add, "part int, bits binary")
    for r in found.toLocalIterator():
        k = -2 - r.part
        whole[k * step : (k + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return runs.sparkSession.sparkContext.broadcast(whole)


def counted_pairs(docs: DataFrame, parts: int, salt: int, words: Broadcast, heavy: Broadcast) -> DataFrame:
    """Runs of depth 2 over frequent words, but for pairs that can't be frequent."""

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in shards(batches, salt):
            hashes, begins = own.arrays()
            alive = marked(words.value, [hashes])
            at = np.flatnonzero(alive[:-1] & alive[1:] & ~begins[1:])
            slot = pair_slots(hashes[at], hashes[at + 1])
            at = at[(heavy.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0]
            if not len(at):
                continue
            _, number, _ = numbers(np.where(alive, hashes, np.uint64(0)))
            place, _, n = numbers(number[at], number[at + 1])
            place = at[place]
            yield from cut([hashes[place], hashes[place + 1]], n, parts)

    return docs.mapInArrow(scan, RUN)


def counted_phrases(docs: DataFrame, parts: int, salt: int, pairs: Broadcast) -> DataFrame:
    """Runs of tries from depth 3 to DEPTH over frequent pairs, and the words of such pairs."""

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in shards(batches, salt, texts=True):
            hashes, begins = own.arrays()
            if len(hashes) < 2:
                continue
            alive = np.append(marked(pairs.value, [hashes[:-1], hashes[1:]]) & ~begins[1:], False)
            used = np.flatnonzero(alive | np.append(False, alive[:-1]))
            if not len(used):
                continue
            first, number, _ = numbers(hashes[used])
            words = [own.word(int(used[k])) for k in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * len(first), pa.int32()), pa.nulls(len(first), pa.binary()), pa.array(hashes[used[first]].view(np.int64)), pa.array([x[0] for x in words]), pa.array([x[1] for x in words]), pa.nulls(len(first), pa.int64())],
                names=["part", "data", "h", "lang", "word", "n"],
            )
            word = np.zeros(len(hashes), np.int64)
            word[used] = number
            at = np.flatnonzero(alive)
            _, node, _ = numbers(word[at], word[at + 1])
            paths: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
            counts = []
            for depth in range(3, DEPTH + 1):
                # one word more, where the pair that ends in it is frequent
                on = np.flatnonzero(np.append(alive, np.zeros(DEPTH, bool))[at + depth - 2])
                at, node = at[on], node[on]
                if not len(at):
                    break
                place, node, n = numbers(node, word[at + depth - 1])
                place = at[place]
                for k in range(DEPTH):
                    paths[k].append(hashes[place + k] if k < depth else np.zeros(len(place), np.uint64))
                counts.append(n)
            if counts:
                yield from cut([np.concatenate(x) for x in paths], np.concatenate(counts), parts)

    return docs.mapInArrow(scan, RUN)


def walked(nodes: DataFrame, root: str) -> DataFrame:
    """path, n, lefts and rights (counts of both parts of each cut) and covered (whether a longer phrase around it is as frequent) of all paths of two words or more."""
    path = lambda d: F.array(*PATH[:d])
    above = nodes.where("depth = 1").select(path(1).alias("path"), "n", F.array().cast("array<long>").alias("lefts"), F.array().cast("array<long>").alias("rights"))
    levels = []
    for d in range(2, DEPTH + 1):
        own = nodes.where(F.col("depth") == d).select(path(d).alias("path"), "n", path(d - 1).alias("parent"), F.array(*PATH[1:d]).alias("link"))
        left = above.select(F.col("path").alias("parent"), F.col("n").alias("ln"), "lefts")
        right = above.select(F.col("path").alias("link"), F.col("n").alias("rn"), "rights")
        own = own.join(left, "parent").join(right, "link").select("path", "n", F.concat("lefts", F.array("ln")).alias("lefts"), F.concat(F.array("rn"), "rights").alias("rights"), "parent", "link", "ln", "rn")
        own = staged(own, f"depth{d}", root)
        levels.append(own)
        above = own
    whole = levels[0]
    for x in levels[1:]:
        whole = whole.union(x)
    within = whole.where("ln = n").select(F.col("parent").alias("path")).union(whole.where("rn = n").select(F.col("link").alias("path"))).where(F.size("path") > 1)
    return whole.select("path", "n", "lefts", "rights").join(within.distinct().withColumn("covered", F.lit(True)), "path", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each language (null: und), as the contract of operator 12 has it.

    docs: text and lang; other columns are ignored. A null or empty text has no words; repeated rows count as often as they stand. A table without a phrase of
    least occurrences gives no rows. Ties go by score, then occurrences, then the phrase's bytes, so that ranks are always the same.
    """
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    parts = min(MOST_RANGES, shards_for(text_bytes(given)[1], RANGE_BYTES, 8))
    salt = 0
    while True:
        root = scratch_root(spark)
        runs = staged(counted_words(given, parts, salt), "runs1", root)
        words = staged(frequent(runs, parts, least), "words", root)
        totals = runs.where("part = -1").groupBy("lang").agg(F.sum("n").alias("total"))
        two = staged(counted_pairs(given, parts, salt, table_of_bits(words), heavy_pairs(runs, least)), "runs2", root)
        pairs = staged(frequent(two, parts, least), "pairs", root)
        more = staged(counted_phrases(given, parts, salt, table_of_bits(pairs)), "runs3", root)
        phrases = staged(frequent(more, parts, least), "phrases", root)
        spelt = more.where("part < 0").groupBy("h").agg(F.min(F.struct("lang", "word")).alias("own"), F.max(F.struct("lang", "word")).alias("other"))
        spelt = staged(spelt, "spelt", root)
        if not spelt.where("own <> other").limit(1).count():
            break
        salt += 1
    nodes = words.union(pairs).union(phrases)
    kept = staged(walked(nodes, root).where("not covered").select(F.monotonically_increasing_id().alias("id"), "path", F.col("n").alias("a"), "lefts", "rights"), "kept", root)
    at = kept.select("id", F.posexplode("path").alias("k", "h")).join(spelt.select("h", "own"), "h")
    named = at.groupBy("id").agg(F.min("own.lang").alias("lang"), F.sort_array(F.collect_list(F.struct("k", "own.word"))).alias("words"))  # five words at most
    named = named.select("id", "lang", F.array_join(F.col("words.word"), " ").alias("phrase"))
    whole = kept.join(named, "id").join(totals, "lang")
    # products may pass 64 bits: decimals of 38 digits
    cuts = F.expr("""array_min(transform(sequence(1, size(lefts)), k -> named_struct(
        'score', (1000 * (cast(a as decimal(19, 0)) * cast(total as decimal(19, 0)))) div (cast(lefts[k - 1] as decimal(19, 0)) * cast(rights[k - 1] as decimal(19, 0))),
        'k', k, 'l', lefts[k - 1], 'r', rights[k - 1])))""")
    scored = whole.withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    rank = F.row_number().over(W.Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
