"""Token-ID files under Re-Pair grammar compression (operator 1).

Documents are dealt by doc_id range and sorted, so the files hold them in ascending doc_id order. Each shard (a
run of documents of bounded size) is one record: the final sequence, the rules (pairs of symbols), the expansion
length of every rule and where each document starts in the sequence and in the tokens. A document starts on a
symbol of its own, so one can be decoded without the rest of its shard.

Rounds of Re-Pair replace many frequent pairs at once instead of one: all pairs that occur often enough become
rules in order of frequency, and occurrences that overlap within a run of equal symbols alternate. Rounds go on until no pair
occurs often enough. Decoding is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import fixed_workers, raw, scratch_root, shards_for, ship, slices, text_bytes, trimmed
from palimpsest.llm.words import HashTable, bounds, lowered, span_hashes

#: Bytes of text of a range partition, and tokens of a shard (a longer document is a shard by itself).
RANGE_BYTES = 16 << 20
SHARD_TOKENS = 1 << 18
#: Shards whose places travel to the files: 24 MB.
FEW = 1_000_000
#: Words whose ids a worker keeps; beyond, it starts anew.
CACHE_SIZE = 1_000_000
#: Re-Pair: least occurrences of a pair that becomes a rule, most rules of a round (there are as many rounds as it takes).
LEAST = 8
RULES = 1 << 14
#: Bits of the hash that bins pairs in a round.
BINS = 18

FILE = "shard_range long, part long, docs binary, nulls binary, lengths binary, places binary, sequence binary, left binary, right binary, expansion binary, base long, n_ids long"

#: Bytes of letters that stay single when lower-cased and composed: ASCII, and those behind 0xC3 but for two signs; bytes of stops.
LETTERS, STOPS = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
STOPS[[*b".,;:!?"]] = True
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
_workers: dict[tuple, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts by the tokenizer at path, word by word where the tokenizer drops white space between words."""

    def __init__(self, path: str, size: int = CACHE_SIZE):
        fixed_workers()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = size
        self.reset()
        self.words = self.drops_blanks()
        self.fast = None
        if self.words:
            self.fast = Tokenizer.from_file(path)
            self.fast.normalizer = None
            self.fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.final[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
            # another tokenizer may mark nothing, or keep case: then every word is encoded as it is
            probe = "Az über, Éa ß. ... ,;! zebra? KÀ:".split()
            data = np.frombuffer(" ".join(probe).encode(), np.uint8)
            ends = np.cumsum([len(x.encode()) + 1 for x in probe]) - 1
            got, sizes = self.encode_words(data, np.append(0, ends[:-1] + 1), ends)
            want = [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
            if got.tolist() != list(chain.from_iterable(want)) or sizes.tolist() != [len(x) for x in want]:
                self.fast = None
            self.reset()

    def drops_blanks(self) -> bool:
        """Whether a text's ids are those of its blank-separated words end to end: tried on a text that joins all kinds."""
        words = ["Az", "'s", "a'll", "1", "23", "..", "é", "<|x", "é́", "中"]
        ids = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in words]
        joined = [(" ", " "), ("\n", "\t "), (" \r\n", "\x0b\x0c")]
        pairs = [(a, b) for a in range(len(words)) for b in range(len(words))]
        return all(self.tokenizer.encode(f"{words[a]}{s}{words[b]}{e}", add_special_tokens=False).ids == ids[a] + ids[b] for a, b in pairs for s, e in joined)

    def reset(self) -> None:
        self.table, self.pool, self.used = HashTable(20), np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.units = HashTable(20)
        self.unit_ids, self.unit_size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode_each(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans of data end to end, and how many each has, each encoded by itself."""
        blob = data.tobytes()
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([blob[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for lower-cased units, many at a time and without the normalizer: a unit's last id is marked by the vocabulary."""
        flat, sizes = [], []
        for k in range(0, len(starts), 4096):
            a, n = starts[k : k + 4096], ends[k : k + 4096] - starts[k : k + 4096]
            at = np.cumsum(n + 1) - n - 1
            spaced = np.full(int((n + 1).sum()), 0x20, np.uint8)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            spaced[np.repeat(at, n) + inside] = data[np.repeat(a, n) + inside]
            got = np.array(self.fast.encode_batch_fast([spaced.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.final[got]) + 1
            if len(stops) != len(a):
                got, own = self.encode_each(data, a, ends[k : k + 4096])
            else:
                own = np.diff(stops, prepend=0)
            flat.append(got)
            sizes.append(own)
        return np.concatenate([*flat, np.zeros(0, np.uint32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (spans of data) end to end, and how many each has.

        Words of letters and stops are taken apart; their units, in lower case, are encoded once each. Other words are encoded as they are.
        """
        if self.fast is None:
            return self.encode_each(data, starts, ends)
        low = lowered(data)
        behind = np.flatnonzero(data[:-1] == 0xC3) + 1
        behind = behind[LATIN[data[behind]]]
        letter, stop = LETTERS[data], STOPS[data]
        letter[behind] = letter[behind - 1] = True
        upper = behind[data[behind] < 0x9F]
        low[upper] += 0x20
        before = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        letters, stops = before(letter), before(stop)
        middle = starts + letters[ends] - letters[starts]
        simple = (letters[middle] - letters[starts] == middle - starts) & (stops[ends] - stops[middle] == ends - middle)
        one, two = np.flatnonzero(simple & (middle > starts)), np.flatnonzero(simple & (ends > middle))
        a, b = np.concatenate([starts[one], middle[two]]), np.concatenate([middle[one], ends[two]])
        order = np.argsort(a)  # spans in order, for their hashes
        hashes = np.zeros(len(a), np.uint64)
        hashes[order] = span_hashes(low, a[order], b[order])
        place = self.units.get(hashes)
        rest = np.flatnonzero(place < 0)
        fresh, where, inverse = np.unique(hashes[rest], return_index=True, return_inverse=True)
        where = rest[where]
        unit_ids, unit_size = self.encode_units(low, a[where], b[where])
        new = np.arange(len(self.unit_size), len(self.unit_size) + len(fresh))
        self.units.put(fresh, new)
        place = place.astype(np.int64)
        place[rest] = new[inverse]
        odd = np.flatnonzero(~simple)
        odd_ids, odd_size = self.encode_each(data, starts[odd], ends[odd])
        self.unit_ids, self.unit_size = np.concatenate([self.unit_ids, unit_ids]), np.concatenate([self.unit_size, unit_size])
        pool, size = np.concatenate([self.unit_ids, odd_ids]), np.concatenate([self.unit_size, odd_size])
        both = np.full((len(starts), 2), -1, np.int64)
        both[one, 0], both[two, 1] = place[: len(one)], place[len(one) :]
        both[odd, 0] = len(self.unit_size) + np.arange(len(odd))
        both = both.ravel()
        ends_at = np.cumsum(size)
        sizes = np.where(both >= 0, size[both], 0) if len(size) else np.zeros(len(both), np.int64)
        total = np.cumsum(sizes)
        source = np.repeat(ends_at[both] - size[both] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0) if len(size) else np.zeros(0, np.int64)
        return pool[source], sizes.reshape(-1, 2).sum(1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if not self.words:
            blob = data.tobytes()
            ids = [np.array(self.tokenizer.encode(blob[a:b].decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)
        starts, ends, first = bounds(data, offsets)
        hashes = span_hashes(data, starts, ends)
        found = self.table.get(hashes)
        rest = np.flatnonzero(found < 0)
        if len(rest):
            if len(self.at) + len(rest) > self.limit or len(self.unit_size) > self.limit // 2:
                self.reset()
                rest, found = np.arange(len(hashes)), found
            fresh, where, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
            at = rest[where]
            flat, sizes = self.encode_words(data, starts[at], ends[at])
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            new = np.arange(len(self.at), len(self.at) + len(fresh), dtype=np.int64)
            self.at = np.concatenate([self.at, self.used + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.used += len(flat)
            self.table.put(fresh, new)
            found[rest] = new[back]
        sizes = self.size[found]
        total = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.at[found] - total[:-1], sizes) + np.arange(total[-1])
        return self.pool[source], total[first[1:]] - total[first[:-1]]


def encoder(path: str, size: int) -> WordEncoder:
    if (path, size) not in _workers:
        _workers.clear()
        _workers[path, size] = WordEncoder(path, size)
    return _workers[path, size]


def frequent_pairs(seq: np.ndarray, places: np.ndarray, least: int, rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The most frequent pairs that begin at places and do so least times, where they stand, their rank there, and whether there were more than rules.

    Pairs are counted exactly; where places are many, only at those whose bin of a hash holds least of them.
    """
    one, two = seq[places], seq[places + 1]
    if len(places) > 1 << BINS - 4:
        bins = ((one * np.uint32(0x9E3779B1) + two) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BINS)).astype(np.int64)
        some = (np.bincount(bins, minlength=1 << BINS) >= least)[bins]
        places, one, two = places[some], one[some], two[some]
    pairs, back, counts = np.unique(one.astype(np.int64) << 32 | two, return_inverse=True, return_counts=True)
    order = np.lexsort((pairs, -counts))[: int((counts >= least).sum())]
    rule_of = np.full(len(pairs), -1, np.int32)
    rule_of[order[:rules]] = np.arange(min(rules, len(order)), dtype=np.int32)
    rank = rule_of[back]
    return pairs[order[:rules]], places[rank >= 0], rank[rank >= 0], len(order) > rules


def apart(hit: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits without neighbours: of two the better-ranked stays, equal ones alternate from the start of their run. A hit beaten by one that goes too may return in the next round."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(64):
        joined = np.diff(hit) == 1
        # hits that stand alone are settled
        alone = np.ones(len(hit), bool)
        alone[:-1] &= ~joined
        alone[1:] &= ~joined
        done.append((hit[alone], rank[alone]))
        hit, rank = hit[~alone], rank[~alone]
        if not len(hit):
            break
        near = np.diff(hit) == 1
        a, b = rank[:-1], rank[1:]
        lose = np.zeros(len(hit), bool)
        lose[:-1] = near & (b < a)
        lose[1:] |= near & (a < b)
        same = np.zeros(len(hit), bool)
        same[1:] = near & (a == b)
        if same.any():
            index = np.arange(len(hit))
            run = index - np.maximum.accumulate(np.where(same, -1, index))
            lose |= same & (run % 2 == 1)
        hit, rank = hit[~lose], rank[~lose]
    hit, rank = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(hit)
    return hit[order], rank[order]


def touched(keep: np.ndarray, hit: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Where, among the places that are kept, pairs begin that a round has changed (beside a replaced hit) or left over (other hits)."""
    gone, n = hit + 1, len(keep) - len(hit)
    changed = np.concatenate([hits[keep[hits]], hit])
    if len(hits) * 32 > len(keep):  # many: by a mark for each place
        moved = np.cumsum(keep) - 1
        near = np.zeros(n + 1, bool)
        near[moved[changed]] = True
        near[moved[hit] - 1] = True  # of the first place, the last entry
        return np.flatnonzero(near[: n - 1])
    places = np.concatenate([changed, hit - 1])
    places = places - np.searchsorted(gone, places)
    return np.unique(places[(places >= 0) & (places < n - 1)])


def compress(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, rules: int = RULES) -> dict[str, np.ndarray]:
    """Re-Pair over one shard, until no pair occurs least times; no rule spans one of starts. Symbols below base are ids, base + i is rule i. rules: most in a round.

    A pair that was not frequent can only become so with a symbol of the round before, and one that was is left only where a better pair came first:
    the next round looks at these places alone, unless there were more pairs than rules.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    seq, first = ids.astype(np.uint32), np.zeros(len(ids) + 1, bool)
    first[starts] = True
    first = first[: len(ids)]
    left, right = [], []
    top, open_ = base, None
    while len(seq) > 1:
        places = np.arange(len(seq) - 1) if open_ is None else open_
        chosen, hit, rank, more = frequent_pairs(seq, places[~first[places + 1]], least, rules)
        if not len(chosen):
            break
        hits = hit
        hit, rank = apart(hit, rank)
        seq[hit] = (top + rank).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        open_ = None if more else touched(keep, hit, hits)
        seq, first = seq[keep], first[keep]
        left.append(chosen >> 32)
        right.append(chosen & 0xFFFFFFFF)
        top += len(chosen)
    left = np.concatenate(left) if left else np.zeros(0, np.int64)
    right = np.concatenate(right) if right else np.zeros(0, np.int64)
    size: list[int] = []
    for a, b in zip((left - base).tolist(), (right - base).tolist(), strict=True):
        size.append((size[a] if a >= 0 else 1) + (size[b] if b >= 0 else 1))
    return {"sequence": seq.astype("<u4"), "left": left.astype("<u4"), "right": right.astype("<u4"), "expansion": np.array(size, "<u4"), "places": np.flatnonzero(first).astype("<u4"), "base": base}


def expand(symbols: np.ndarray, base: int, left: np.ndarray, right: np.ndarray, expansion: np.ndarray) -> np.ndarray:
    """Ids of symbols: rules open from the newest to the oldest, all occurrences of a level at once."""
    seq = symbols.astype(np.int64)
    size = np.concatenate([np.ones(base, np.int64), expansion.astype(np.int64)])
    out = np.zeros(int(size[seq].sum()), np.int64)
    at = np.concatenate([[0], np.cumsum(size[seq])[:-1]]).astype(np.int64)
    while len(seq):
        done = seq < base
        out[at[done]] = seq[done]
        seq, at = seq[~done] - base, at[~done]
        a, b = left[seq].astype(np.int64), right[seq].astype(np.int64)
        seq, at = np.concatenate([a, b]), np.concatenate([at, at + size[a]])
    return out


def decode_document(record, index: int) -> np.ndarray:
    """Random access: ids of one document of a shard record, end id included, from its own symbols only."""
    places = np.frombuffer(record["places"], "<u4")
    seq = np.frombuffer(record["sequence"], "<u4")
    stop = places[index + 1] if index + 1 < len(places) else len(seq)
    return expand(seq[places[index] : stop], record["base"], *(np.frombuffer(record[x], "<u4") for x in ("left", "right", "expansion")))


def write_files(docs: DataFrame, path: str, out: str, end_id: int = 2, range_bytes: int = RANGE_BYTES, shard_tokens: int = SHARD_TOKENS, cache_size: int = CACHE_SIZE) -> DataFrame:
    """Encode every text, append end_id, and write shard records to the folder out; returns them as read back.

    A null text is an empty one (its document holds the end id alone). Rows with equal doc_ids stand in the order
    of their texts; a null doc_id comes before all others. An empty table writes a table without records.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    _, size = text_bytes(narrow)
    # ranges go by the beginning of a text as well, so that rows of one doc_id, or without one, are split
    ranged = narrow.repartitionByRange(shards_for(size, range_bytes, 8), F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 40).asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    @trimmed
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, cache_size)
        end = np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        part = total = 0
        number = TaskContext.get().partitionId()  # ranges of doc_id in ascending order

        def record() -> pa.RecordBatch:
            nonlocal held, ids, part, total
            sizes = np.array([len(x) + 1 for x in held[::2]], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            packed = compress(np.concatenate(held), starts)
            keys = np.array([0 if x is None else x for x in ids], "<i8")
            nulls = np.array([x is None for x in ids], "u1")
            row = {"shard_range": [number], "part": [part], "docs": [keys.tobytes()], "nulls": [nulls.tobytes()], "lengths": [sizes.astype("<i8").tobytes()]}
            row |= {k: [packed[k].tobytes()] for k in ("places", "sequence", "left", "right", "expansion")} | {"base": [packed["base"]], "n_ids": [int(sizes.sum())]}
            held, ids, part, total = [], [], part + 1, 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard_range", pa.int64()), ("part", pa.int64()), *((k, pa.binary()) for k in ("docs", "nulls", "lengths", "places", "sequence", "left", "right", "expansion")), ("base", pa.int64()), ("n_ids", pa.int64())]))

        for batch in slices(batches, 1 << 20):
            tokens, sizes = own.encode(*raw(batch.column(1)))
            stops = np.cumsum(sizes).tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), [0, *stops[:-1]], stops, strict=True):
                held += [tokens[a:b], end]
                ids.append(doc_id)
                total += b - a + 1
                if total >= shard_tokens:
                    yield record()
        if held:
            yield record()

    ranged.mapInArrow(pack, FILE).write.option("compression", "zstd").parquet(out)
    return spark.read.schema(FILE).parquet(out)


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shard records alone.

    start needs the ids in all shards before: those of the ranges before (a running sum over a row a range) and of the shards before in the
    same range. The sums travel to the files while they are few, else both sides are shuffled.
    """
    ship(files.sparkSession)
    sizes = files.select("shard_range", "part", "n_ids")
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("shard_range").agg(F.sum("n_ids").alias("n_ids")).select("shard_range", ahead(W.orderBy("shard_range")).alias("_ranges"))
    inner = sizes.select("shard_range", "part", ahead(W.partitionBy("shard_range").orderBy("part")).alias("_shards"))
    before = inner.join(ranges, "shard_range").select("shard_range", "part", (F.col("_ranges") + F.col("_shards")).alias("before"))
    few = sizes.limit(FEW + 1).count() <= FEW
    joined = files.join(F.broadcast(before) if few else before, ["shard_range", "part"])

    @trimmed
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                arrays = [np.frombuffer(row[x], "<u4") for x in ("sequence", "left", "right", "expansion")]
                ids = expand(arrays[0], row["base"], *arrays[1:]).astype("<u4")
                keys, sizes = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                null = np.frombuffer(row["nulls"], "u1") > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=null), pa.array(starts + row["before"]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    columns = ["sequence", "left", "right", "expansion", "base", "docs", "nulls", "lengths", "before"]
    return joined.select(*columns).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Write docs as token files, read them back and return their digests; see write_files and digests."""
    return digests(write_files(docs, path, out or f"{scratch_root(docs.sparkSession)}/tokens", end_id))
