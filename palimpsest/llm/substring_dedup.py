"""Removal of repeated passages by a sparse, distributed suffix index (operator 3).

Every string of LENGTH bytes holds an anchor: the place of the least hash among its windows of GRAM bytes, which
depends on the string alone, so equal strings have their anchors at the same offset. Only suffixes that start at
anchors are indexed (about one in 30 bytes), ordered by the hash of their first GRAM bytes and then by that of the
whole stretch of strings that share the anchor; equality is all that is asked of the order, so hashes serve as
well as the bytes. An anchor's record stands for a run of string starts.

The suffix arrays form logarithmic families, one for each range of hashes: a batch of documents yields one sorted array per
range; arrays of equal level are merged, and while two are merged, entries whose whole stretch occurs earlier
are marked covered and leave the family. What is left of a group of suffixes that share their first bytes but not the stretch
(the ends of matches) is compared string by string in a second, much smaller step.

Exact copies of a text are set aside first: all but the first of them is covered whole, if it has LENGTH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import numbered, raw, scratch_root, shards_for, ship, slices, staged, text_bytes, trimmed
from palimpsest.llm.words import mix, prefix_hash, span_hash

LENGTH = 100
GRAM = 40
#: Bytes of text whose anchors a mapper sorts at once, and bytes of text for each range of hashes.
BATCH_BYTES = 16 << 20
RANGE_BYTES = 12 << 20
PACKED = "range int, kind byte, base long, head binary, whole binary, doc binary, start binary, many binary"
#: The open anchors' map: bits for each byte of text, most bits in all (128 MB), and the share of set bits beyond which texts are joined instead.
MAP_SHARE, MAP_BITS, MAP_FULL = 0.125, 30, 0.05

#: Ids of rows that travel to the texts; of more, both sides are shuffled.
FEW = 1_000_000

_SALT = np.uint64(0x9FB21C651E98DF25)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all strings of length bytes within one text: for each run of starts with the same anchor the text, the first start (in data), the number of starts, the hash of the anchor's gram and of the whole stretch."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    prefix = prefix_hash(data)
    places = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, places, places + gram)
    width = length - gram + 1
    bits = np.uint64(max(1, int(len(grams) - 1).bit_length()))
    # hash above, place below: the least is the leftmost place of the least hash
    least = (grams >> bits << bits) | places.astype(np.uint64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    place = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = np.arange(len(place)) + length <= offsets[1:][text]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none
    # starts of one text that are inside come before those that aren't
    many = np.diff(np.append(np.flatnonzero(new), len(place)))[np.cumsum(new)[first] - 1]
    many = np.minimum(many, offsets[1:][text[first]] - length - first + 1)
    return text[first], first, many, grams[place[first]], span_hash(prefix, first, first + many - 1 + length)


class Family:
    """Suffix arrays of one range of hashes, in levels: two of a level merge into one of the next."""

    FIELDS = ("head", "whole", "doc", "start", "many")

    def __init__(self):
        self.levels: list[dict[str, np.ndarray] | None] = []
        self.covered: list[dict[str, np.ndarray]] = []

    def add(self, array: dict[str, np.ndarray]) -> None:
        level = 0
        array = self.scan([array])
        while True:
            if level == len(self.levels):
                self.levels.append(None)
            if self.levels[level] is None:
                self.levels[level] = array
                return
            array, self.levels[level] = self.scan([self.levels[level], array]), None
            level += 1

    def scan(self, arrays: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """Merge sorted arrays; of entries with the same stretch the earliest stays, the others are covered."""
        got = {k: np.concatenate([x[k] for x in arrays]) for k in self.FIELDS}
        order = np.lexsort((got["start"], got["doc"], got["whole"], got["head"]))
        got = {k: v[order] for k, v in got.items()}
        again = np.zeros(len(order), bool)
        again[1:] = (got["head"][1:] == got["head"][:-1]) & (got["whole"][1:] == got["whole"][:-1])
        if again.any():
            self.covered.append({k: got[k][again] for k in ("doc", "start", "many")})
            got = {k: v[~again] for k, v in got.items()}
        return got

    def finish(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """The covered entries, and the entries that share their gram with another but not the stretch."""
        rest = self.scan([x for x in self.levels if x is not None])
        head = rest["head"]
        same = np.zeros(len(head), bool)
        same[1:] = head[1:] == head[:-1]
        same[:-1] |= same[1:]
        covered = {k: np.concatenate([np.zeros(0, np.int64), *(x[k] for x in self.covered)]) for k in ("doc", "start", "many")}
        return covered, {k: v[same] for k, v in rest.items()}


def count_type(length: int, gram: int) -> str:
    """What holds the number of strings of length that share an anchor."""
    if not 1 <= gram <= length:
        raise ValueError("a gram is part of a string")
    return "u1" if length - gram + 1 < 1 << 8 else "<u4"


def indexed(texts: DataFrame, ranges: int, length: int, gram: int, batch_bytes: int) -> DataFrame:
    """Sorted arrays of each batch of documents, cut by ranges of the gram's hash."""
    wide = count_type(length, gram)

    @trimmed
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def arrays() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            doc, start, many, head, whole = (np.concatenate([x[i] for x in held]) for i in range(5))
            held, size = [], 0
            # what the batch itself repeats is covered already, so a passage of many documents leaves one entry a batch
            family = Family()
            rest = family.scan([{"head": head, "whole": whole, "doc": doc, "start": start, "many": many}])
            for kind, got in ((1, rest), *((0, x) for x in family.covered)):
                key = got["head"] if kind else mix(got["doc"].astype(np.uint64))
                part = (key // np.uint64(2**64 // ranges + 1)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(ranges + 1))
                full = np.flatnonzero(np.diff(cuts))
                columns = {"range": pa.array(full, pa.int32()), "kind": pa.array(np.full(len(full), kind, np.int8))}
                base = int(got["doc"].min()) if len(got["doc"]) else 0
                narrow = not len(got["doc"]) or int(got["doc"].max()) - base < 1 << 32
                values = {"start": got["start"].astype("<u4"), "many": got["many"].astype(wide), "doc": (got["doc"] - base).astype("<u4") if narrow else got["doc"].astype("<i8")}
                if kind:  # the range holds the upper bits of a head; equal lower ones only cost a comparison
                    values |= {"head": got["head"].astype("<u4"), "whole": got["whole"].astype("<u8")}
                columns["base"] = pa.array([base if narrow else None] * len(full), pa.int64())
                for name in ("head", "whole", "doc", "start", "many"):
                    own = values.get(name, np.zeros(len(got["doc"]), "V0"))[order]
                    columns[name] = pa.array([own[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

        for batch in slices(batches, 1 << 20):
            data, offsets = raw(batch.column("text"))
            text, first, many, head, whole = anchors(data, offsets, length, gram)
            held.append((batch.column("row").to_numpy(zero_copy_only=False)[text], first - offsets[:-1][text], many, head, whole))
            size += len(data)
            if size >= batch_bytes:
                yield from arrays()
        if held:
            yield from arrays()

    return texts.mapInArrow(build, PACKED)


def docs_of(row: dict) -> np.ndarray:
    """Numbers of the rows in a packed record."""
    return np.frombuffer(row["doc"], "<i8") if row["base"] is None else np.frombuffer(row["doc"], "<u4").astype(np.int64) + row["base"]


def matched(index: DataFrame, ranges: int, parts: int, wide: str) -> DataFrame:
    """Covered runs (kind 0) and open ones (kind 1, with the range and the lower half of the gram's hash) of all families."""

    def found(kind: int, part: int, got: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(got["doc"])
        head = got["head"].astype(np.int64) if kind else np.zeros(n, np.int64)
        columns = [np.full(n, kind, np.int8), got["doc"], got["start"].astype(np.int64), got["many"].astype(np.int32), np.full(n, part, np.int32), head]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "row", "start", "many", "range", "head"])

    @trimmed
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families: dict[int, Family] = {}
        for batch in batches:
            for row in batch.to_pylist():
                array = {"doc": docs_of(row), "start": np.frombuffer(row["start"], "<u4").astype(np.int64), "many": np.frombuffer(row["many"], wide).astype(np.int64)}
                if row["kind"]:
                    families.setdefault(row["range"], Family()).add(array | {"head": np.frombuffer(row["head"], "<u4").astype(np.uint64), "whole": np.frombuffer(row["whole"], "<u8")})
                else:
                    yield found(0, 0, array)
        for part, family in families.items():
            covered, left = family.finish()
            yield found(0, part, covered)
            yield found(1, part, left)

    return index.repartition(parts, "range").mapInArrow(merge, "kind byte, row long, start long, many int, range int, head long")


def _packed(runs: DataFrame, *more: str) -> DataFrame:
    """A record for each row with its runs as arrays."""
    return runs.groupBy("row").agg(F.collect_list(F.struct("start", "many", *more)).alias("runs"))


STRINGS = "bucket int, base long, hash binary, doc binary, start binary"


def strings_of(held: list[tuple], buckets: int) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
    """Arrays of (hash, doc, start) of strings by bucket of the hash, and those that the batch itself repeats."""
    hashes, doc, start = (np.concatenate([x[i] for x in held]) for i in range(3))
    order = np.lexsort((start, doc, hashes))
    hashes, doc, start = hashes[order], doc[order], start[order]
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    late = {"doc": doc[again], "start": start[again]}
    hashes, doc, start = hashes[~again], doc[~again], start[~again]
    part = (hashes // np.uint64(2**64 // buckets + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)
    cuts = np.searchsorted(part, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    base = int(doc.min()) if len(doc) else 0
    narrow = not len(doc) or int(doc.max()) - base < 1 << 32
    packed = {"hash": hashes.astype("<u8"), "doc": (doc - base).astype("<u4") if narrow else doc.astype("<i8"), "start": start.astype("<u4")}
    columns = {"bucket": pa.array(full, pa.int32()), "base": pa.array([base if narrow else None] * len(full), pa.int64())}
    columns |= {k: pa.array([v[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()) for k, v in packed.items()}
    return pa.RecordBatch.from_pydict(columns), late


def late_rows(late: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Strings that are known to be late, as rows without a hash, in runs of neighbouring starts."""
    order = np.lexsort((late["start"], late["doc"]))
    doc, start = late["doc"][order], late["start"][order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(doc)))
    return pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array(start[at], pa.int64()), pa.array(many.astype(np.int32))], names=["row", "start", "many"])


def compared(own: DataFrame, open_runs: DataFrame, length: int, gram: int, ranges: int, parts: int, map_bits: int, root: str, batch_bytes: int) -> DataFrame:
    """Covered runs among the open ones, string by string: those of which an earlier one with the same gram exists.

    Texts are scanned once more and anchors that look open by a map of bits give their strings: a bit set by chance only
    gives more strings to compare. If the map would be too full, open runs are joined to their texts by row instead.
    """
    spark = own.sparkSession
    shift = 64 - map_bits
    width = 2**64 // ranges + 1

    def bit(part: np.ndarray, head: np.ndarray) -> np.ndarray:
        # of a head its range and lower half are known
        return (mix(head.astype(np.uint64) * np.uint64(ranges) + part.astype(np.uint64)) >> np.uint64(shift)).astype(np.int64)

    def strings(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, many: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.repeat(np.arange(len(start)), many)
        at = start[n] + np.arange(len(n)) - np.repeat(np.cumsum(many) - many, many)
        return mix(span_hash(prefix, at, at + length) ^ (head[n].astype(np.uint32).astype(np.uint64) * _SALT)), at

    def emit(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for hashes, doc, start in pieces:
            held.append((hashes, doc, start))
            size += len(hashes)
            if size >= batch_bytes // 8:
                yield from both(held)
                held, size = [], 0
        if size:
            yield from both(held)

    def both(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        packed, late = strings_of(held, parts)
        yield packed
        if len(late["doc"]):  # a row of its own bucket carries what is known already
            key = (late["doc"] % parts).astype(np.int64)
            order = np.argsort(key, kind="stable")
            cuts = np.searchsorted(key[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cuts))
            doc, start = late["doc"][order].astype("<i8"), late["start"][order].astype("<u4")
            columns = {"bucket": pa.array(full, pa.int32()), "base": pa.nulls(len(full), pa.int64()), "hash": pa.nulls(len(full), pa.binary())}
            columns |= {k: pa.array([v[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()) for k, v in (("doc", doc), ("start", start))}
            yield pa.RecordBatch.from_pydict(columns)

    n_open = open_runs.count()
    if n_open <= MAP_FULL * (1 << map_bits):

        def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.unique(bit(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                where = np.unique(bits >> 16)
                for k in where.tolist():
                    row = np.zeros(1 << 16, np.uint8)
                    row[bits[bits >> 16 == k] & 0xFFFF] = 1
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(row).tobytes()], pa.binary())})

        def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    pieces[k] = pieces.get(k, 0) | np.frombuffer(x, np.uint8)
            if pieces:
                yield pa.RecordBatch.from_pydict({"piece": pa.array(list(pieces), pa.int32()), "bits": pa.array([x.tobytes() for x in pieces.values()], pa.binary())})

        bits = np.zeros(max(1 << map_bits, 1 << 16) // 8, np.uint8)
        sent = open_runs.select("range", "head").repartition(parts, F.shiftrightunsigned(F.col("head"), 0)).mapInArrow(segment, "piece int, bits binary")
        for r in sent.repartition(parts, "piece").mapInArrow(union, "piece int, bits binary").toLocalIterator():
            bits[r.piece * 8192 : (r.piece + 1) * 8192] |= np.frombuffer(r.bits, np.uint8)
        shared = spark.sparkContext.broadcast(bits)

        @trimmed
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            looks = shared.value

            def pieces() -> Iterator[tuple]:
                for batch in slices(batches, 1 << 20):
                    data, offsets = raw(batch.column("text"))
                    text, first, many, head, _ = anchors(data, offsets, length, gram)
                    at = bit((head // np.uint64(width)).astype(np.int64), head.astype(np.uint32))
                    ok = looks[at >> 3] & (128 >> (at & 7)).astype(np.uint8) > 0
                    text, first, many, head = text[ok], first[ok], many[ok], head[ok]
                    hashes, start = strings(data, prefix_hash(data), first, many, head)
                    owner = np.repeat(text, many)
                    yield hashes, batch.column("row").to_numpy(zero_copy_only=False)[owner], start - offsets[:-1][owner]

            yield from emit(pieces())

        made = own.mapInArrow(scan, STRINGS)
    else:

        @trimmed
        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator[tuple]:
                for batch in slices(batches, 1 << 20):
                    data, offsets = raw(batch.column("text"))
                    runs = batch.column("runs").to_pylist()
                    owner = np.repeat(np.arange(batch.num_rows), [len(x) for x in runs])
                    start, many, head = (np.array([r[k] for x in runs for r in x], np.int64) for k in ("start", "many", "head"))
                    hashes, at = strings(data, prefix_hash(data), start + offsets[:-1][owner], many, head)
                    each = np.repeat(owner, many)
                    yield hashes, batch.column("row").to_numpy(zero_copy_only=False)[each], at - offsets[:-1][each]

            yield from emit(pieces())

        made = own.join(_packed(open_runs, "head"), "row").select("row", "text", "runs").mapInArrow(joined, STRINGS)

    @trimmed
    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                doc, start = docs_of(row), np.frombuffer(row["start"], "<u4").astype(np.int64)
                if row["hash"] is None:
                    yield late_rows({"doc": doc, "start": start}, parts)
                else:
                    held.setdefault(row["bucket"], []).append((np.frombuffer(row["hash"], "<u8"), doc, start))
        for rows in held.values():
            yield late_rows(strings_of(rows, 1)[1], parts)

    return made.repartition(parts, "bucket").mapInArrow(later, "row long, start long, many int")


def cut(texts: DataFrame, length: int) -> DataFrame:
    """The digest of each document once its covered strings' bytes are gone. texts: doc_id, text, whole (all is covered), runs."""

    @trimmed
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            data, offsets = raw(batch.column("text"))
            runs, whole = batch.column("runs").to_pylist(), batch.column("whole").to_pylist()
            rows = []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(own), bool)
                if whole[i] and len(own) >= length:
                    gone[:] = True
                elif runs[i]:
                    mark = np.zeros(len(own) + 1, np.int32)
                    start, many = np.array([r["start"] for r in runs[i]]), np.array([r["many"] for r in runs[i]])
                    np.add.at(mark, start, 1)
                    np.add.at(mark, start + many - 1 + length, -1)
                    gone = np.cumsum(mark)[:-1] > 0
                edges = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(own), int(gone.sum()), edges, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
            n_bytes, n_removed, n_spans, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs.

    Each byte covered by a string of length bytes that also starts earlier (in a row before it, or earlier in the same one)
    goes; strings are judged on the input and don't cross rows. Rows stand in the order of doc_id, null before all others,
    and rows that share a doc_id in that of their texts; each is a text of its own, and of equal ones the first stays.
    A null text is empty; texts shorter than length lose nothing. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    root = scratch_root(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow = numbered(given, root, nulls_first=True)
    _, size = text_bytes(narrow)
    ranges = shards_for(size, range_bytes, 12)
    # the first of each group of equal texts stands for it; a digest travels, not the text
    keyed = narrow.select("row", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    copies = staged(keyed.join(first.where("n > 1").select("digest", F.col("row").alias("first")), "digest").where("row <> first").select("row"), "copies", root)
    map_bits = min(MAP_BITS, max(16, int(size * MAP_SHARE).bit_length()))
    own = narrow.select("row", "text").join(copies, "row", "left_anti")
    runs = staged(matched(indexed(own, 4 * ranges, length, gram, batch_bytes), 4 * ranges, ranges, count_type(length, gram)), "runs", root)
    late = compared(own, runs.where("kind = 1"), length, gram, 4 * ranges, ranges, map_bits, root, batch_bytes)
    # a record for each row that loses something: with null for runs all of it goes
    lost = _packed(runs.where("kind = 0").select("row", "start", "many").union(late)).withColumn("whole", F.lit(False))
    lost = staged(lost.union(copies.select("row", F.lit(None).cast(lost.schema["runs"].dataType).alias("runs"), F.lit(True).alias("whole"))), "lost", root)
    none = F.lit(None).cast(lost.schema["runs"].dataType)
    if lost.limit(FEW + 1).count() <= FEW:
        # the ids of these rows travel to the texts, so that only their texts are shuffled
        ids = F.broadcast(lost.select("row"))
        hit = narrow.join(ids, "row", "left_semi").join(lost, "row").select("doc_id", "text", "whole", "runs")
        texts = hit.union(narrow.join(ids, "row", "left_anti").select("doc_id", "text", F.lit(False).alias("whole"), none.alias("runs")))
    else:
        texts = narrow.join(lost, "row", "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "runs")
    return cut(texts, length)
