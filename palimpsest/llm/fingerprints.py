"""Document fingerprints from prefix polynomial hashes (operator 4).

For a text of code points c the prefix array holds P[i] = sum of (c[k] + 1) * b**k for k < i, modulo the prime
2**31 - 1, for two bases. Any span [i, j) is then a difference of two entries, and two spans at different places are
equal if the differences are, once brought to the same power; a longest common extension is found by binary search.

A fingerprint keeps a text's length, its two full hashes and the prefix values at multiples of a stride, the
smallest power of two that leaves at most POINTS of them: it tells texts apart. The likeness of two texts comes from the whole prefix
arrays: a character counts if it stands in the common beginning, in the common end, or in a span of SPAN characters that occurs anywhere in the other text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch_root, shards_for, ship, staged, text_bytes, trimmed

PRIME = (1 << 31) - 1
BASES = (1_000_003, 754_974_721)
POINTS = 32
#: Characters of the shortest span that counts between the common beginning and the common end.
SPAN = 32
RANGE_BYTES = 16 << 20
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_POWERS: dict[tuple[int, ...], list[np.ndarray]] = {}
_INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)


def _powers(n: int, bases: tuple[int, ...] = BASES) -> list[np.ndarray]:
    """b**k modulo PRIME for k < n at least, for each base."""
    if bases not in _POWERS or len(_POWERS[bases][0]) < n:
        size = 1 << max(14, (n - 1).bit_length())
        _POWERS[bases] = []
        for base in bases:
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                step = np.uint64(pow(base, have, PRIME))
                out[have : 2 * have] = out[:have] * step % np.uint64(PRIME)
                have *= 2
            _POWERS[bases].append(out)
    return _POWERS[bases]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Prefixes:
    """Modular prefix arrays of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.arrays = []
        self._spans: dict[int, np.ndarray] = {}
        for power in _powers(self.n + 1):
            terms = (points.astype(np.uint64) + np.uint64(1)) * power[: self.n]
            # below 2**52: folded once they are below 2**32, so that sums of 2**32 terms still fit in 64 bits
            terms = (terms & np.uint64(PRIME)) + (terms >> np.uint64(31))
            self.arrays.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]) % np.uint64(PRIME))

    def span(self, start: int, end: int, at: int) -> tuple[int, int]:
        """Hashes of [start, end), as if it stood at position at >= start."""
        return tuple(int((int(p[end]) - int(p[start])) * pow(b, at - start, PRIME) % PRIME) for p, b in zip(self.arrays, BASES, strict=True))

    def at(self, places: np.ndarray) -> np.ndarray:
        """Prefix values of both bases at places, as one 62-bit integer each."""
        return self.arrays[0][places] << np.uint64(31) | self.arrays[1][places]

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of length characters, each as if it stood at 0, in one 62-bit integer."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        if length in self._spans:
            return self._spans[length]
        prime = np.uint64(PRIME)
        one, two = ((p[length:] + prime - p[:-length]) % prime * back[: self.n - length + 1] % prime for p, back in zip(self.arrays, _powers(self.n + 1, _INVERSES), strict=True))
        self._spans[length] = one << np.uint64(31) | two
        return self._spans[length]


def equal_spans(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    top = max(i, j)
    return a.span(i, i + length, top) == b.span(j, j + length, top)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common prefix of a from i and b from j."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def common_end(a: Prefixes, b: Prefixes, most: int) -> int:
    """Length of the longest common suffix of a and b, most at most."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, a.n - middle, b, b.n - middle, middle):
            low = middle
        else:
            high = middle - 1
    return low


def stride_of(n: int, points: int = POINTS) -> int:
    stride = 1
    while n // stride > points:
        stride *= 2
    return stride


def sketch(text: Prefixes) -> tuple[int, int, int, np.ndarray]:
    """Length, full hash, stride and prefix values of a text: its fingerprint as numbers."""
    stride = stride_of(text.n)
    return text.n, int(text.at(np.array([text.n]))[0]), stride, text.at(np.arange(stride, text.n + 1, stride)) & np.uint64(0xFFFFFFFF)


def written(found: tuple[int, int, int, np.ndarray]) -> str:
    n, whole, _, values = found
    return f"{n:x}.{whole:016x}." + values.astype(">u4").tobytes().hex()


def occurs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in x of hashes that y has too. Tables of bits of the hashes leave few to compare."""
    mask = np.uint64((1 << max(10, 3 + max(len(x), len(y)).bit_length())) - 1)
    seen = np.zeros(int(mask) + 1, bool)
    seen[y & mask] = True
    hit = np.flatnonzero(seen[x & mask])
    if not len(hit):
        return hit
    seen[y & mask] = False
    seen[x[hit] & mask] = True
    return hit[np.isin(x[hit], y[seen[y & mask]])]


def likeness(a: Prefixes, b: Prefixes) -> float:
    """0 to 1: the share of the longer text that both have, as spans at any place; 1 for equal texts only."""
    longer, shorter = max(a.n, b.n), min(a.n, b.n)
    front = common_extension(a, 0, b, 0)
    if front == longer:
        return 1.0
    back = common_end(a, b, shorter - front)
    spans = a.spans(SPAN), b.spans(SPAN)
    least = shorter
    for own, x, y in ((a, *spans), (b, *spans[::-1])):
        mark = np.zeros(own.n + 1, np.int32)
        low, high = max(0, front - SPAN + 1), min(len(x), own.n - back)  # spans inside the common beginning or end add nothing
        hit = low + occurs(x[low:high], y) if high > low else np.zeros(0, np.int64)
        mark[hit] += 1
        mark[hit + SPAN] -= 1
        shared = np.cumsum(mark)[:-1] > 0
        shared[:front] = True
        shared[own.n - back :] = True
        least = min(least, int(shared.sum()))
    # texts of the same spans in another order aren't equal
    return min(least, longer - 1) / longer


def edited(own: np.ndarray, following: np.ndarray) -> np.ndarray:
    """own with its last third replaced by as many code points of the beginning of following, or all it has."""
    cut = len(own) // 3
    return np.concatenate([own[: len(own) - cut], following[:cut]])


def compared(own: np.ndarray, own_prefixes: Prefixes, following: np.ndarray, next_prefixes: Prefixes) -> tuple:
    changed = edited(own, following)
    changed_prefixes = Prefixes(changed)
    digest = hashlib.sha256(changed.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return len(own), digest, written(sketch(own_prefixes)), written(sketch(changed_prefixes)), likeness(own_prefixes, changed_prefixes), likeness(own_prefixes, next_prefixes)


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprint of each row's text and of its edited text, with their likeness and that to the next row's text.

    The next row is that with the next smaller doc_id (rows that share one: the next text in descending order); after the last
    comes the first. A null text is empty; an empty text has likeness 1 to an empty one, else 0. Null doc_ids come
    last. One row alone is its own next; an empty table gives no rows; other columns are ignored.

    Rows are dealt by ranges of doc_id and sorted, so a row's next one stands behind it in its partition, but for the
    last row of each: these (one for each partition) are written with their texts beside the first of each, and joined
    in a second, small step.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    _, size = text_bytes(narrow)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    ranged = narrow.repartitionByRange(shards_for(size, range_bytes, 8), order[0]).sortWithinPartitions(*order)

    @trimmed
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [x.split()[0] for x in COLUMNS.split(", ")]
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in columns[2:5]), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("first_text", pa.string()), ("last_text", pa.string()), ("part", pa.int32())])
        held, first = None, None
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = code_points(text)
                here = (doc_id, text, points, Prefixes(points))
                if held is None:
                    first = text
                else:
                    rows.append((held[0], *compared(held[2], held[3], points, here[3]), None, None, None))
                held = here
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if held is not None:
            rows.append((held[0], len(held[2]), None, None, None, None, None, first, held[1], TaskContext.get().partitionId()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    done = staged(ranged.mapInArrow(walk, f"{COLUMNS}, first_text string, last_text string, part int"), "fingerprints", scratch_root(spark))
    # a row for each partition that has any: its last row, and the first text of the next one; their order is found by numbers alone
    ends = done.where(F.col("last_text").isNotNull()).select("part", "doc_id", "first_text", "last_text")
    every = W.orderBy("part")
    head = F.first("part").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    order = ends.select("part", F.coalesce(F.lead("part").over(every), head).alias("next"))
    firsts = ends.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    joined = ends.join(order, "part").join(firsts, "next").select("doc_id", "last_text", "next_text")

    @trimmed
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own, after = code_points(text), code_points(following)
                rows.append((doc_id, *compared(own, Prefixes(own), after, Prefixes(after))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in COLUMNS.split(", ")])

    columns = [x.split()[0] for x in COLUMNS.split(", ")]
    return done.where(F.col("last_text").isNull()).select(*columns).union(joined.mapInArrow(close, COLUMNS))
