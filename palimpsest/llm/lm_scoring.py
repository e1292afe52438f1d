"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax (operator 6).

P(word | context) = P(class | context) * P(cell | class, context) * P(word | cell). The first two factors are maximum-entropy models:
hashed n-gram and skip features of the words before add rows of a weight table, and a softmax over CLASSES classes, then over
the CELLS cells of the word's class, follows; both begin at the shares of counts. Frequent words are classes of their own; all others are classed by their last letters, and
a class's words are dealt to cells by a hash. The last factor has counts alone: (c + 1) / (N + V + 1) over the cell's words and one
unknown word. The second table's rows grow with the corpus, up to a broadcast of fixed size.

Counts of all training words come from all texts, without a row per word: a batch of documents becomes one array of
word numbers and, for each range of word hashes, one array of its distinct words. Ranges are counted, and the
batch gets its words' counts back as arrays. Training visits every training token once, in ROUNDS parts: in each,
learners take gradient steps on the batches they read, in the order of the batches' numbers, and the weighted mean of the
results is the next table. Batches are numbered by partition and place, and means are sums of rounded weights, exact in any order:
the same rows in the same files give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import raw, remainder, scratch_root, shards_for, ship, slices, staged, text_bytes, trimmed
from palimpsest.llm.words import bounds, lowered, mix, span_hashes

BATCH_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
#: Classes: frequent words and, behind them, shapes.
FREQUENT, SHAPES = 24, 40
CLASSES = FREQUENT + SHAPES
#: Cells of a class: by the lowest bits of a word's 16-bit hash.
CELLS = 16
#: Rows of the table for classes; those of the table for cells grow with the text, one for each BYTES_OF_ROW, from 2**LEAST_BITS to 2**MOST_BITS (32 MB).
BITS = 14
LEAST_BITS, MOST_BITS, BYTES_OF_ROW = 12, 18, 1 << 14
ROUNDS = 2
#: Tokens of a gradient step and its rate.
STEP = 8192
RATE = 0.4
#: Tokens whose logits are made at once.
SLICE = 1024
#: A class stands in a pair of classes as a multiple of PAIR; none is the class CLASSES.
PAIR = 128
PAIRS = (CLASSES + 1) * PAIR
#: Lines of a group that are added beside those of other groups.
SIDE = 8
#: Weights are rounded to this share of one before they are summed.
GRAIN = 1 << 14
#: Batches of a learner in a round, at least.
BATCHES_OF_LEARNER = 2
#: The end of a text as a word: no word has this hash but by chance.
END = np.uint64(0x5851F42D4C957F2D)
#: Numbers of a weight block that travels as one row.
BLOCK = 1 << 16

BATCHES = "batch long, kind byte, bucket int, hashes binary, counts binary, shapes binary, doc_id binary, null binary, held binary, first binary, words binary"
KNOWN = "batch long, kind byte, bucket int, counts binary, hash long, count long, shape int, n array<long>, v array<long>"
CODED = "batch long, doc_id binary, null binary, held binary, first binary, classes binary, hashed binary, base binary, inner binary, known binary"


def shape_of(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shape of each word: a number below SHAPES by its last two bytes."""
    last = low[ends - 1].astype(np.uint64)
    fore = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return (mix(last << np.uint64(8) | fore) % np.uint64(SHAPES)).astype(np.uint8)


def short_hash(hashes: np.ndarray) -> np.ndarray:
    """16 bits of a word's hash: what its neighbours see of it."""
    return (mix(hashes.copy()) >> np.uint64(48)).astype("<u2")


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return short_hash(hashes).astype(np.int64) % CELLS


def batches_of(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: doc_id, held, text. A row of kind 0 for each batch, one of kind 1 for each of its ranges of words."""

    @trimmed
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[tuple] = []
        size = 0
        number = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal held_rows, size, number
            ids, null, held, many, hashes, shapes = (np.concatenate([x[i] for x in held_rows]) for i in range(6))
            held_rows, size = [], 0
            words, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            trained = np.repeat(~held, many)
            counts = np.bincount(inverse[trained], minlength=len(words))
            part = (words // np.uint64(2**64 // buckets + 1)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            batch, number = number, number + 1
            n = len(full) + 1
            first = np.concatenate([[0], np.cumsum(many)])

            def column(own: bytes | None, values: np.ndarray | None) -> pa.Array:
                return pa.array([own] + [None if values is None else values[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())

            arrays = [
                pa.array([batch] * n, pa.int64()), pa.array([0] + [1] * len(full), pa.int8()), pa.array([-1, *full.tolist()], pa.int32()),
                column(words.astype("<u8").tobytes(), words.astype("<u8")), column(None, counts.astype("<u4")), column(shapes[where].tobytes(), shapes[where]),
                *(column(x.tobytes(), None) for x in (ids.astype("<i8"), null.astype("u1"), held.astype("u1"), first.astype("<i8"), inverse.astype("<u4"))),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in BATCHES.split(", ")])

        for batch in slices(batches):
            data, offsets = raw(batch.column("text"))
            low = lowered(data)
            starts, ends, first = bounds(low, offsets)
            many = np.diff(first) + 1
            at = np.arange(len(starts)) + np.repeat(np.arange(len(many)), many - 1)
            hashes, shapes = np.full(len(starts) + len(many), END), np.zeros(len(starts) + len(many), np.uint8)
            hashes[at] = span_hashes(low, starts, ends)
            shapes[at] = shape_of(low, starts, ends) if len(starts) else 0
            ids = batch.column("doc_id")
            held_rows.append((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), batch.column("held").to_numpy(zero_copy_only=False), many, hashes, shapes))
            size += len(data)
            if size >= BATCH_BYTES:
                yield flush()
        if held_rows:
            yield flush()

    return docs.mapInArrow(build, BATCHES)


def counted(batches: DataFrame, buckets: int) -> DataFrame:
    """For each range: every batch's counts over the corpus (kind 1), totals by shape (2) and its most frequent words (3)."""

    @trimmed
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for part in parts:
            for r in part.to_pylist():
                held.setdefault(r["bucket"], []).append((r["batch"], np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["counts"], "<u4"), np.frombuffer(r["shapes"], "u1")))
        names = [x.split()[0] for x in KNOWN.split(", ")]
        kinds = [pa.int64(), pa.int8(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for bucket, rows in held.items():
            hashes, counts, shapes = (np.concatenate([x[i] for x in rows]) for i in (1, 2, 3))
            words, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(words)).astype(np.int64)
            shape = shapes[where].astype(np.int64) * CELLS + cell_of(words)
            out, at = [], 0
            for batch, own, _, _ in rows:
                out.append((batch, 1, bucket, total[inverse[at : at + len(own)]].astype("<u8").tobytes(), None, None, None, None, None))
                at += len(own)
            n = np.bincount(shape, weights=total, minlength=SHAPES * CELLS).astype(np.int64).tolist()
            v = np.bincount(shape, weights=total > 0, minlength=SHAPES * CELLS).astype(np.int64).tolist()
            out.append((0, 2, bucket, None, None, None, None, n, v))
            for i in np.lexsort((words, -total))[:FREQUENT].tolist():
                if total[i]:
                    out.append((0, 3, bucket, None, int(words[i].astype(np.int64)), int(total[i]), int(shape[i]), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    asked = batches.where("kind = 1").select("batch", "bucket", "hashes", "counts", "shapes")
    return asked.repartition(buckets, "bucket").mapInArrow(count, KNOWN)


class Totals:
    """Corpus totals: tokens and distinct words, in all and for each cell of each shape; the frequent words."""

    def __init__(self, known: DataFrame):
        self.n, self.v = np.zeros(SHAPES * CELLS, np.int64), np.zeros(SHAPES * CELLS, np.int64)
        sums = known.where("kind = 2").select(F.posexplode(F.arrays_zip("n", "v")).alias("place", "x")).groupBy("place").agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v"))
        for r in sums.collect():
            self.n[r.place], self.v[r.place] = r.n, r.v
        self.tokens, self.words = int(self.n.sum()), int(self.v.sum())
        top = known.where("kind = 3").orderBy(F.desc("count"), "hash").limit(FREQUENT).collect()
        for r in top:  # a class of its own
            self.n[r.shape] -= r["count"]
            self.v[r.shape] -= 1
        # where training begins: the shares that counts alone give
        cells = np.log(self.n + self.v + 1.0).reshape(SHAPES, CELLS)
        self.inner = np.concatenate([np.zeros((FREQUENT, CELLS)), cells]).astype(np.float32)
        known = np.array([r["count"] for r in top] + [0] * (FREQUENT - len(top)))
        self.outer = np.log(np.concatenate([known, self.n.reshape(SHAPES, CELLS).sum(1)]) + 1.0).astype(np.float32)
        self.top = np.array([r.hash for r in top], np.int64).view(np.uint64)

    def classes(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        out = shapes.astype(np.int64) + FREQUENT
        order = np.argsort(self.top)
        if len(order):
            at = order[np.minimum(np.searchsorted(self.top[order], hashes), len(order) - 1)]
            hit = self.top[at] == hashes
            out[hit] = at[hit]
        return out


def coded(batches: DataFrame, known: DataFrame, totals: Totals) -> DataFrame:
    """Each batch as streams of classes and word hashes, and for each document what doesn't hang on the context."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        answers = sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for _, x in answers)]).astype(np.int64)
        for r in left.to_pylist():
            hashes, shapes = np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["shapes"], "u1")
            words, first = np.frombuffer(r["words"], "<u4"), np.frombuffer(r["first"], "<i8")
            kind = totals.classes(hashes, shapes)
            base = np.log10((counts + 1) / (totals.tokens + totals.words + 1))
            cell = cell_of(hashes)
            place = shapes.astype(np.int64) * CELLS + cell
            inner = np.log10((counts + 1) / (totals.n[place] + totals.v[place] + 1))
            inner[kind < FREQUENT] = 0.0  # such a class has one word
            sums = [np.add.reduceat(x[words], first[:-1]) for x in (base, inner, (counts > 0).astype(np.int64))]
            stream = [kind.astype("u1")[words], short_hash(hashes)[words]]
            rows.append((r["batch"], r["doc_id"], r["null"], r["held"], r["first"], *(x.tobytes() for x in (*stream, *sums))))
        names = [x.split()[0] for x in CODED.split(", ")]
        return pa.table([pa.array(x, pa.int64() if i == 0 else pa.binary()) for i, x in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int64() if i == 0 else pa.binary()) for i in range(len(names))], names=names)

    own = batches.where("kind = 0").select("batch", "hashes", "shapes", "doc_id", "null", "held", "first", "words")
    answers = known.where("kind = 1").select("batch", "bucket", "counts")
    return own.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(join, CODED)


def row_of(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Row of value x of feature k in a table of 2**bits rows."""
    return ((x.astype(np.uint32) * np.uint32(8) + np.uint32(k + 1)) * np.uint32(0x9E3779B1) >> np.uint32(7) & np.uint32((1 << bits) - 1)).astype(np.int32)


def features(classes: np.ndarray, hashed: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What both weight tables know of each token's context, a line a kind.

    Of the classes' features (bias, the word before, the class before that, both classes, a skip, and both sides of a skip): the word before's row,
    and both pairs of classes, from which single_rows and pair_rows give the others. Of the cells' features, all with the word's own class (bias, the word before,
    and the word before that, a skip): the rows of the words; bias_rows gives the first.
    """

    def back(values: np.ndarray, k: int, none: int) -> np.ndarray:
        out = np.full(len(classes), none, np.int32)
        out[k:] = values[: len(classes) - k]
        for i in range(k):
            at = first[:-1] + i
            out[at[at < first[1:]]] = none
        return out

    c1, c2, c3 = (back(classes, k, CLASSES) for k in (1, 2, 3))
    w1, w2 = (back(hashed, k, 1 << 16) for k in (1, 2))
    outer = (row_of(w1, 1, BITS), c1 * PAIR + c2, c1 * PAIR + c3)
    return np.stack(outer), np.stack([row_of(x * CLASSES + classes, k, bits) for k, x in ((1, w1), (2, w2))])


def pair_rows(pairs: np.ndarray, skip: bool) -> np.ndarray:
    """Rows of the feature of both classes of a pair."""
    return row_of(pairs, 5 if skip else 3, BITS)


def single_rows(pairs: np.ndarray, skip: bool) -> np.ndarray:
    """Rows of the feature of a pair's farther class alone."""
    return row_of(pairs % PAIR, 4 if skip else 2, BITS)


def bias_rows(bits: int | None = None) -> np.ndarray:
    """Row of the bias: one for classes, one a class for cells (in a table of 2**bits rows)."""
    return row_of(np.zeros(1, np.int32), 0, BITS) if bits is None else row_of(np.arange(CLASSES), 0, bits)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of places by key (below 2**32), and where each key begins in it, how often it stands there, and the key; frequent keys first."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")  # 16 bits are sorted by their digits
    if len(keys) and keys.max() > 0xFFFF:
        order = order[np.argsort((keys >> 16).astype(np.uint16)[order], kind="stable")]
    own = keys[order]
    cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    counts = np.diff(np.append(cuts, len(own)))
    by = np.argsort(np.minimum(counts, 0xFFFF).astype(np.uint16), kind="stable")[::-1]
    return order, cuts[by], counts[by], own[cuts[by]]


def summed(values: np.ndarray, order: np.ndarray, cuts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each group's lines: the first lines of all groups, the second lines and so on, then what frequent groups have beyond SIDE lines."""
    out = np.take(values, order[cuts], axis=0)
    for k in range(1, SIDE):
        n = int(np.searchsorted(-counts, -k))  # groups with more than k lines come first
        if not n:
            break
        out[:n] += np.take(values, order[cuts[:n] + k], axis=0)
    n = int(np.searchsorted(-counts, -SIDE))
    if n:
        many = counts[:n] - SIDE
        first = np.cumsum(many) - many
        at = np.arange(many.sum()) + np.repeat(cuts[:n] + SIDE - first, many)
        out[:n] += np.add.reduceat(np.take(values, order[at], axis=0), first, axis=0)
    return out


def moved(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """One adaptive step of distinct rows, in place."""
    grad = sums / np.sqrt(counts).astype(np.float32)[:, None]
    own = np.take(squares, rows, axis=0)
    own += grad * grad
    squares[rows] = own
    own += 1
    np.sqrt(own, out=own)
    grad *= np.float32(RATE)
    grad /= own
    table[rows] -= grad


def merged(rows: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows with the sums and counts of all groups that have them."""
    order, cuts, many, used = grouped(rows)
    return used, summed(sums, order, cuts, many), summed(counts, order, cuts, many)


def missed(parts: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Gradient of the loss of each line by its logits, the sum of lines of tables; SLICE lines at once stay in the processor's cache."""
    error = np.empty((len(target), parts[0][0].shape[1]), np.float32)
    for i in range(0, len(target), SLICE):
        x = error[i : i + SLICE]
        total(parts, slice(i, i + SLICE), x)
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        x[np.arange(len(x)), target[i : i + SLICE]] -= 1
    return error


def total(parts: list[tuple[np.ndarray, np.ndarray]], some: slice | np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Sum of the lines that each table's rows name."""
    table, rows = parts[0]
    out = np.take(table, rows[some], axis=0, out=out, mode="clip")  # without a copy in between
    for table, rows in parts[1:]:
        out += np.take(table, rows[some], axis=0)
    return out


def pair_parts(table: np.ndarray, pairs: np.ndarray, skip: bool) -> np.ndarray:
    """What the features of a pair of classes add to the logits of classes."""
    return np.take(table, pair_rows(pairs, skip), axis=0) + np.take(table, single_rows(pairs, skip), axis=0)


def descend_classes(table: np.ndarray, squares: np.ndarray, keys: np.ndarray, start: np.ndarray, target: np.ndarray) -> None:
    """One adaptive gradient step of the table for classes on the mean loss of some tokens, in place.

    Pairs of classes repeat within a step: their features are added up, and their gradients summed, once for each distinct pair.
    """
    groups, parts = [grouped(keys[i]) for i in (1, 2)], [(table, keys[0])]
    for skip, (_, _, _, pairs) in enumerate(groups):
        place = np.empty(PAIRS, np.int32)
        place[pairs] = np.arange(len(pairs))
        parts.append((pair_parts(table, pairs, skip), place[keys[1 + skip]]))
    parts[1][0][:] += table[bias_rows()] + start
    error = missed(parts, target)
    order, cuts, counts, rows = grouped(keys[0])
    moved(table, squares, rows, summed(error, order, cuts, counts), counts)
    for skip, (order, cuts, counts, pairs) in enumerate(groups):
        sums = summed(error, order, cuts, counts)
        moved(table, squares, *merged(pair_rows(pairs, skip), sums, counts))
        moved(table, squares, *merged(single_rows(pairs, skip), sums, counts))
        if not skip:
            moved(table, squares, bias_rows(), sums.sum(0, keepdims=True), counts.sum(keepdims=True))


def descend_cells(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, start: np.ndarray, classes: np.ndarray, target: np.ndarray, bits: int) -> None:
    """One such step of the table for cells. start: what stands before a class's rows are added."""
    bias = bias_rows(bits)
    error = missed([(start + table[bias], classes), *((table, r) for r in rows)], target)
    for r in (bias[classes], *rows):
        order, cuts, counts, used = grouped(r)
        moved(table, squares, used, summed(error, order, cuts, counts), counts)


def log_share(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log of the probability that the softmax of the logits x, which it takes over, gives each line's target."""
    x -= x[np.arange(len(x)), target][:, None]
    top = np.maximum(x.max(1), 0)
    x -= top[:, None]
    np.exp(x, out=x)
    return -(top + np.log(x.sum(1, dtype=np.float64)))


class Scorer:
    """Log probabilities of tokens by trained tables. What a pair of classes, and a class's bias, add to the logits is added up once."""

    def __init__(self, outer: np.ndarray, inner: np.ndarray, totals: Totals, bits: int):
        pairs = np.arange(PAIRS, dtype=np.int32)
        self.outer, self.inner = outer, inner
        self.near, self.far = pair_parts(outer, pairs, False) + (outer[bias_rows()] + totals.outer), pair_parts(outer, pairs, True)
        self.start = totals.inner + inner[bias_rows(bits)]

    def logs(self, classes: np.ndarray, cells: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(classes))
        for i in range(0, len(classes), SLICE):
            some = slice(i, i + SLICE)
            out[some] = log_share(total(list(zip((self.outer, self.near, self.far), keys, strict=True)), some), classes[some])
        rest = np.flatnonzero(classes >= FREQUENT)
        for i in range(0, len(rest), SLICE):
            some = rest[i : i + SLICE]
            out[some] += log_share(total([(self.start, classes), *((self.inner, r) for r in rows)], some), cells[some])
        return out


def opened(r: dict, bits: int) -> tuple[np.ndarray, ...]:
    """A batch's first tokens, classes, cells, and what both tables know of each token."""
    first, classes, hashed = np.frombuffer(r["first"], "<i8"), np.frombuffer(r["classes"], "u1").astype(np.int32), np.frombuffer(r["hashed"], "<u2")
    return first, classes, hashed.astype(np.int32) % CELLS, *features(classes, hashed, first, bits)


def trained(streams: DataFrame, totals: Totals, bits: int, learners: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The weight tables of classes and cells after one pass over the training tokens of all batches."""
    spark = streams.sparkSession
    sizes = (1 << BITS) * CLASSES, (1 << bits) * CELLS
    flat = np.zeros(sum(sizes), np.float32)
    tables = lambda x: (x[: sizes[0]].reshape(-1, CLASSES), x[sizes[0] :].reshape(-1, CELLS))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(flat)

        @trimmed
        def learn(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, squares, seen = shared.value.copy(), np.zeros(sum(sizes), np.float32), 0
            (outer, inner), (outer2, inner2) = tables(own), tables(squares)
            for part in parts:
                for i in range(part.num_rows):
                    r = part.slice(i, 1).to_pylist()[0]
                    first, classes, cells, keys, rows = opened(r, bits)
                    use = np.flatnonzero(np.repeat(np.frombuffer(r["held"], "u1") == 0, np.diff(first)))
                    for j in range(0, len(use), STEP):
                        some = use[j : j + STEP]
                        descend_classes(outer, outer2, keys[:, some], totals.outer, classes[some])
                        some = some[classes[some] >= FREQUENT]
                        if len(some):
                            descend_cells(inner, inner2, rows[:, some], totals.inner, classes[some], cells[some], bits)
                    seen += len(use)
            if seen:
                grains = np.round(own * GRAIN).astype("<i4")
                blocks = [grains[i : i + BLOCK].tobytes() for i in range(0, len(grains), BLOCK)]
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "n": pa.array([seen] * len(blocks), pa.int64()), "sums": pa.array(blocks, pa.binary())})

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for part in parts:
                for block, n, values in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    got = sums.setdefault(block, [0, 0.0])
                    got[0] += n
                    got[1] = got[1] + np.frombuffer(values, "<i4").astype(np.float64) * n
            if sums:
                yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "sums": pa.array([(x[1] / x[0] / GRAIN).astype(np.float32).tobytes() for x in sums.values()], pa.binary())})

        part = streams.where(F.pmod(F.xxhash64("batch"), F.lit(rounds)) == k).select("batch", "held", "first", "classes", "hashed")
        # batches stay where they are read: files of the same sizes are dealt alike
        dealt = part.coalesce(learners).sortWithinPartitions("batch")
        blocks = dealt.mapInArrow(learn, "block int, n long, sums binary").repartition(-(-len(flat) // BLOCK), "block")
        for r in blocks.mapInArrow(add, "block int, sums binary").toLocalIterator():
            values = np.frombuffer(r.sums, np.float32)
            flat[r.block * BLOCK : r.block * BLOCK + len(values)] = values
    return tables(flat)


def lm_scores(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Words are parted by ASCII white space and lower-cased in A-Z; each text, null and empty ones too, ends in one more token. Rows whose
    crc32(doc_id as text) mod modulus is held are scored but not learnt from (a null doc_id is learnt from). base_score is the
    add-one unigram's log10 probability, score the model's. Without training rows the model is uniform over classes and cells. Rows that
    share a doc_id each count and each give a row; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    root = scratch_root(spark)
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out, F.col("text").cast("string").alias("text"))
    size = text_bytes(narrow)[1]
    buckets, learners = shards_for(size, RANGE_BYTES, 8), shards_for(size, ROUNDS * BATCHES_OF_LEARNER * BATCH_BYTES, 4)
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_OF_ROW).bit_length()))
    batches = staged(batches_of(narrow, buckets), "batches", root)
    known = staged(counted(batches, buckets), "known", root)
    totals = Totals(known)
    streams = staged(coded(batches, known, totals), "streams", root)
    model = spark.sparkContext.broadcast(trained(streams, totals, bits, learners))
    tokens = totals.tokens

    @trimmed
    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value, totals, bits)
        for part in parts:
            for k in range(part.num_rows):
                r = part.slice(k, 1).to_pylist()[0]
                first, *tokens_of = opened(r, bits)
                logs = scorer.logs(*tokens_of)
                whole = np.add.reduceat(logs, first[:-1]) / np.log(10) + np.frombuffer(r["inner"], np.float64)
                ids, n = np.frombuffer(r["doc_id"], "<i8"), len(first) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=np.frombuffer(r["null"], "u1") > 0), pa.array(np.frombuffer(r["held"], "u1") > 0), pa.array(np.diff(first)), pa.array(np.frombuffer(r["known"], np.int64)), pa.array(np.full(n, tokens, np.int64)), pa.array(np.frombuffer(r["base"], np.float64)), pa.array(whole)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return streams.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
