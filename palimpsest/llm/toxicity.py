"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 8).

Each word enters with word and character inputs. Both are one-number embeddings by hash, set from the labelled sample:
the log odds at which training documents with the word, or with a run of 4, 5 or 6 bytes of it, are toxic, shrunk to
zero where few documents have it. Per word the network sees the word's value and the largest and smallest of its runs
of each width. Windows of WINDOW words overlap by half; in each, two recurrent layers run over the words, attention
pools their states and a logistic unit gives the window's probability. A document's score is that of its worst window.

Labels say only that something in a document is toxic, so the windows trained on are picked from each sampled
document by their inputs: the one that looks worst, which for a clean document is the hardest case it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import raw, remainder, ship, slices, trimmed
from palimpsest.llm.gru import Adam, backward, new_layer, run
from palimpsest.llm.language_id import sample
from palimpsest.llm.words import NOT_ALNUM, bounds, lowered, prefix_hash, span_hash

WINDOW, STRIDE = 24, 12
WIDTHS = (4, 5, 6)
#: Buckets of each embedding table, and documents below which a bucket's value stays 0.
BUCKETS = 1 << 18
SUPPORT = 5
#: Added to both counts of a bucket, so that a few chance hits give no high odds.
PRIOR = 3.0
#: Sets a run at the beginning of a word apart from the same bytes within one.
BEGINS = 0x15555
#: Training: documents of each label at most, hidden units, passes, windows a step.
SAMPLE = 4000
HIDDEN = 6
PASSES = 16
BATCH = 128
WIDE = 4096
INPUTS = 1 + 2 * len(WIDTHS)


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Bucket of each word; for each width the bucket of each run of bytes and the word it is in; words before each text."""
    low = lowered(data)
    starts, ends, first = bounds(low, offsets, NOT_ALNUM)
    prefix = prefix_hash(low)
    words = (span_hash(prefix, starts, ends) >> np.uint64(46)).astype(np.int64)
    runs = []
    sizes = ends - starts
    for k, width in enumerate(WIDTHS, 1):
        many = np.maximum(sizes - width + 1, 0)
        owner = np.repeat(np.arange(len(starts)), many)
        at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        bucket = (span_hash(prefix, at, at + width) >> np.uint64(46)).astype(np.int64)
        bucket[at == starts[owner]] ^= BEGINS
        runs.append((k * BUCKETS + bucket, owner))
    return words, runs, first


def inputs_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, INPUTS) values of all words, and the number of words before each text."""
    words, runs, first = buckets_of(data, offsets)
    out = np.zeros((len(words), INPUTS), np.float32)
    out[:, 0] = table[words]
    for k, (bucket, owner) in enumerate(runs):
        if len(bucket):
            values = table[bucket]
            own, at = np.unique(owner, return_index=True)
            out[own, 1 + 2 * k] = np.maximum.reduceat(values, at)
            out[own, 2 + 2 * k] = np.minimum.reduceat(values, at)
    return out, first


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every window over the words, and the text it is of; a text without words has one of length 0."""
    sizes = np.diff(first)
    many = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes)), many)
    start = first[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return start, np.minimum(WINDOW, first[1:][owner] - start), owner


class Network:
    def __init__(self, table: np.ndarray, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = table
        self.fore, self.back = new_layer(rng, INPUTS, hidden), new_layer(rng, INPUTS, hidden)
        self.out = {"a": np.zeros((2 * hidden, 1), np.float32), "u": (rng.standard_normal((2 * hidden, 1)) * 0.3).astype(np.float32), "c": np.zeros((1, 1), np.float32)}

    def states(self, x: np.ndarray, keep: bool = False):
        """x: (WINDOW, INPUTS, n)."""
        steps, n = range(len(x)), x.shape[2]
        fore = run(self.fore, lambda t: self.fore["W"] @ x[t] + self.fore["b"], steps, n, keep)
        back = run(self.back, lambda t: self.back["W"] @ x[t] + self.back["b"], steps[::-1], n, keep)
        return fore, back

    def pooled(self, x: np.ndarray, length: np.ndarray, keep: bool = False):
        (fore, tape_f), (back, tape_b) = self.states(x, keep)
        h = np.stack([np.concatenate([fore[t], back[t]]) for t in range(len(x))])
        weight = (h * self.out["a"]).sum(1)
        weight = np.where(np.arange(len(x))[:, None] < np.maximum(length, 1), weight, -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        mean = (h * weight[:, None]).sum(0)
        return mean, weight, h, tape_f, tape_b

    def probabilities(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        mean = self.pooled(x, length)[0]
        return 1 / (1 + np.exp(-np.clip((self.out["u"] * mean).sum(0) + self.out["c"][0, 0], -30, 30)))

    def train(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, passes: int = PASSES, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> None:
        """x: (n, WINDOW, INPUTS)."""
        rng = np.random.default_rng(seed)
        adam = Adam({f"{n}{k}": v for n, layer in (("f", self.fore), ("b", self.back), ("o", self.out)) for k, v in layer.items()}, rate)
        n = self.fore["U"].shape[1]
        done, total = 0, max(1, passes * -(-len(x) // batch))
        for _ in range(passes):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                own = np.ascontiguousarray(x[some].transpose(1, 2, 0))
                mean, weight, h, tape_f, tape_b = self.pooled(own, length[some], keep=True)
                logit = (self.out["u"] * mean).sum(0) + self.out["c"][0, 0]
                e = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[some]) / len(some)).astype(np.float32)
                to_mean = self.out["u"] * e
                match = (h * to_mean).sum(1)
                to_weight = weight * (match - (weight * match).sum(0))
                to_h = weight[:, None] * to_mean + self.out["a"] * to_weight[:, None]
                grads = {"ou": (mean * e).sum(1, keepdims=True), "oc": e.sum().reshape(1, 1), "oa": (h * to_weight[:, None]).sum((0, 2)).reshape(-1, 1)}
                for name, layer, tape, part in (("f", self.fore, tape_f, slice(0, n)), ("b", self.back, tape_b, slice(n, 2 * n))):
                    got = backward(layer, tape, lambda t, part=part: to_h[t][part], lambda t, g: own[t])
                    grads |= {f"{name}{k}": v for k, v in got.items()}
                done += 1
                adam.update(grads, 1 - 0.9 * done / total)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text: the probability of its worst window."""
        words, first = inputs_of(data, offsets, self.table)
        start, length, owner = windows_of(first)
        words = np.concatenate([words, np.zeros((1, INPUTS), np.float32)])
        score = np.zeros(len(first) - 1)
        for i in range(0, len(start), WIDE):
            own = slice(i, i + WIDE)
            at = np.where(np.arange(WINDOW)[:, None] < length[own], start[own] + np.arange(WINDOW)[:, None], len(words) - 1)
            p = self.probabilities(np.ascontiguousarray(words[at].transpose(0, 2, 1)), length[own])
            np.maximum.at(score, owner[own], p)
        return score


def odds(docs: DataFrame) -> np.ndarray:
    """The embedding tables: shrunk log odds of each bucket over labelled documents (label, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, BUCKETS * (1 + len(WIDTHS))), np.int32), np.zeros(2, np.int64)
        for batch in slices(batches):
            words, runs, first = buckets_of(*raw(batch.column("text")))
            owners = [np.repeat(np.arange(batch.num_rows), np.diff(first))]
            owners += [owners[0][w] for _, w in runs]
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            n += np.bincount(labels, minlength=2)
            code = np.unique(np.concatenate(owners) * seen.shape[1] + np.concatenate([words, *(b for b, _ in runs)]))
            np.add.at(seen, (labels[code // seen.shape[1]], code % seen.shape[1]), 1)
        used = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_pydict({"used": [used.astype("<i4").tobytes()], "seen": [seen[:, used].astype("<i4").tobytes()], "n": [n.tobytes()]})

    seen, n = np.zeros((2, BUCKETS * (1 + len(WIDTHS)))), np.zeros(2)
    for r in docs.select("label", "text").repartition(8).mapInArrow(count, "used binary, seen binary, n binary").toLocalIterator():
        used = np.frombuffer(r.used, "<i4")
        seen[:, used] += np.frombuffer(r.seen, "<i4").reshape(2, -1)
        n += np.frombuffer(r.n, np.int64)
    rate = (seen + PRIOR) / (n[:, None] + 2 * PRIOR)
    return np.where(seen.sum(0) >= SUPPORT, np.clip(np.log(rate[1] / rate[0]), -5, 5), 0).astype(np.float32)


def trained(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, passes: int = PASSES) -> Network | None:
    """A network trained on up to about per_label documents of each label; None without both labels."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # the sample is drawn from the labels, so it is small when it meets the texts
    ids = sample(known, per_label, "toxic", 1).select("doc_id", "label", "key").orderBy("key").limit(4 * per_label + 400)
    some = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "key", "text").persist()
    try:
        table = odds(some)
        shared = spark.sparkContext.broadcast(table)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                words, first = inputs_of(*raw(batch.column("text")), shared.value)
                start, length, owner = windows_of(first)
                words = np.concatenate([words, np.zeros((1, INPUTS), np.float32)])
                worst = np.concatenate([[0], np.cumsum(np.maximum(words[:-1], 0).max(1) ** 2)]) if len(words) > 1 else np.zeros(1)
                value = worst[start + length] - worst[start]
                order = np.lexsort((start, -value, owner))
                best = order[np.unique(owner[order], return_index=True)[1]]
                at = np.where(np.arange(WINDOW) < length[best][:, None], start[best][:, None] + np.arange(WINDOW), len(words) - 1)
                yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), batch.column("key"), pa.array([x.tobytes() for x in words[at]], pa.binary()), pa.array(length[best], pa.int64())], names=["label", "key", "x", "length"])

        rows = some.mapInArrow(pick, "label int, key long, x binary, length long").orderBy("key", "x").limit(4 * per_label + 400).collect()
    finally:
        some.unpersist()
    y = np.array([r.label for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(r.x, np.float32).reshape(WINDOW, INPUTS) for r in rows])
    network = Network(table)
    network.train(x, np.array([r.length for r in rows]), y, passes)
    return network


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5) of each row of docs.

    Null texts are empty ones; a text without words gets the score of a window without words. Labels come only from rows whose
    crc32(doc_id as text) mod 5 isn't 0; with several labels a document counts as toxic if one says so. Without rows of both labels every
    score is 0. Rows that share a doc_id each give a row; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(trained(narrow, labels, per_label))

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in slices(batches):
            p = own.documents(*raw(batch.column("text"))) if own else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return narrow.select("doc_id", held, "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
