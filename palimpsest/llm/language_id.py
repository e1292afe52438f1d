"""Language identification by a bidirectional gated recurrent network over bytes (operator 10).

A text's bytes are cut into blocks of BLOCK bytes; both directions start anew in each block. The two states of a
position give it a distribution over the languages; a document's distribution is the mean over all its positions.
The network is trained by backpropagation through time in numpy, on the driver, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import raw, remainder, ship, slices, trimmed
from palimpsest.llm.gru import Adam, backward, new_layer, run

BLOCK = 64
HIDDEN = 8
#: Training: labelled rows for each language at most, blocks of each such row, blocks a step, passes.
SAMPLE = 300
BLOCKS_OF_ROW = 4
BATCH = 256
PASSES = 6
#: Blocks that are scored at once.
WIDE = 2048


def sample(rows: DataFrame, per_label: int, label: str, share_of: int, modulus: int = 5, held: int = 0) -> DataFrame:
    """About share_of * per_label training rows for each label, whatever their number, those whose ids have the smallest hash, with label and key (that hash)."""
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    rows = rows.withColumns({"label": F.col(label), "key": F.xxhash64(F.col("doc_id").cast("long"))})
    many = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), (share_of * per_label + 50) / F.col("_n"))
    # keys are spread evenly over all longs
    return rows.join(many, "label").where((F.col("key") / F.lit(2.0**64) + 0.5) <= share).drop("_n")


def training_blocks(docs: DataFrame, per_language: int, most: int = BLOCKS_OF_ROW) -> list[tuple[str, np.ndarray]]:
    """Language and evenly spaced blocks of up to per_language training rows of each language: the bounded sample that the network is fitted on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [blocks_of(x, most).astype("<i2").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"), pa.array(packed, pa.binary())], names=["label", "key", "blocks"])

    known = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    some = sample(known, per_language, "lang", 2).select("label", "key", "text").mapInArrow(cut, "label string, key long, blocks binary")
    place = F.row_number().over(W.partitionBy("label").orderBy("key", "blocks"))
    rows = some.withColumn("_place", place).where(F.col("_place") <= per_language).select("label", "key", "blocks").collect()
    return [(r.label, np.frombuffer(r.blocks, "<i2").reshape(-1, BLOCK).astype(np.int64)) for r in sorted(rows, key=lambda r: (r.key, r.label, r.blocks))]


class Network:
    """Two layers and an output over their states; inputs are rows of a table by byte (256 is padding)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.fore, self.back = ({"W": (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32), **{k: v for k, v in new_layer(rng, 1, hidden).items() if k != "W"}} for _ in range(2))
        self.out = {"V": (rng.standard_normal((len(langs), 2 * hidden)) * 0.3).astype(np.float32), "v": np.zeros((len(langs), 1), np.float32)}

    def states(self, blocks: np.ndarray, keep: bool = False):
        """blocks: (BLOCK, n) byte codes."""
        tables = [np.ascontiguousarray(x["W"].T + x["b"]) for x in (self.fore, self.back)]
        steps, n = range(len(blocks)), blocks.shape[1]
        fore = run(self.fore, lambda t: tables[0][:, blocks[t]], steps, n, keep)
        back = run(self.back, lambda t: tables[1][:, blocks[t]], steps[::-1], n, keep)
        return fore, back

    def positions(self, blocks: np.ndarray) -> Iterator[np.ndarray]:
        """The distribution over languages at each position: (languages, n) for each step."""
        (fore, _), (back, _) = self.states(blocks)
        h = self.out["V"].shape[1] // 2
        for t in range(len(blocks)):
            x = self.out["V"][:, :h] @ fore[t] + self.out["V"][:, h:] @ back[t] + self.out["v"]
            x -= x.max(0)
            np.exp(x, out=x)
            x /= x.sum(0)
            yield x

    def train(self, blocks: np.ndarray, labels: np.ndarray, passes: int = PASSES, batch: int = BATCH, rate: float = 0.02, seed: int = 7) -> None:
        """blocks: (n, BLOCK); labels: (n,). Every position that isn't padding is a case."""
        rng = np.random.default_rng(seed)
        weights = {f"{n}{k}": v for n, layer in (("f", self.fore), ("b", self.back), ("o", self.out)) for k, v in layer.items()}
        adam = Adam(weights, rate)
        h = self.out["V"].shape[1] // 2
        total, done = max(1, passes * -(-len(blocks) // batch)), 0
        for _ in range(passes):
            order = rng.permutation(len(blocks))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                x, y = np.ascontiguousarray(blocks[some].T), labels[some]
                (fore, tape_f), (back, tape_b) = self.states(x, keep=True)
                one = np.zeros((len(self.langs), len(some)), np.float32)
                one[y, np.arange(len(some))] = 1
                gv, gb, errors = np.zeros_like(self.out["V"]), np.zeros_like(self.out["v"]), {}
                cases = max(1, int((x < 256).sum()))
                for t in range(len(x)):
                    s = np.concatenate([fore[t], back[t]])
                    p = self.out["V"] @ s + self.out["v"]
                    p -= p.max(0)
                    np.exp(p, out=p)
                    p /= p.sum(0)
                    e = (p - one) * (x[t] < 256) / cases
                    gv += e @ s.T
                    gb += e.sum(1, keepdims=True)
                    errors[t] = self.out["V"].T @ e
                grads = {"oV": gv, "ov": gb}
                for name, layer, tape, part in (("f", self.fore, tape_f, slice(0, h)), ("b", self.back, tape_b, slice(h, 2 * h))):
                    table = np.zeros_like(layer["W"])

                    def spread(t, g, table=table):
                        for k in range(len(g)):
                            table[:, k] += np.bincount(x[t], weights=g[k], minlength=257)

                    got = backward({"U": layer["U"], "b": layer["b"], "W": layer["W"]}, tape, lambda t, part=part: errors[t][part], spread)
                    grads |= {f"{name}U": got["U"], f"{name}b": got["b"], f"{name}W": table}
                done += 1
                adam.update(grads, 1 - 0.9 * done / total)

    def documents(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Mean distribution of each text: (texts, languages); zeros for an empty one."""
        sizes = np.diff(offsets)
        n_blocks = -(-sizes // block)
        owner = np.repeat(np.arange(len(sizes)), n_blocks)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = offsets[:-1][owner] + index * block
        left = np.minimum(block, offsets[1:][owner] - start)
        total = np.zeros((len(sizes), len(self.langs)))
        order = np.argsort(-left, kind="stable")  # blocks of like length together: short ones waste no steps
        for i in range(0, len(order), WIDE):
            some = order[i : i + WIDE]
            longest = int(left[some[0]])
            at = start[some] + np.arange(longest)[:, None]
            inside = np.arange(longest)[:, None] < left[some]
            codes = np.where(inside, data[np.minimum(at, len(data) - 1)], 256).astype(np.int64)
            pooled = np.zeros((len(self.langs), len(some)))
            for t, p in enumerate(self.positions(codes)):
                pooled += p * inside[t]
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(owner[some], weights=pooled[k], minlength=len(sizes))
        return total / np.maximum(sizes, 1)[:, None]


def blocks_of(text: str, most: int = BLOCKS_OF_ROW, block: int = BLOCK) -> np.ndarray:
    """Evenly spaced blocks of a text, padded with 256."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(0, max(len(data), 1), block)
    starts = starts[np.unique(np.linspace(0, len(starts) - 1, most).astype(int))]
    out = np.full((len(starts), block), 256, np.int64)
    for row, s in zip(out, starts, strict=True):
        row[: len(data[s : s + block])] = data[s : s + block]
    return out


def trained(docs: DataFrame, per_language: int = SAMPLE, passes: int = PASSES) -> Network | None:
    rows = training_blocks(docs, per_language)
    langs = sorted({x for x, _ in rows})
    if not langs:
        return None
    network = Network(langs)
    labels = np.repeat([langs.index(x) for x, _ in rows], [len(b) for _, b in rows])
    network.train(np.concatenate([b for _, b in rows]), labels, passes)
    return network


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, training: DataFrame | None = None, per_language: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the mean probability of that language) of each row of docs.

    A text that is null or has no letter gets `und` with score 0; so does every text if no row of training (docs
    itself if not given) is labelled. Labels come only from rows whose crc32(doc_id as text) mod 5 isn't 0; a null
    doc_id is never held out and never trained on. The network is fitted on up to per_language rows of each language (those whose ids have
    the smallest hash), four blocks of 64 bytes of each; there may be any number of languages. Ties go to the language that sorts first. keep names further
    columns of docs to carry along. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    network = trained(docs if training is None else training, per_language)
    model = spark.sparkContext.broadcast(network)
    more = [c for c in (keep or []) if c not in ("doc_id", "text")]

    @trimmed
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in slices(batches):
            texts = batch.column("text")
            letters = np.array([has_letter(x) for x in texts.to_pylist()], bool)
            if own is None:
                pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = own.documents(*raw(texts))
                best = p.argmax(1)
                pred = [own.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, np.clip(p.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    if keep is None:
        kept = ["doc_id", "held_out"]
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    else:
        kept = ["doc_id", "text", *more]
        narrow = docs.select(*kept)
    schema = narrow.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return narrow.mapInArrow(label, schema)
