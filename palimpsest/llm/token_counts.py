"""Token counts by a map-side two-tier lookup (operator 5).

Tier one is a broadcast table of token counts of frequent pieces; tier two a bounded cache in each Python
worker, filled from the tokenizer itself. A piece is what lies between two single spaces or line
ends: a byte-level vocabulary never merges across these, so counts of pieces add up to the count of the text and
no piece is ever shuffled. White space that touches other white space stays inside a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import fixed_workers, lengths, raw, ship, slices, trimmed
from palimpsest.llm.words import HashTable, span_hashes

#: Documents of which the broadcast table is made; it changes the speed, never a count.
WARM_DOCS = 2000
#: Entries of the broadcast table, each of at most LONGEST characters: below 4 MB in all.
TABLE_SIZE = 65_536
LONGEST = 64
#: A worker's cache has two tables of 2**CACHE_BITS entries, 24 MB in all; further pieces overwrite old ones.
CACHE_BITS = 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: How a byte-level vocabulary writes a space and a line end.
MARKS = "\u0120\u010a"
#: Last and first bytes that a white-space character can have in UTF-8; others share them, which only cuts fewer pieces.
MAYBE_BLANK_LAST = np.zeros(256, bool)
MAYBE_BLANK_FIRST = np.zeros(256, bool)
for _c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    MAYBE_BLANK_LAST[chr(_c).encode()[-1]] = True
    MAYBE_BLANK_FIRST[chr(_c).encode()[0]] = True
#: Bytes before the last one of the longer of them.
MAYBE_BLANK_FORE = np.zeros(256, bool)
MAYBE_BLANK_FORE[[0xC2, 0x9A, 0x80, 0x81]] = True

_workers: dict[tuple, "PieceCounter"] = {}


class PieceCounter:
    """Counts the tokens of texts with the library at path, piece by piece."""

    def __init__(self, path: str, frequent: tuple[np.ndarray, np.ndarray] | None = None, bits: int = CACHE_BITS):
        fixed_workers()
        self.marks = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda text: model.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            pre = tokenizer.pre_tokenizer
            if tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space:
                # ids of tokens that begin with a space or a line end: a piece has one at its start and none within
                self.marks = np.zeros((2, tokenizer.get_vocab_size()), bool)
                for k, mark in enumerate(MARKS):
                    self.marks[k, [i for x, i in tokenizer.get_vocab().items() if x[0] == mark]] = True
        self.frequent = HashTable(17)
        if frequent is not None and len(frequent[0]):
            self.frequent.put(*frequent)
        self.cache = HashTable(bits)

    def whole(self, text: str) -> int:
        return len(self.encode(text))

    def encode_pieces(self, pieces: list[str], kind: int) -> np.ndarray:
        """Tokens of each piece when a space (kind 0) or a line end (1) stands before it."""
        out, mark = [], " \n"[kind]
        for i in range(0, len(pieces), 512):
            some = pieces[i : i + 512]
            ids = np.array(self.encode(mark + mark.join(some)), np.int64)
            starts = np.flatnonzero(self.marks[kind, ids])
            if len(starts) == len(some):
                out.append(np.diff(np.append(starts, len(ids))))
            else:  # a special string stands between its space and the next token
                out.append(np.array([self.whole(mark + x) for x in some], np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each piece and the number of pieces before each text. A piece leaves out the space before it, but keeps a line end."""
        blank = np.flatnonzero((data == 32) | (data == 10))
        inner = blank[(blank > 0) & (blank + 1 < len(data))]
        # it parts two pieces if neither neighbour is white space (any byte that may be part of such counts)
        last = data[inner - 1]
        after = MAYBE_BLANK_LAST[last] & ((last < 128) | MAYBE_BLANK_FORE[data[np.maximum(inner - 2, 0)]])
        inner = inner[~after & ~MAYBE_BLANK_FIRST[data[inner + 1]]]
        edge = np.zeros(len(data) + 1, bool)  # one that begins or ends a text parts nothing
        edge[offsets] = True
        inner = inner[~edge[inner] & ~edge[inner + 1]]
        full = np.flatnonzero(np.diff(offsets) > 0)
        starts = np.concatenate([offsets[:-1][full], inner + (data[inner] == 32)])
        ends = np.concatenate([offsets[1:][full], inner])
        starts.sort()
        ends.sort()
        return starts, ends, np.searchsorted(starts, offsets)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of data."""
        if self.marks is None:
            blob = data.tobytes()
            return np.array([self.whole(blob[a:b].decode()) if b > a else 0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
        starts, ends, first = self.pieces(data, offsets)
        hashes = span_hashes(data, starts, ends)
        heads = first[:-1][np.diff(offsets) > 0]  # a text's first piece has no space before it
        found = self.frequent.get(hashes)
        rest = np.flatnonzero(found < 0)
        found[rest] = self.cache.get(hashes[rest])
        found[heads] = 0
        rest = np.flatnonzero(found < 0)
        blob = data.tobytes()
        if len(rest):
            fresh, where, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
            at = rest[where]
            texts = [blob[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            line = np.array([x[0] == "\n" for x in texts])
            odd = np.array([len(x) > LONGEST or len(x.split()) != 1 for x in texts])
            counts = np.zeros(len(texts), np.int64)
            for kind in (0, 1):
                plain = np.flatnonzero(~odd & (line == bool(kind)))
                counts[plain] = self.encode_pieces([texts[i].lstrip("\n") for i in plain], kind)
            for i in np.flatnonzero(odd):
                counts[i] = self.whole(texts[i] if line[i] else " " + texts[i])
            found[rest] = counts[back]
            self.cache.put(fresh, counts)
        for i in heads.tolist():
            found[i] = self.whole(blob[starts[i] : ends[i]].decode())
        total = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
        return total[first[1:]] - total[first[:-1]]


def counter(path: str, frequent: tuple[np.ndarray, np.ndarray], bits: int) -> PieceCounter:
    """The worker's own counter: it outlives a task."""
    key = (path, bits, len(frequent[0]), int(frequent[0][:1].sum()))
    if key not in _workers:
        _workers.clear()
        _workers[key] = PieceCounter(path, frequent, bits)
    return _workers[key]


def frequent_pieces(docs: DataFrame, path: str, warm_docs: int = WARM_DOCS, table_size: int = TABLE_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of the most frequent pieces of about warm_docs documents, drawn over the whole table by a hash of doc_id where it is scanned."""

    @trimmed
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = PieceCounter(path, bits=4), {}
        if own.marks is None:
            return
        for batch in slices(batches, 1 << 20):
            data, offsets = raw(batch.column(0))
            starts, ends, _ = own.pieces(data, offsets)
            hashes, at, counts = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
            short = np.flatnonzero(ends[at] - starts[at] <= LONGEST)
            for h, i, n in zip(hashes[short].tolist(), at[short].tolist(), counts[short].tolist(), strict=True):
                if h in seen:
                    seen[h][0] += n
                else:
                    seen[h] = [n, data[starts[i] : ends[i]].tobytes().decode()]
        yield pa.RecordBatch.from_pydict({"hash": pa.array([np.uint64(h).astype(np.int64) for h in seen], pa.int64()), "uses": pa.array([n for n, _ in seen.values()], pa.int64()), "piece": pa.array([x for _, x in seen.values()])})

    share = min(1.0, warm_docs / max(1, docs.count()))
    drawn = docs.where(F.xxhash64("doc_id") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).select(F.col("text").cast("string").alias("text"))
    pieces = drawn.mapInArrow(top, "hash long, uses long, piece string").groupBy("hash").agg(F.sum("uses").alias("uses"), F.min("piece").alias("piece"))
    rows = pieces.orderBy(F.desc("uses"), "hash").limit(table_size).collect()
    own = PieceCounter(path, bits=4) if rows else None
    counts = np.zeros(len(rows), np.int32)
    for kind in (0, 1):
        at = [i for i, r in enumerate(rows) if (r.piece[0] == "\n") == bool(kind)]
        counts[at] = [own.whole(rows[i].piece if kind else " " + rows[i].piece) for i in at]
    return np.array([r.hash for r in rows], np.int64).view(np.uint64), counts


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, warm_docs: int = WARM_DOCS, table_size: int = TABLE_SIZE, cache_bits: int = CACHE_BITS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs.

    Null and empty texts have 0 tokens; rows with the same or a null doc_id each give a row; an empty table gives
    no rows; columns other than doc_id and text are ignored. Texts of any length are counted whole.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, warm_docs, table_size))

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, table.value, cache_bits)
        for batch in slices(batches, 1 << 20):
            tokens = own.count(*raw(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(lengths(batch.column(1))), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, SCHEMA)
