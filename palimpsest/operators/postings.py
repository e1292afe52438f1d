"""Indexes of words and of letter grams as stored tables: immutable segments of postings with what changes add and take away, and grams for parts of words and typos."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import folded, query_terms, query_words, substring_distance, words
from palimpsest.operators.store import Store, Version
from palimpsest.session import ship

#: Folders that terms are dealt to: a search reads only those of its terms.
BUCKETS = 64


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, term, tf, places (ascending, from 0), dl (words of the text) and bucket: a row for each text and term, made within the text's row."""
    placed = texts.select(*keys, F.array_sort(F.transform(words(F.col(text)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias("_w"))
    # in the order of words each first occurrence begins its word's run; the next one ends it
    starts = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: (i == 1) | (F.element_at("_w", i)["w"] != F.element_at("_w", F.greatest(i - 1, F.lit(1)))["w"]))
    cut = placed.where(F.size("_w") > 0).select(*keys, "_w", starts.alias("_s"))
    runs = F.zip_with("_s", F.concat(F.slice("_s", 2, F.size("_s")), F.array(F.size("_w") + 1)), lambda a, b: F.struct(F.element_at("_w", a)["w"].alias("term"), (b - a).alias("tf"), F.slice("_w", a, b - a)["i"].alias("places")))
    rows = cut.select(*keys, F.size("_w").alias("dl"), F.explode(runs).alias("x")).select(*keys, "x.term", "x.tf", "x.places", "dl")
    return rows.withColumn("bucket", bucket_of(F.col("term")))


def lengths(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys and dl; a null text is an empty one."""
    return texts.select(*keys, F.coalesce(F.size(words(F.col(text))), F.lit(0)).alias("dl"))


class WordIndex:
    """A log-structured index of words: immutable segments, the newest of which speaks for a text.

    A segment has postings by bucket, and mentions: the texts it speaks for with their length in words, null if the text is gone. An update writes one
    segment, in proportion to the change. Segments of a size class (FAN times as many texts as the class below) are merged into one when
    FAN of them stand together, so that a text is rewritten a logarithmic number of times; deletions go when the oldest segment takes part. What counts
    is a version of the store: its parts are segments from old to new, its facts the number of texts and of their words.
    """

    FAN = 4

    def __init__(self, store: Store, keys: Sequence[str]):
        self.store, self.keys = store, list(keys)
        self.spark = store.spark

    # segments

    def _write(self, rows: DataFrame, mentions: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.store.root}/{folder}/postings")
        mentions.write.parquet(f"{self.store.root}/{folder}/mentions")
        return folder

    def _read(self, folder: str, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.root}/{folder}/{kind}")

    def _mentions(self, folders: Sequence[str], after: int = 0) -> DataFrame:
        """keys, dl and place of segments from after on."""
        rows = [self._read(f, "mentions").withColumn("place", F.lit(i)) for i, f in enumerate(folders) if i >= after]
        return reduce(DataFrame.unionByName, rows)

    def _postings(self, folders: Sequence[str]) -> DataFrame:
        """Postings of all segments but those of texts that a newer segment speaks for."""
        rows = reduce(DataFrame.unionByName, (self._read(f, "postings").withColumn("place", F.lit(i)) for i, f in enumerate(folders)))
        if len(folders) == 1:
            return rows.drop("place")
        newer = self._mentions(folders, 1).groupBy(*self.keys).agg(F.max("place").alias("_last"))
        return rows.join(newer, self.keys, "left").where("_last is null or _last = place").drop("place", "_last")

    def _latest(self, folders: Sequence[str]) -> DataFrame:
        """keys and dl of what the newest segment says of each text."""
        return self._mentions(folders).groupBy(*self.keys).agg(F.max_by("dl", "place").alias("dl"))

    def _commit(self, number: int, parts: dict[str, str], facts: dict) -> None:
        schema = self._read(next(iter(parts.values())), "mentions").schema
        self.store.commit(parts, schema, number, facts)

    # changes

    def build(self, texts: DataFrame, text: str = "text") -> WordIndex:
        """A new index of texts in the place of what was there."""
        number = self.store._next(None)
        folder = self._write(postings(texts, self.keys, text), lengths(texts, self.keys, text))
        n, total = self._read(folder, "mentions").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self._commit(number, {f"{uuid.uuid4().hex}:{n}": folder}, {"texts": n, "words": total})
        return self

    def update(self, changed: DataFrame, gone: DataFrame, text: str = "text") -> WordIndex:
        """Take in changed texts and drop those that are gone. Only these are indexed and written; their old lengths are looked up in the mentions."""
        at = self._at()
        old = list(at.parts.values())
        dead = gone.select(*self.keys).join(changed.select(*self.keys), self.keys, "left_anti").distinct().withColumn("dl", F.lit(None).cast("int"))
        folder = self._write(postings(changed, self.keys, text), lengths(changed, self.keys, text).unionByName(dead))
        fresh = self._read(folder, "mentions")
        before = self._latest(old).join(fresh.select(*self.keys), self.keys, "left_semi").where("dl is not null")
        sums = lambda df: df.agg(F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0)), F.count(F.lit(1))).first()
        (n0, w0, _), (n1, w1, rows) = sums(before), sums(fresh)
        facts = {"texts": at.facts["texts"] - n0 + n1, "words": at.facts["words"] - w0 + w1}
        self._commit(at.number + 1, at.parts | {f"{uuid.uuid4().hex}:{rows}": folder}, facts)
        return self.merge()

    def merge(self, all_: bool = False) -> WordIndex:
        """Merge the newest segments as long as FAN of a size class stand together (all_: into one)."""
        while True:
            at = self._at()
            names = list(at.parts)
            level = [int(math.log(max(1, int(x.split(":")[1])), self.FAN)) for x in names]
            first = 0 if all_ else next((i for i in range(len(names)) if len(names) - i >= self.FAN and max(level[i:]) <= level[-1]), None)
            if first is None or len(names) - first < 2:
                return self
            folders = [at.parts[x] for x in names[first:]]
            latest = self._latest(folders)
            # what is deleted has to be said as long as an older segment may hold it
            latest = latest.where("dl is not null") if first == 0 else latest
            folder = self._write(self._postings(folders), latest)
            rows = self._read(folder, "mentions").count()
            self._commit(at.number + 1, {x: at.parts[x] for x in names[:first]} | {f"{uuid.uuid4().hex}:{rows}": folder}, at.facts)

    # searches

    def _at(self) -> Version:
        at = self.store.at()
        if at is None:
            raise ValueError("nothing was indexed yet")
        return at

    def none(self) -> DataFrame:
        return self._read(next(iter(self._at().parts.values())), "mentions").limit(0).select(*self.keys)

    def of(self, terms: Sequence[str]) -> DataFrame:
        """Postings of terms: their folders alone are read."""
        wanted = list(dict.fromkeys(terms))
        buckets = {r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket_of(F.col("t"))).collect()}
        return self._postings(list(self._at().parts.values())).where(F.col("bucket").isin(*buckets) & F.col("term").isin(*wanted))

    def bm25(self, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """keys and score of texts with all terms of query (the smaller the better); a term that the query repeats counts as often."""
        terms = query_terms(query)
        if not terms:
            return self.none().select(*self.keys, F.lit(0.0).alias("score"))
        facts = self._at().facts
        n, average = facts["texts"], facts["words"] / max(1, facts["texts"])
        found = self.of(terms)
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
        times = F.coalesce(*(F.when(F.col("term") == t, F.lit(terms.count(t))) for t in dict.fromkeys(terms)))
        idf = F.greatest(F.log((n - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-6))
        part = times * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
        # a row of statistics for each term of the query
        scored = found.join(F.broadcast(df), "term").select(*self.keys, "term", part.alias("_part"))
        return scored.groupBy(*self.keys).agg((-F.sum("_part")).alias("score"), F.count(F.lit(1)).alias("_terms")).where(F.col("_terms") == len(set(terms))).drop("_terms")

    def phrase(self, query: str) -> DataFrame:
        """keys and tf of texts in which the words of query follow one another."""
        terms = query_words(query)
        if not terms:
            return self.none().select(*self.keys, F.lit(0).alias("tf"))
        each = self.of(terms).groupBy(*self.keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_p"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(set(terms)))
        # places of each term, shifted by its place in the phrase, have the phrase's starts in common
        starts = F.element_at("_p", F.lit(terms[0]))
        for k, term in enumerate(terms[1:], 1):
            starts = F.array_intersect(starts, F.transform(F.element_at("_p", F.lit(term)), partial(sub, k)))
        return each.select(*self.keys, F.size(starts).alias("tf")).where("tf > 0")


def sub(k: int, x: Column) -> Column:
    return x - k


def pieces(term: str, n: int) -> list[str]:
    """The n-grams of a term, repeated ones kept."""
    return [term[i : i + n] for i in range(len(term) - n + 1)]


def edits_of(term: str) -> int:
    """Typos that a term may have: none below four letters, two from eight on."""
    return 0 if not 4 <= len(term) <= 64 else 2 if len(term) >= 8 else 1


def shared_pairs(term: str) -> tuple[dict[str, int], int]:
    """Pairs of letters with weights, and the weight that a text with a typo of term has of them at least.

    A typo takes at most three of the term's pairs away (an adjacent swap three, any other two). Where that leaves none, the swapped forms' pairs count as well.
    """
    weights: dict[str, int] = {}
    for x in pieces(term, 2):
        weights[x] = weights.get(x, 0) + 1
    least = len(term) - 1 - 3 * edits_of(term)
    if least < 1:
        for i in range(len(term) - 1):
            for x in pieces(term[:i] + term[i + 1] + term[i] + term[i + 2 :], 2):
                weights.setdefault(x, 1)
    return weights, max(1, least)


def gram_lists(batches: Iterator[pa.RecordBatch], most: int, words: int) -> Iterator[pa.RecordBatch]:
    """gram and keys from keys and their distinct words, for most texts at a time, or as many as have so many words together."""
    held, texts, size = [], 0, 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(start + most - texts, max(start + 1, int(np.searchsorted(ends, base + words - size, side="right"))))
            held.append(batch.slice(start, stop - start))
            texts, size, start = texts + stop - start, size + int(ends[stop - 1] - base), stop
            if texts >= most or size >= words or start < batch.num_rows:
                yield gram_list(held)
                held, texts, size = [], 0, 0
    if held:
        yield gram_list(held)


def distinct(parts: Iterator[np.ndarray], size: int, bound: int) -> np.ndarray:
    """Ascending distinct values, all below bound, of parts that have size values together."""
    if bound <= 8 * size:  # a mark a value takes no more room than the values
        marks = np.zeros(bound, bool)
        for values in parts:
            marks[values] = True
        return np.flatnonzero(marks)
    own = np.sort(np.concatenate([np.zeros(0, np.int64), *parts]))
    return own[np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]])]


def gram_list(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """gram and keys: each word (with = before it), and each letter, pair and triple of letters of a word (with 1, 2 or 3), with the texts that hold it."""
    table = pa.Table.from_batches(batches).combine_chunks()
    keys, lists = (table.column(i).combine_chunks() for i in range(2))
    texts = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    found = lists.flatten().dictionary_encode()
    names, numbers = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # a gram is a number: 21 bits a letter
    codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(x) for x in names], np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # letters from here to the word's end
    word = np.repeat(np.arange(len(names)), lengths)
    grams, of = [codes], [word]
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        grams.append(sum((codes[at + k] << np.uint64(21 * k) for k in range(n)), np.zeros(len(at), np.uint64)))
        of.append(word[at])
    codes = np.concatenate(grams)
    order = np.argsort(codes)
    edge = np.diff(codes[order], prepend=np.uint64(0)) > 0  # no letter is 0
    ids, which = codes[order][edge], np.empty(len(codes), np.int64)
    which[order] = np.cumsum(edge) - 1
    grams = max(1, len(ids))
    word, which = np.divmod(distinct([np.concatenate(of) * grams + which], len(which), len(names) * grams), grams)
    many = np.bincount(word, minlength=len(names))
    own, start, n = many[numbers], (np.cumsum(many) - many)[numbers], max(1, len(keys))

    def spread() -> Iterator[np.ndarray]:
        """Each text's words' grams, end to end: where a word's begin, and from there on."""
        for i in range(0, len(own), 1 << 16):
            some, to = own[i : i + (1 << 16)], np.cumsum(own[i : i + (1 << 16)])
            at = np.arange(to[-1]) + np.repeat(start[i : i + (1 << 16)] - to + some, some)
            yield which[at] * n + np.repeat(texts[i : i + (1 << 16)], some)

    both = np.concatenate([distinct([numbers * n + texts], len(numbers), len(names) * n), distinct(spread(), int(own.sum()), len(ids) * n) + len(names) * n])
    gram, text = np.divmod(both, n)
    cuts = np.searchsorted(gram, np.arange(len(names) + len(ids) + 1))
    letters = [[chr(c) for c in (x & 0x1FFFFF, x >> 21 & 0x1FFFFF, x >> 42) if c] for x in ids.tolist()]
    said = pa.array([*(f"={x}" for x in names), *(f"{len(x)}{''.join(x)}" for x in letters)], pa.string())
    return pa.RecordBatch.from_arrays([said, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), keys.take(pa.array(text)))], names=["gram", "keys"])


class GramIndex:
    """Words, pairs and triples of letters of texts with the texts that hold them, and the texts: for whole words, parts of words and typos.

    A gram's texts stand in arrays of bounded length: they are listed for BLOCK texts (or WORDS of their distinct words) at a time, so that a gram that all
    texts hold is many rows.
    """

    BLOCK, WORDS = 1 << 14, 1 << 19

    def __init__(self, grams: Store, texts: Store, key: str):
        self.grams, self.texts, self.key = grams, texts, key

    def build(self, texts: DataFrame, text: str = "text") -> GramIndex:
        """Index texts (null: empty). Keys are distinct; a text without letters or digits is found by nothing."""
        ship(self.texts.spark)
        self.texts.publish(texts.select(self.key, F.coalesce(folded(F.col(text)), F.lit("")).alias("t")))
        held = self.texts.read()
        own = held.select(self.key, F.array_distinct(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("words"))
        kind = held.schema[self.key].dataType.simpleString()
        listed = own.mapInArrow(partial(gram_lists, most=self.BLOCK, words=self.WORDS), f"gram string, keys array<{kind}>")
        self.grams.publish_by(listed.withColumn("bucket", bucket_of(F.col("gram"))), "bucket")
        return self

    def _held(self, wanted: Sequence[str]) -> DataFrame:
        """key and gram, for the wanted grams."""
        buckets = {r[0] for r in self.grams.spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket_of(F.col("t"))).collect()}
        found = self.grams.read().where(F.col("bucket").isin(*buckets) & F.col("gram").isin(*wanted))
        return found.select("gram", F.explode("keys").alias(self.key))

    def search(self, query: str, most: int | None = 100, budget: int | None = 1_000_000) -> DataFrame:
        """key, kind, edits and incomplete of texts that hold all terms of query: as words (exact), as parts of words (substring) or with typos (fuzzy).

        A term may have one typo (an adjacent swap counts as one), two from eight letters on, none below four, if the query has at most 12 terms of
        160 letters together. Texts are chosen by grams: all triples of a term for a part of a word, enough of its pairs for a typo. Only those are compared,
        the most promising first, up to budget characters together (null: all); incomplete says whether some were left out. The first most (null: all),
        exact ones first, then by edits and key.
        """
        terms = list(dict.fromkeys(query_terms(query)))
        spark = self.texts.spark
        if not terms:
            return self.texts.read().limit(0).select(self.key, F.lit("").alias("kind"), F.lit(0).alias("edits"), F.lit(False).alias("incomplete"))
        ship(spark)
        typos = len(terms) <= 12 and sum(map(len, terms)) <= 160
        every = lambda tests: reduce(lambda a, b: a & b, tests)
        asked, tests = set(), {}
        for i, t in enumerate(terms):
            n = min(3, len(t))
            whole = [f"{n}{x}" for x in dict.fromkeys(pieces(t, n))]
            weights, least = shared_pairs(t) if typos and edits_of(t) else ({}, 1)
            asked |= {f"={t}", *whole, *(f"2{x}" for x in weights)}
            tests[i] = (f"={t}", whole, {f"2{x}": w for x, w in weights.items()}, least)
        sums = {}
        for i, (word, whole, weights, _) in tests.items():
            sums[f"w{i}"] = F.max(F.when(F.col("gram") == word, 1).otherwise(0))
            sums[f"p{i}"] = F.count_if(F.col("gram").isin(*whole))
            weight = F.coalesce(*(F.when(F.col("gram") == x, F.lit(w)) for x, w in weights.items()), F.lit(0)) if weights else F.lit(0)
            sums[f"g{i}"] = F.sum(weight)
        votes = self._held(sorted(asked)).groupBy(self.key).agg(*(v.alias(k) for k, v in sums.items()))
        part = {i: F.col(f"p{i}") == len(x[1]) for i, x in tests.items()}
        near = {i: F.col(f"g{i}") >= x[3] if x[2] else F.lit(False) for i, x in tests.items()}
        chosen = votes.where(every([part[i] | near[i] for i in tests]))
        met = chosen.join(self.texts.read(), self.key)
        exact = every([F.col(f"w{i}") == 1 for i in tests])
        literal = every([part[i] & F.col("t").contains(t) for i, t in enumerate(terms)])
        marked = met.withColumns({"_exact": exact, "_literal": literal, "_votes": sum((F.col(f"g{i}") for i in tests), F.lit(0)), "_size": F.length("t")})
        plain = marked.where("_exact or _literal").select(self.key, F.when(F.col("_exact"), "exact").otherwise("substring").alias("kind"), F.lit(0).alias("edits"), F.lit(False).alias("_left"))
        found = plain
        if typos:
            rest = marked.where("not _exact and not _literal")
            if budget is not None:
                # a text that can hold a typo has at least three letters, so these many rows reach the budget
                rest = rest.orderBy(F.col("_votes").desc(), self.key).limit(budget // 3 + 2)
                rest = rest.withColumn("_used", F.sum("_size").over(W.orderBy(F.col("_votes").desc(), self.key).rowsBetween(W.unboundedPreceding, W.currentRow)))
            else:
                rest = rest.withColumn("_used", F.lit(0))
            over = F.col("_used") > (budget if budget is not None else 0)
            each = rest.select(self.key, over.alias("_left"), F.when(~over, F.col("t")).alias("t"), F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(edits_of(t)).alias("most")) for t in terms))).alias("x"))
            each = each.withColumn("_d", F.when(F.col("t").contains(F.col("x.t")), 0).otherwise(substring_distance(F.col("x.t"), F.when(~F.col("t").contains(F.col("x.t")), F.col("t")), F.col("x.most"))))
            fuzzy = each.groupBy(self.key).agg(F.count("_d").alias("_n"), F.sum("_d").cast("int").alias("edits"), F.max("_left").alias("_left"))
            found = plain.union(fuzzy.where((F.col("_n") == len(terms)) | F.col("_left")).select(self.key, F.when(F.col("_n") == len(terms), "fuzzy").alias("kind"), "edits", "_left"))
        if budget is not None:
            # a row of what is left out, beside every row that is found
            left = found.agg(F.coalesce(F.max("_left"), F.lit(False)).alias("incomplete"))
            found = found.where("kind is not null").drop("_left").join(F.broadcast(left), F.lit(True))
        else:
            found = found.where("kind is not null").select(self.key, "kind", "edits", F.lit(False).alias("incomplete"))
        return found if most is None else found.orderBy(F.when(F.col("kind") == "exact", 0).otherwise(1), "edits", self.key).limit(most)
