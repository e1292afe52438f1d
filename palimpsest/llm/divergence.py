"""How the sources of a language differ from it and from one another (operator 11).

1. Shards of documents count terms by (language, source), and the documents that hold them. A term's counts by source are its postings. Postings travel
   as serialised sorted runs by ranges of terms; a range sums them, keeps the terms of enough documents and writes them.
2. Terms that set a group apart are found by upper bounds: a group's terms fall into buckets of equal count and similar count in the language. All terms of a
   bucket have one probability in the group, and the smallest probability in the language bounds their value. Buckets are evaluated best bound first until they
   hold enough terms; the value of the k-th then decides which other buckets are evaluated: those whose bound isn't strictly below it. No other
   term can be among the first k.
3. Pairs of sources are summed from postings: terms that both hold from the postings of each term, terms that one of them holds from its counts
   alone (as many sums as it has different counts), terms that neither holds from their number.

All arithmetic is in integers: probabilities in units of 1e-9 through decimals of 38 digits, values in 64 bits (a value is at most 1e18).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from palimpsest.llm.common import packed, raw, scratch_root, shards_for, ship, slices, staged, text_bytes, trimmed, unpacked
from palimpsest.llm.words import bounds, lowered, mix, span_hashes

#: Documents of a language that a kept term is in, ranks of the part term, what probabilities are multiplied by.
LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Bytes of text of a shard, bytes of text for each range of terms and most ranges, postings that a merge holds before it sums them.
SHARD_BYTES = 32 << 20
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 15
HELD = 1 << 21
#: Pairs of postings that are compared at once, sums of pairs of sources that a task holds.
AT_ONCE, SUMS = 1 << 20, 1 << 20

#: Terms are runs of [^\x00-\x40\x5B-\x60\x7B-\x7F].
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

POSTING = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of data as strings."""
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    places = np.arange(at[-1]) + np.repeat(starts - at[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[places]))])


def counted(batch: pa.RecordBatch, groups: dict[tuple[str, str], int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of some documents with their hashes, and of each (term, group): its key group << 32 | term, occurrences, documents."""
    data, offsets = raw(batch.column("text"))
    low = lowered(data)
    starts, ends, first = bounds(low, offsets, NOT_LETTERS)
    hashes, at, term = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    own = [groups.setdefault(x, len(groups)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)]
    doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
    in_doc, n = np.unique(doc << 32 | term, return_counts=True)
    keys, at_key = np.unique(np.array(own, np.int64)[in_doc >> 32] << 32 | in_doc & 0xFFFFFFFF, return_inverse=True)
    occurrences = np.zeros(len(keys), np.int64)
    np.add.at(occurrences, at_key, n)
    return gathered(low, starts[at], ends[at]), hashes, keys, occurrences, np.bincount(at_key, minlength=len(keys))


def runs_of(parts_of: list[tuple], groups: dict[tuple[str, str], int], parts: int) -> Iterator[pa.RecordBatch]:
    """A shard's postings as one serialised run a range, sorted by term and group."""
    texts = pa.chunked_array([x[0] for x in parts_of]).combine_chunks().dictionary_encode()
    code = texts.indices.to_numpy()
    before = np.cumsum([0, *(len(x[0]) for x in parts_of)])
    hashes = np.zeros(len(texts.dictionary), np.uint64)
    hashes[code] = np.concatenate([x[1] for x in parts_of])
    keys = np.concatenate([x[2] >> 32 | code[(x[2] & 0xFFFFFFFF) + b].astype(np.int64) << 32 for x, b in zip(parts_of, before[:-1], strict=True)])
    keys, at = np.unique(keys, return_inverse=True)
    sums = np.zeros((2, len(keys)), np.int64)
    for k in (0, 1):
        np.add.at(sums[k], at, np.concatenate([x[3 + k] for x in parts_of]))
    part = (mix(hashes) % np.uint64(parts)).astype(np.int64)[keys >> 32]
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    langs, sources = (pa.array([x[k] for x in groups], pa.string()) for k in (0, 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[k] : cuts[k + 1]]
        group, term = pa.array(keys[own] & 0xFFFFFFFF), pa.array(keys[own] >> 32)
        run = pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), texts.dictionary.take(term).cast(pa.string()), pa.array(sums[0][own]), pa.array(sums[1][own])], schema=POSTING)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(run)], pa.binary())], names=["part", "data"])


def summed(held: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(POSTING.names)


def postings(docs: DataFrame, least_docs: int, root: str) -> DataFrame:
    """lang, source, term, n (occurrences there), in_lang (in the language), term_id and first (true for one posting of each term) of all kept terms. Staged."""
    parts = min(MOST_RANGES, shards_for(text_bytes(docs)[1], RANGE_BYTES, 8))

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, groups, size = [], {}, 0
        for batch in slices(batches, 1 << 20):
            found = counted(batch, groups)
            if len(found[2]):
                held.append(found)
            size += len(raw(batch.column("text"))[0])
            if size >= SHARD_BYTES and held:
                yield from runs_of(held, groups, parts)
                held, groups, size = [], {}, 0
        if held:
            yield from runs_of(held, groups, parts)

    def out(held: list[pa.Table], part: int) -> pa.RecordBatch:
        table = summed(held)
        lang, term = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "term"))
        _, own = np.unique(lang.indices.to_numpy().astype(np.int64) << 32 | term.indices.to_numpy(), return_inverse=True)
        sums = []
        for c in ("docs", "n"):
            total = np.zeros(own.max() + 1, np.int64)
            np.add.at(total, own, table[c].to_numpy())
            sums.append(total[own])
        first = np.zeros(len(own), bool)
        first[np.unique(own, return_index=True)[1]] = True
        keep = np.flatnonzero(sums[0] >= least_docs)
        keep = keep[np.argsort(own[keep], kind="stable")]
        table = table.take(pa.array(keep)).combine_chunks()
        columns = [*(table[c].combine_chunks() for c in ("lang", "source", "term", "n")), pa.array(sums[1][keep]), pa.array(own[keep] + (part << 40)), pa.array(first[keep])]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "in_lang", "term_id", "first"])

    @trimmed
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, part = 0, None
        for batch in batches:
            for own, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if held and own != part:
                    yield out(held, part)
                    held, size = [], 0
                part = own
                held.append(unpacked(data.as_buffer()))
                size += held[-1].num_rows
                if size > 2 * HELD:
                    held = [summed(held)]
                    size = max(0, held[0].num_rows - HELD)  # what is distinct stays
        if held:
            yield out(held, part)

    runs = docs.mapInArrow(scan, "part int, data binary").repartition(parts, "part").sortWithinPartitions("part")
    return staged(runs.mapInArrow(merge, "lang string, source string, term string, n long, in_lang long, term_id long, first boolean"), "postings", root)


def probability(n: Column | str, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms))."""
    n = F.col(n) if isinstance(n, str) else n
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), (total + terms).cast("decimal(20,0)"))


def value(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, found: DataFrame, root: str) -> DataFrame:
    """group, lang, source, v (kept terms of the language), held (those that the group holds), p0 and q0 (probability of a term that it, or the language, doesn't hold), total and lang_total of each occurring (lang, source). Staged."""
    langs = found.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    whole = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "v", "lang_total"])
    whole = whole.withColumn("p0", F.when(F.col("v") > 0, probability(F.lit(0), F.col("total"), F.col("v"))))
    return staged(whole.withColumn("group", F.monotonically_increasing_id()), "groups", root)


def apart(found: DataFrame, groups: DataFrame, top: int, root: str) -> DataFrame:
    """The part term: lang, source, item, value, rank."""
    of_group = groups.select("lang", "source", "total", "v", "lang_total")
    width = F.length(F.bin("in_lang"))
    buckets = found.groupBy("lang", "source", "n", width.alias("width")).agg(F.count(F.lit(1)).alias("terms"), F.min("in_lang").alias("least"), F.max("in_lang").alias("most"))
    buckets = buckets.join(of_group, ["lang", "source"])
    p, q = probability("n", F.col("total"), F.col("v")), probability("least", F.col("lang_total"), F.col("v"))
    surely = probability("most", F.col("lang_total"), F.col("v"))
    # below p, a value only falls as q grows: that of the least q bounds the bucket. sure: terms that certainly have p > q
    buckets = buckets.withColumn("p", p).withColumn("q", q).where("p > q").withColumn("bound", value(F.col("p"), F.col("q"))).withColumn("sure", F.when(F.col("p") > surely, F.col("terms")).otherwise(0))
    best = W.Window.partitionBy("lang", "source").orderBy(F.col("bound").desc()).rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    buckets = staged(buckets.withColumn("upto", F.sum("sure").over(best)), "buckets", root)
    # the bound down to which the best buckets surely hold top terms; all of them, if they hold fewer
    reach = buckets.groupBy("lang", "source").agg(F.max(F.when(F.col("upto") >= top, F.col("bound"))).alias("reach"))
    keys = ["lang", "source", "n", "width"]

    def evaluated(some: DataFrame) -> DataFrame:
        terms = found.withColumn("width", width).join(some.select(*keys, "p", "v", "lang_total"), keys)
        terms = terms.withColumn("q", probability("in_lang", F.col("lang_total"), F.col("v"))).where("p > q")
        return terms.select("lang", "source", F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))

    order = W.Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    first = lambda x: x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    met = buckets.join(reach, ["lang", "source"])
    one = staged(first(evaluated(met.where("reach is null or bound >= reach"))), "term1", root)
    kth = one.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
    # what was not evaluated, but for what is strictly below the k-th value
    two = evaluated(met.where("reach is not null and bound < reach").join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth"))
    return first(one.drop("rank").union(two))


def paired(found: DataFrame, groups: DataFrame, parts: int, root: str) -> DataFrame:
    """The part pair: lang, source, item, value, rank."""
    own = groups.select("lang", "source", "group", "total", "v", "p0")
    known = found.select("lang", "source", "term_id", "n").join(own, ["lang", "source"]).select("lang", "term_id", "group", "p0", "n", "total", "v")
    known = known.withColumn("p", probability("n", F.col("total"), F.col("v")))

    @trimmed
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What terms that two groups hold add to the sums over the terms that each holds."""
        sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def total() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, x = (np.concatenate(y) for y in zip(*sums, strict=True))
            order = np.lexsort((b, a))
            a, b, x = a[order], b[order], x[order]
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            return a[at], b[at], np.add.reduceat(x, at)

        def add(term: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            size = np.diff(np.append(starts, len(term)))
            mine, base = np.repeat(size, size), np.repeat(starts, size)
            ends = np.cumsum(mine)
            i = 0
            while i < len(term):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, side="right")))
                x = np.repeat(np.arange(i, j), mine[i:j])
                y = np.arange(len(x)) - np.repeat(ends[i:j] - mine[i:j] - (ends[i - 1] if i else 0), mine[i:j]) + base[x]
                x, y = x[x != y], y[x != y]
                i = j
                if not len(x):
                    continue
                f = lambda u, w: (u - w) ** 2 // w
                more = f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y])
                sums.append((group[x], group[y], more))
                if sum(len(s[0]) for s in sums) > 4 * SUMS:
                    sums[:] = [total()]

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("term_id").to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))
            if last:  # a term that may go on in the next batch waits
                whole = pa.Table.from_batches([*rest, batch.slice(0, last)])
                add(*(whole[c].to_numpy() for c in ("term_id", "group", "p", "p0")))
                rest = []
                if sums and len(sums[0][0]) > SUMS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in total()], names=["group", "other", "more"])
                    sums.clear()
            rest.append(batch.slice(last))
        if rest:
            whole = pa.Table.from_batches(rest)
            add(*(whole[c].to_numpy() for c in ("term_id", "group", "p", "p0")))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total()], names=["group", "other", "more"])

    dealt = known.select("term_id", "group", "p", "p0").repartition(parts, "term_id").sortWithinPartitions("term_id")
    shared = dealt.mapInArrow(both, "group long, other long, more long").groupBy("group", "other").agg(F.sum("more").alias("more"))
    # of the terms that one group holds: as many sums as it has different counts, with every other group of its language
    counts = known.groupBy("lang", "group", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    others = groups.select("lang", F.col("group").alias("other"), F.col("p0").alias("q0"))
    met = counts.join(others, "lang").where(F.col("group") != F.col("other"))
    mine = met.groupBy("group", "other").agg(F.sum(F.col("terms") * value(F.col("p"), F.col("q0"))).alias("mine"), F.sum(F.col("terms") * value(F.col("q0"), F.col("p"))).alias("theirs"))
    mine = staged(mine, "sums", root)
    right = groups.select("lang", F.col("source").alias("item"), F.col("group").alias("other"), F.col("held").alias("other_held"), F.col("p0").alias("q0"))
    pairs = groups.join(right, "lang").where(F.col("group") != F.col("other"))
    pairs = pairs.join(shared, ["group", "other"], "left").join(mine.select("group", "other", "mine"), ["group", "other"], "left")
    pairs = pairs.join(mine.select(F.col("group").alias("other"), F.col("other").alias("group"), "theirs"), ["group", "other"], "left")
    neither = F.coalesce((F.col("v") - F.col("held") - F.col("other_held")) * value(F.col("p0"), F.col("q0")), F.lit(0))
    whole = sum((F.coalesce(x, F.lit(0)) for x in ("more", "mine", "theirs")), neither)
    order = W.Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.select("lang", "source", "item", whole.alias("value")).withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of each group of docs, as the contract of operator 11 has it.

    docs: text, lang, source, of which null is read as empty; other columns are ignored. Repeated rows count as often as they stand. A group
    without terms still has its pairs (0 if its language keeps no term), an empty table gives no rows. Equal values go by the bytes of the item.
    """
    spark = docs.sparkSession
    ship(spark)
    root = scratch_root(spark)
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = postings(given, least_docs, root)
    groups = groups_of(given, found, root)
    parts = min(MOST_RANGES, shards_for(text_bytes(given)[1], RANGE_BYTES, 8))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(paired(found, groups, parts, root), "pair").union(named(apart(found, groups, top, root), "term"))
