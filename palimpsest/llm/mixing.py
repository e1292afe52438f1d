"""Mixing sources to target weights by hierarchical budgets (operator 7).

The tree has levels domain, language and source; its leaves are the combinations that occur. A budget of tokens flows
from the root down by the weights of siblings. A node can't take more than its supply (its tokens times the most epochs
it may be repeated); what it can't take is dealt again among its siblings by their weights, and only what no sibling
can take goes back to their ancestor, which deals it among that node's siblings in turn.

That is one level for each group of siblings: each takes the smaller of its supply and level * weight, and the level at which they
take what their parent has is found by a window over the siblings in the order of supply / weight. So the tree is planned in
DataFrames, whatever the number of leaves.

Each leaf then takes the first tokens of its seeded epochs: in an epoch its documents stand in the order of a
hash of seed, epoch and document, and a document is taken if the tokens of those before it don't reach the
leaf's budget. Order statistics are found by slices of the hash range: tokens are summed for each leaf and slice, so
only the one slice in which a leaf's budget ends is ever sorted. There is a slice for every ROWS_OF_SLICE rows, so it stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch_root, ship, staged

#: Bits of the number of slices of the hash range in which a leaf's prefix is found, at least and at most; rows for each slice.
LEAST_BITS, MOST_BITS = 12, 40
ROWS_OF_SLICE = 16_384
#: Leaves that travel to the documents; of more, both sides are shuffled.
FEW = 100_000
LEVELS = ("domain", "language", "source")


def key_of(names: list[str]) -> Column:
    """A path in the tree as one string; null is a key of its own."""
    return F.concat(*(F.when(F.col(n).isNull(), "n;").otherwise(F.concat(F.lit("k"), F.length(n).cast("string"), F.lit(":"), n, F.lit(";"))) for n in names))


def weight_of(names: list[str], weights: dict[tuple, float]) -> Column:
    """The weight of a node among its siblings: of the entries that fit its path the most specific one, 1 without any. None in an entry fits any key."""
    out = F.lit(None).cast("double")
    for path, w in sorted(weights.items(), key=lambda x: sum(k is None for k in x[0])):
        if len(path) == len(names):
            fits = F.lit(True)
            for name, key in zip(names, path, strict=True):
                fits = fits & F.coalesce(F.col(name) == key, F.lit(False)) if key is not None else fits
            out = F.coalesce(out, F.when(fits, F.lit(float(w))))
    return F.coalesce(out, F.lit(1.0))


def dealt(nodes: DataFrame, parent: str) -> DataFrame:
    """nodes (supply, weight, want: what their parent has, the same for all of one parent) with given, what each gets."""
    open_ = F.col("weight") * (F.col("supply") > 0).cast("double")
    ratio = F.when(open_ > 0, F.col("supply") / F.col("weight")).otherwise(0.0)
    rising = W.partitionBy(parent).orderBy("_ratio", "node")
    ranked = nodes.withColumns({"_open": open_, "_ratio": ratio})
    # with all before it full, the level at which the rest of the want is dealt to it and all behind it
    full = F.coalesce(F.sum(F.when(F.col("_open") > 0, F.col("supply")).otherwise(0.0)).over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_open").over(rising.rowsBetween(0, W.unboundedFollowing))
    level = F.when((F.col("_open") > 0) & (rest > 0), (F.col("want") - full) / rest)
    placed = ranked.withColumn("_level", level)
    # the first node that isn't full at its level sets the level of all (levels fall behind it); if there is none, all are full
    found = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(W.partitionBy(parent))
    given = F.when(F.col("_open") <= 0, 0.0).when(found.isNull(), F.col("supply")).otherwise(F.least(F.col("supply"), found * F.col("weight")))
    return placed.withColumn("given", F.greatest(F.lit(0.0), given)).drop("_open", "_ratio", "_level")


def budgets(leaves: DataFrame, want: float, weights: dict[tuple, float]) -> DataFrame:
    """leaves (domain, language, source, supply) with leaf (their path as one string) and leaf_budget."""
    paths = {k: list(LEVELS[:k]) for k in (1, 2, 3)}
    usable = F.col("supply")
    for names in paths.values():
        usable = F.when(weight_of(names, weights) > 0, usable).otherwise(0.0)
    own = leaves.withColumns({**{f"_p{k}": key_of(names) for k, names in paths.items()}, **{f"_w{k}": weight_of(names, weights) for k, names in paths.items()}, "_usable": usable})
    above = own.agg(F.coalesce(F.sum("_usable"), F.lit(0.0)).alias("_all")).select(F.lit("").alias("parent"), F.least(F.lit(float(want)), F.col("_all")).alias("want"))
    for k in paths:
        parent = F.col(f"_p{k - 1}") if k > 1 else F.lit("")
        nodes = own.groupBy(F.col(f"_p{k}").alias("node")).agg(F.sum("_usable").alias("supply"), F.first(f"_w{k}").alias("weight"), F.first(parent).alias("parent"))
        above = dealt(nodes.join(above, "parent"), "parent").select(F.col("node").alias("parent"), F.col("given").alias("want"))
    return own.join(above.select(F.col("parent").alias("_p3"), F.col("want").alias("leaf_budget")), "_p3").select(*LEVELS, "supply", F.col("_p3").alias("leaf"), "leaf_budget")


def mixture(docs: DataFrame, weights: dict[tuple, float], budget: float | None = None, tokens: Column | None = None, domain: Column | None = None, epochs: int = 2, seed: int = 17, share: float = 1.0) -> DataFrame:
    """docs with domain, tokens, copies (how often a row is taken, 0 to epochs) and leaf_budget.

    weights maps a path (domain,), (domain, language) or (domain, language, source) to its weight among siblings; None in a path
    stands for any key, and a node without an entry weighs 1. budget is the number of tokens wanted, share times all
    tokens if not given. tokens counts a row's tokens (words parted by white space if not given), domain names
    its domain (the source's name without digits if not given). Null keys are keys of their own; null and
    empty texts have no tokens and are taken once if their leaf has a budget; equal rows are told apart by nothing and are taken together; an empty table gives none. Columns
    of docs with the names of the added ones are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    root = scratch_root(spark)
    count = tokens if tokens is not None else F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0))
    name = domain if domain is not None else F.regexp_replace("source", "[0-9]+$", "")
    # docs as given stand aside in a struct, so that no name of theirs clashes
    seen = docs.withColumns({"domain": name, "tokens": count.cast("long")})
    base = [c for c in docs.columns if c not in ("domain", "tokens", "copies", "leaf_budget")]
    added = seen.select(F.struct(*base).alias("given"), "domain", "lang", "source", "tokens", "doc_id", "text")
    keys = [F.col("domain"), F.col("lang"), F.col("source")]
    epoch_hash = [F.xxhash64(F.lit(seed), F.lit(e), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))) for e in range(epochs)]
    leaves = staged(added.groupBy(*(k.alias(x) for k, x in zip(keys, LEVELS, strict=True))).agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves", root)
    sums = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("tokens"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("leaves")).first()
    few, bits = sums["leaves"] <= FEW, min(MOST_BITS, max(LEAST_BITS, (sums["rows"] // ROWS_OF_SLICE).bit_length()))
    small = F.broadcast if few else (lambda df: df)
    wanted = budget if budget is not None else share * sums.tokens
    planned = budgets(leaves.withColumns({"supply": F.col("tokens") * epochs}).drop("tokens", "rows"), wanted, weights)
    names = staged(planned.select("leaf", "leaf_budget", (F.col("supply") / epochs).alias("_tokens")), "plan", root)
    each = names.select("leaf", "leaf_budget", "_tokens", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    own = F.greatest(F.lit(0.0), F.least(F.col("leaf_budget") - F.col("epoch") * F.col("_tokens"), F.col("_tokens")))
    wants = each.withColumn("want", own).select("leaf", "epoch", "want", ((F.col("leaf_budget") > 0) & (F.col("want") >= F.col("_tokens"))).alias("whole"))
    placed = added.withColumn("leaf", key_of(["domain", "lang", "source"])).join(small(names.select("leaf", "leaf_budget")), "leaf", "left").withColumns({f"_h{e}": h for e, h in enumerate(epoch_hash)})
    narrow = staged(placed.select("leaf", "tokens", *(f"_h{e}" for e in range(epochs))), "narrow", root)
    slice_of = lambda h: F.shiftrightunsigned(h, 64 - bits)  # noqa: E731  the highest bits: slices are ranges
    # tokens of each leaf, epoch and slice; the slice in which the budget ends
    long = narrow.select("leaf", "tokens", F.posexplode(F.array(*(F.col(f"_h{e}") for e in range(epochs)))).alias("epoch", "h"))
    long = long.select("leaf", "epoch", slice_of(F.col("h")).alias("slice"), F.expr("shiftrightunsigned(h, 1)").alias("h"), "tokens")
    sums = long.groupBy("leaf", "epoch", "slice").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("leaf", "epoch").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).join(small(wants.where("want > 0 and not whole")), ["leaf", "epoch"])
    cut = ends.where("before < want and want <= before + n").select("leaf", "epoch", "slice", "before", "want")
    # within that slice: documents in the order of the hash, while those before leave tokens to take
    inner = long.join(small(cut), ["leaf", "epoch", "slice"]).groupBy("leaf", "epoch", "slice", "h", "before", "want").agg(F.sum("tokens").alias("n"))
    ahead = F.col("before") + F.coalesce(F.sum("n").over(W.partitionBy("leaf", "epoch", "slice").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = inner.withColumn("ahead", ahead).where("ahead < want").groupBy("leaf", "epoch").agg(F.max("h").alias("last"))
    limits = wants.join(last, ["leaf", "epoch"], "left").select("leaf", "epoch", F.when(F.col("whole"), F.lit(2**63 - 1)).otherwise(F.coalesce("last", F.lit(-1))).alias("last"))
    packed = limits.groupBy("leaf").pivot("epoch", list(range(epochs))).agg(F.first("last"))
    joined = placed.join(small(packed), "leaf", "left")
    copies = F.lit(0)
    for e in range(epochs):
        copies = copies + F.coalesce(F.expr(f"shiftrightunsigned(_h{e}, 1)") <= F.col(f"`{e}`"), F.lit(False)).cast("int")
    return joined.select(*(F.col("given")[c].alias(c) for c in base), "domain", "tokens", copies.alias("copies"), F.round("leaf_budget", 6).alias("leaf_budget"))
