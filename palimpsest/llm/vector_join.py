"""Near-duplicate vectors by a join in epsilon grid order (operator 13).

1. Equal vectors are one class, whatever their number. Unit vectors of cosine s or more lie no further apart than eps = sqrt(2 - 2 s).
2. A rotation brings the principal directions to the front. It only decides the order and how early a pair is refused, never a link, so it is
   fitted on a bounded sample (SAMPLE vectors at most).
3. Vectors are sorted by the cells of a grid of width eps over the leading directions: epsilon grid order. Stretches of equal length of the sorted
   sequence are tiles. Every tile keeps the bounds of its rotated coordinates.
4. The sequence is joined with itself from intervals of all tiles down to single ones: a pair of intervals is replaced by the pairs of their parts unless
   their bounds are further apart than eps. Two tiles that are left meet in one task, which goes on halving them in the same way.
5. Where no bound helps, the leading coordinates and the length of the rest bound each cosine from above (Cauchy and Schwarz); what passes is
   confirmed in double precision on the vectors as they were given.
6. A pair of tiles yields counts of links and one edge a vector to its group within the pair, never the pairs themselves: a group of near copies of any size stays linear there.

Vectors without any structure leave no pair of tiles provably distant, so that the work grows with the square of their number; steps 1 and 5 make that cheaper, not smaller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import raw_bytes, scratch_root, shards_for, ship, staged, trimmed
from palimpsest.llm.components import components

#: Vectors that the rotation is fitted on, leading directions that bound a cosine, those of the grid.
SAMPLE = 16_384
LEADING, GRID = 16, 8
#: Bytes of a tile, vectors of the smallest interval, parts of an interval of tiles.
TILE_BYTES = 4 << 20
LEAF = 512
FAN = 8
#: What rounding in single precision may take from a bound.
SLACK = 1e-4


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest part first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def bounded(unit: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Leading rotated coordinates of unit vectors, and the length of the rest: distances between these are at most the true ones, products at least."""
    head = unit @ rotation.T
    return np.concatenate([head, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", head, head)))[:, None]], axis=1)


def fitted(nodes: DataFrame, total: int) -> np.ndarray:
    """The leading principal directions of a sample of about SAMPLE vectors, picked by a hash of their values; one small task makes them."""

    def principal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares, n = 0.0, 0.0, 0
        for batch in batches:
            unit = units(matrix(batch.column(0)))
            sums, squares, n = sums + unit.sum(axis=0), squares + unit.T @ unit, n + len(unit)
        if n:
            _, directions = np.linalg.eigh(squares / n - np.outer(sums / n, sums / n))
            yield pa.RecordBatch.from_pydict({"r": pa.array([np.ascontiguousarray(directions.T[::-1][:LEADING]).tobytes()], pa.binary())})

    share = -(-total // SAMPLE)
    found = nodes.where(F.pmod(F.xxhash64("vector"), F.lit(share)) == 0).select("vector").repartition(1).mapInArrow(principal, "r binary").first()
    # a table so small or odd that no vector is drawn is sorted by the first coordinates as they are
    return np.frombuffer(found.r, np.float64) if found else np.zeros(0)


def ordered(nodes: DataFrame, rotation: np.ndarray, eps: float, parts: int, root: str, name: str) -> DataFrame:
    """Unit vectors (node, copies, unit) with place, their number in epsilon grid order."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = units(matrix(batch.column("vector")))
                head = unit @ rotation[:GRID].T
                cells = np.floor(head / eps).astype(np.int32)
                at = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * cells.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.ListArray.from_arrays(at, pa.array(cells.ravel())), pa.array(head[:, 0]), pa.array([x.tobytes() for x in unit], pa.binary())], names=["node", "copies", "cell", "first", "unit"])

    turned = nodes.mapInArrow(turn, "node long, copies long, cell array<int>, first double, unit binary")
    ranged = turned.repartitionByRange(parts, "cell", "first", "node").sortWithinPartitions("cell", "first", "node")
    ranged = staged(ranged.select("node", "copies", "unit", F.monotonically_increasing_id().alias("at")), f"{name}_ordered", root)
    sizes = ranged.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()  # one small row a partition
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["range"]):
        starts.append((r["range"], before))
        before += r.n
    offsets = ranged.sparkSession.createDataFrame(starts, "range long, before long")
    return ranged.withColumn("range", F.shiftright("at", 33)).join(offsets, "range").select("node", "copies", "unit", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def tiled(vectors: DataFrame, rotation: np.ndarray, rows: int, tiles: int, root: str, name: str) -> DataFrame:
    """One row a tile: its number, the bounds of its rotated coordinates, and its vectors, nodes and copies in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tile = None

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("place").combine_chunks()
            data = raw_bytes(table["unit"].chunk(0))
            own = bounded(data.view(np.float64).reshape(table.num_rows, -1), rotation)
            low, high = own.min(axis=0), own.max(axis=0)
            packed = [np.ascontiguousarray(x).tobytes() for x in (data, table["node"].to_numpy(), table["copies"].to_numpy())]
            return pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([high.tolist()], pa.list_(pa.float64())), *(pa.array([x], pa.binary()) for x in packed)], names=["tile", "low", "high", "units", "nodes", "copies"])

        for batch in batches:
            own = batch.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and own[a] != tile:
                    yield done()
                    held = []
                tile = int(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    dealt = vectors.withColumn("tile", F.floor(F.col("place") / rows)).repartition(tiles, "tile").sortWithinPartitions("tile")
    return staged(dealt.mapInArrow(cut, "tile long, low array<double>, high array<double>, units binary, nodes binary, copies binary"), f"{name}_tiles", root)


def near_tiles(tiles: DataFrame, n: int, eps: float) -> DataFrame:
    """Pairs (a <= b) of tiles that aren't provably distant, from the whole sequence downwards. Every step joins parts with the intervals they are part of."""
    g = LEADING + 1
    flat = tiles.select("tile", *(F.col("low")[i].alias(f"l{i}") for i in range(g)), *(F.col("high")[i].alias(f"h{i}") for i in range(g)))
    depth = max(1, math.ceil(math.log(max(2, n), FAN)))

    def level(k: int, side: str) -> DataFrame:
        grouped = flat.groupBy(F.floor(F.col("tile") / FAN**k).alias("own")).agg(*(F.min(f"l{i}").alias(f"l{i}") for i in range(g)), *(F.max(f"h{i}").alias(f"h{i}") for i in range(g)))
        return grouped.select(F.floor(F.col("own") / FAN).alias(f"up_{side}"), F.col("own").alias(f"own_{side}"), *(F.col(f"{x}{i}").alias(f"{x}{i}_{side}") for x in "lh" for i in range(g)))

    zero = F.lit(0.0)
    apart = sum((F.pow(F.coalesce(F.greatest(F.col(f"l{i}_a") - F.col(f"h{i}_b"), F.col(f"l{i}_b") - F.col(f"h{i}_a"), zero), zero), 2) for i in range(g)), zero)
    pairs = tiles.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for k in range(depth - 1, -1, -1):
        met = pairs.join(level(k, "a"), F.col("a") == F.col("up_a")).join(level(k, "b"), F.col("b") == F.col("up_b"))
        pairs = met.where((F.col("own_a") <= F.col("own_b")) & (apart <= eps * eps + SLACK)).select(F.col("own_a").alias("a"), F.col("own_b").alias("b"))
    return pairs


class Tile:
    """A tile's vectors with the bounds of its smallest intervals."""

    def __init__(self, record: dict, rotation: np.ndarray):
        self.nodes, self.copies = np.frombuffer(record["nodes"], "<i8"), np.frombuffer(record["copies"], "<i8")
        self.units = np.frombuffer(record["units"], np.float64).reshape(len(self.nodes), -1)
        own = bounded(self.units, rotation)
        self.head = own.astype(np.float32)
        at = np.arange(0, len(own), LEAF)
        self.low, self.high = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)

    def far(self, i: int, j: int, other: Tile, k: int, m: int, eps: float) -> bool:
        """Whether no vector of leaves i to j is within eps of one of the other's leaves k to m."""
        gap = np.maximum(0, np.maximum(self.low[i:j].min(axis=0) - other.high[k:m].max(axis=0), other.low[k:m].min(axis=0) - self.high[i:j].max(axis=0)))
        return float(gap @ gap) > eps * eps + SLACK


def near_leaves(a: Tile, b: Tile, same: bool, eps: float) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that aren't provably distant, by halving the longer of two intervals."""
    open_ = [(0, len(a.low), 0, len(b.low))]
    while open_:
        i, j, k, m = open_.pop()
        if (same and i >= m) or a.far(i, j, b, k, m, eps):
            continue
        if j - i == 1 and m - k == 1:
            if not same or i <= k:
                yield i, k
        elif j - i >= m - k:
            half = (i + j) // 2
            open_ += [(i, half, k, m), (half, j, k, m)]
        else:
            half = (k + m) // 2
            open_ += [(i, j, k, half), (i, j, half, m)]


def links_of(a: Tile, b: Tile, i: int, k: int, diagonal: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a's leaf i and b's leaf k (second after first on the diagonal) of vectors whose cosine is at least least."""
    x, y = slice(i * LEAF, (i + 1) * LEAF), slice(k * LEAF, (k + 1) * LEAF)
    maybe = a.head[x] @ b.head[y].T >= np.float32(least - SLACK)
    if diagonal:
        maybe = np.triu(maybe, 1)
    one, two = np.nonzero(maybe)
    if len(one) * 8 > maybe.size:
        cosines = (a.units[x] @ b.units[y].T)[one, two]
    else:
        cosines = np.concatenate([np.einsum("ij,ij->i", a.units[x][one[s : s + 8192]], b.units[y][two[s : s + 8192]]) for s in range(0, len(one), 8192)] or [np.zeros(0)])
    sure = cosines >= least
    return one[sure] + i * LEAF, two[sure] + k * LEAF


def merged(labels: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """labels (each a place whose label is itself, the smallest of its group), after the links between one and two."""
    x, y = labels[one], labels[two]
    new = x != y
    if not new.any():
        return labels
    x, y = x[new], y[new]
    parent = np.arange(len(labels))
    while True:
        least = np.minimum(parent[x], parent[y])
        before = parent.copy()
        np.minimum.at(parent, x, least)
        np.minimum.at(parent, y, least)
        np.minimum.at(parent, before[x], least)
        np.minimum.at(parent, before[y], least)
        parent = parent[parent]
        if (parent == before).all():
            return parent[labels]


def join_tiles(a: Tile, b: Tile, same: bool, eps: float, least: float) -> pa.RecordBatch | None:
    """Of each vector that has links in this pair of tiles: node, the copies it is linked to there, and the first node of its group there."""
    counts = [np.zeros(len(a.nodes), np.int64), np.zeros(len(b.nodes), np.int64)]
    shift = 0 if same else len(a.nodes)
    labels = np.arange(len(a.nodes) if same else len(a.nodes) + len(b.nodes))
    for i, k in near_leaves(a, b, same, eps):
        one, two = links_of(a, b, i, k, same and i == k, least)
        if len(one):
            np.add.at(counts[0], one, b.copies[two])
            np.add.at(counts[0 if same else 1], two, a.copies[one])
            labels = merged(labels, one, two + shift)
    total = counts[0] if same else np.concatenate(counts)
    at = np.flatnonzero(total)
    if not len(at):
        return None
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    return pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(total[at]), pa.array(nodes[labels[at]])], names=["node", "links", "head"])


def joined(nodes: DataFrame, total: int, length: int, least: float, root: str, name: str) -> DataFrame:
    """node, links (copies of other classes that it is linked to) and head (a node of its group) for each pair of tiles in which a class of vectors of one length has links."""
    spark = nodes.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    rotation = fitted(nodes, total)
    rotation = rotation.reshape(-1, length) if len(rotation) else np.eye(min(LEADING, length), length)
    if len(rotation) < LEADING:  # short vectors: the rest is nothing
        rotation = np.concatenate([rotation, np.zeros((LEADING - len(rotation), length))])
    size = total * length * 8
    rows = max(LEAF, TILE_BYTES // (8 * length))
    n = shards_for(total, rows)
    vectors = ordered(nodes, rotation, eps, shards_for(size, 4 * TILE_BYTES, 8), root, name)
    tiles = tiled(vectors, rotation, rows, n, root, name)
    pairs = staged(near_tiles(tiles, n, eps), f"{name}_pairs", root)
    many = pairs.count()
    sides = pairs.select("a", "b", F.col("a").alias("tile")).union(pairs.where("a <> b").select("a", "b", F.col("b").alias("tile")))
    met = sides.join(tiles.select("tile", "units", "nodes", "copies"), "tile").repartition(max(1, many), "a", "b").sortWithinPartitions("a", "b", "tile")

    @trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            for k in range(batch.num_rows):
                record = {c: batch.column(c)[k].as_buffer() for c in ("units", "nodes", "copies")} | {c: batch.column(c)[k].as_py() for c in ("a", "b", "tile")}
                own = Tile(record, rotation)
                if record["a"] == record["b"]:
                    out = join_tiles(own, own, True, eps, least)
                elif record["tile"] == record["a"]:
                    first, out = own, None
                else:
                    out = join_tiles(first, own, False, eps, least)
                if out is not None:
                    yield out

    return staged(met.mapInArrow(meet, "node long, links long, head long"), f"{name}_links", root)


def near_vectors(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable over links) and kept of each row of rows (vec_id, embedding).

    Two rows are linked if the cosine of their vectors, in double precision, is at least least (above 0). A vector that is null, empty or zero, or
    holds a null or an infinite or undefined part, links with nothing and is its own component; so are vectors of different lengths to one
    another. Equal vectors are linked, whatever their number. Rows that share a vec_id are rows of their own; kept is vec_id = component_id for
    each of them. A row without a vec_id gets the component of those it reaches, null if none has one, and isn't kept. An empty table gives
    no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    root = scratch_root(spark)
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    keyed = given.withColumn("fine", fine).withColumns({"hi": F.when(F.col("fine"), F.xxhash64("vector")), "lo": F.when(F.col("fine"), F.xxhash64(F.lit(1), "vector"))})
    # a class of equal vectors, told by 128 bits
    classes = keyed.where("fine").groupBy("hi", "lo").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "nodes", root)
    found = None
    for k, r in enumerate(nodes.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()):
        part = joined(nodes.where(F.size("vector") == r.length), r.n, r.length, least, root, f"length{k}")
        found = part if found is None else found.union(part)
    if found is None:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = staged(components(found.select(F.col("node").alias("a"), F.col("head").alias("b"))), "components", root)
    known = nodes.select("hi", "lo", "node", "id", "copies")
    least_id = groups.join(known.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    named = groups.join(least_id, "component").select("node", "component_id")
    whole = known.join(counts, "node", "left").join(named, "node", "left")
    whole = staged(whole.select("hi", "lo", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "named", root)
    out = keyed.select("vec_id", "hi", "lo").join(whole, ["hi", "lo"], "left")
    # a row that links with nothing has no hash
    alone = F.col("hi").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
