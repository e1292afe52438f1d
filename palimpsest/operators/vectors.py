"""Approximate nearest vectors: cells of a quantiser, probed cells, what is not yet in a cell, and when to rebuild."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.vectors import dot, norm
from palimpsest.operators import retrieval as R
from palimpsest.operators.store import Store

#: Fewer rows than this, or twice the results asked for, are scanned exactly. So is a share of all rows up to SMALL_SHARE: probed cells hold few of them,
#: and their exact distances are fewer than those of the cells' rows.
LEAST_ROWS, SMALL_SHARE = 1024, 0.2
PARTITIONS, PROBES, TRAIN_ROWS = 64, 32, 200_000


def usable(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector has a length: not null, not zero, every number finite."""
    fine = F.forall(vector, lambda x: ~F.isnan(x) & x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & fine & (norm(F.col(vector)) > 0))


def trained(vectors: DataFrame, partitions: int = PARTITIONS, train_rows: int = TRAIN_ROWS, seed: int = 7) -> np.ndarray:
    """Centres of cells by k-means over directions, fitted on up to about train_rows rows (drawn by a hash of id): min(partitions, rows / 32), one at least."""
    rows = usable(vectors)
    n = rows.count()
    cells = max(1, min(partitions, n // 32))
    share = min(1.0, train_rows / max(1, n))
    some = rows.where(F.xxhash64("id") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))) if share < 1 else rows
    features = some.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(features).clusterCenters()) if n else np.zeros((0, 0))


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with cell, the centre nearest by direction; null for rows without a direction."""
    if not len(centres):
        return vectors.withColumn("cell", F.lit(None).cast("int"))
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    scores = F.array(*(F.struct(dot(F.col("vector"), F.array(*map(F.lit, c.tolist()))).alias("s"), F.lit(-k).alias("k")) for k, c in enumerate(unit)))
    length = norm(F.col("vector"))
    return vectors.withColumn("cell", F.when((length > 0) & ~F.isnan(length), (-F.array_max(scores)["k"]).cast("int")))


def built(store: Store, vectors: DataFrame, partitions: int = PARTITIONS) -> np.ndarray:
    """Train cells and publish all rows as a table in folders by cell; returns the centres."""
    centres = trained(vectors, partitions)
    rows = placed(vectors, centres)
    store.publish_by(rows, "cell")
    return centres


def probed(centres: np.ndarray, goal: list[float], probes: int = PROBES) -> list[int]:
    """The cells whose centres are nearest to goal."""
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    return np.argsort(-(unit @ np.asarray(goal)), kind="stable")[:probes].tolist()


def nearest(index: DataFrame, centres: np.ndarray, goal: list[float], k: int, eligible: DataFrame | None = None, probes: int = PROBES) -> DataFrame:
    """The k nearest rows of the probed cells and of those without one (the tail), by their exact distance; only these folders are read.

    eligible: ids that may be found; the filter holds before ranking.
    """
    rows = index.where(F.col("cell").isin(probed(centres, goal, probes)) | F.col("cell").isNull()).select("id", "vector")
    if eligible is not None:
        rows = rows.join(eligible.select("id"), "id", "left_semi")
    return R.nearest(rows, goal, k)


def search(index: DataFrame, centres: np.ndarray | None, goal: list[float], k: int, eligible: DataFrame | None = None, strategy: str = "ann", probes: int = PROBES) -> tuple[DataFrame, str, list[str]]:
    """The result with the strategy that took effect and why, if it isn't the one asked for."""
    reasons = []
    if strategy == "ann":
        least = max(LEAST_ROWS, 2 * k)
        if centres is None or not len(centres):
            reasons.append("no_index")
        elif len(centres[0]) != len(goal):
            reasons.append("incompatible")
        elif small(index, eligible, least):
            reasons.append("small_scope")
    if strategy == "ann" and not reasons:
        return nearest(index, centres, goal, k, eligible, probes), "ann", reasons
    rows = index.select("id", "vector") if eligible is None else index.select("id", "vector").join(eligible.select("id"), "id", "left_semi")
    return R.nearest(rows, goal, k), "exact", reasons


def small(index: DataFrame, eligible: DataFrame | None, least: int) -> bool:
    """Whether the rows that may be found are fewer than least, or no more than SMALL_SHARE of all."""
    scope = index if eligible is None else index.select("id").join(eligible.select("id"), "id", "left_semi")
    if scope.limit(least).count() < least:
        return True
    return eligible is not None and scope.count() <= SMALL_SHARE * index.count()


def stale(index: DataFrame, partitions: int, wanted: int = PARTITIONS) -> DataFrame:
    """Rows, tail (those without a cell) and whether to build anew: another number of cells would be right, or the tail reaches a tenth and LEAST_ROWS."""
    counts = index.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cell").isNull()).alias("tail"))
    right = F.greatest(F.lit(1), F.least(F.lit(wanted), F.floor(F.col("n") / 32)))
    return counts.withColumn("rebuild", (right != partitions) | (F.col("tail") >= F.greatest(F.lit(float(LEAST_ROWS)), 0.1 * F.col("n"))))


def recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the expected ids that were found, null if none is expected."""
    both = expected.select("id").distinct().join(found.select("id", F.lit(1).alias("_hit")).distinct(), "id", "left")
    return both.agg((F.count("_hit") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("recall"))
