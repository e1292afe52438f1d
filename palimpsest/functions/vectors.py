"""Vector arithmetic: native expressions, and an Arrow form that scores a whole batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distances(vectors: DataFrame, query: list[float], vector: str = "vector", distance: str = "distance") -> DataFrame:
    """vectors with the cosine distance to query; rows with null, zero or not-a-number vectors are left out.

    A batch is scored at once, and the vector column itself stays behind in the executor. Sums are taken row by row in one order, unlike those of a matrix
    product: equal vectors have equal distances wherever they stand.
    """
    goal = np.asarray(query, np.float64)
    goal = goal / np.linalg.norm(goal)
    kept = [c for c in vectors.columns if c != vector]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            fits = pc.fill_null(pc.equal(pc.list_value_length(column), len(goal)), False)
            rows = batch.filter(fits)
            matrix = rows.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(goal))
            size = np.linalg.norm(matrix, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                away = 1 - (matrix * goal).sum(1) / size
            ok = np.isfinite(away) & (size > 0)
            out = rows.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*(out.column(c) for c in kept), pa.array(away[ok])], names=[*kept, distance])

    return vectors.select(*kept, vector).mapInArrow(score, vectors.select(*kept).schema.add(distance, "double"))
