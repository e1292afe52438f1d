"""Stages that run a model over rows: whole batches at once, failures beside the results; pooling of token vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from palimpsest.session import ship


def encoded(rows: DataFrame, inputs: list[str], encode: Callable, name: str, kind: str, size: int = 128) -> DataFrame:
    """rows without inputs but with name, what encode gives for lists of the inputs (a value a row), and failure, why it gave none.

    A batch that fails is tried row by row, so one bad row doesn't take others along.
    """
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c not in inputs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), size):
                some = batch.iloc[i : i + size]
                values, why = tried(encode, [some[c].tolist() for c in inputs])
                yield some[kept].assign(**{name: values, "failure": why})

    schema = rows.select(*kept).schema.add(name, kind).add("failure", "string")
    return rows.select(*kept, *inputs).mapInPandas(run, schema)


def tried(encode: Callable, columns: list[list]) -> tuple[list, list]:
    """Values and failures of a batch; halves of a batch that fails are tried apart."""
    n = len(columns[0])
    if not n:
        return [], []
    try:
        return list(encode(*columns)), [None] * n
    except Exception as e:  # noqa: BLE001 (any failure of a model is a row's result)
        if n == 1:
            return [None], [str(e)]
        parts = [tried(encode, [c[a:b] for c in columns]) for a, b in ((0, n // 2), (n // 2, n))]
        return parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of the means of token states (rows, tokens, width) where mask is 1; rows without tokens are zero."""
    sums = (states * mask[:, :, None]).sum(1)
    return unit(sums / np.maximum(mask.sum(1, keepdims=True), 1e-9))


def first_pooled(states: np.ndarray) -> np.ndarray:
    """Unit vectors of the first tokens' states."""
    return unit(states[:, 0])


def sigmoid(scores: np.ndarray) -> np.ndarray:
    """Probabilities of logits, without overflow at either end."""
    small = np.exp(-np.abs(scores))
    return np.where(scores >= 0, 1, small) / (1 + small)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def best_path(scores: np.ndarray, alphabet: str, blank: int = 0) -> tuple[str, float]:
    """Text of a sequence of class scores (steps, classes): the best class of each step, repeats and blanks left out, and the mean score of what stays."""
    best = scores.argmax(1)
    new = np.concatenate([[True], best[1:] != best[:-1]]) & (best != blank)
    text = "".join(alphabet[k - (k > blank)] for k in best[new])
    return text, float(scores[np.arange(len(best)), best][new].mean()) if new.any() else 0.0


#: Words that are compared at once along a diagonal.
RUN = 32


def word_errors(truth: Sequence[str], said: Sequence[str]) -> int:
    """Least words to change, add or leave out to get from one list to the other."""
    names = {w: k for k, w in enumerate(dict.fromkeys([*truth, *said]))}
    return errors_between(*(np.array([*map(names.__getitem__, x)], np.int64) for x in (truth, said)))


def errors_between(truth: np.ndarray, said: np.ndarray) -> int:
    """word_errors of words by number, from 0; a word that truth doesn't have may have any other number, or -3.

    For one error more after the other, how far every diagonal of the distance table gets: as many rounds as there are errors, each
    over as many diagonals, whatever the length of the lists. Along a diagonal equal words cost nothing and are passed in runs.
    """
    n, m = len(truth), len(said)
    if not n or not m:
        return n + m
    # behind the ends stand names that equal nothing
    a, b = (np.concatenate([x, np.full(RUN, end)]) for x, end in ((truth, -1), (said, -2)))
    runs_a, runs_b = (np.lib.stride_tricks.as_strided(x, (len(x) - RUN + 1, RUN), x.strides * 2, writeable=False) for x in (a, b))

    def passed(at: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
        live = np.flatnonzero(a[at] == b[at + diagonals])
        while len(live):
            same = runs_a[at[live]] == runs_b[at[live] + diagonals[live]]
            whole = same.all(1)
            at[live] += np.where(whole, RUN, same.argmin(1))
            live = live[whole]
        return at

    # at: words of truth that each diagonal (words of said less words of truth, from low on) has behind it
    low, at, errors = 0, passed(np.zeros(1, np.int64), np.zeros(1, np.int64)), 0
    while not (low <= m - n < low + len(at) and at[m - n - low] == n):
        errors += 1
        wide = np.concatenate([[-2, -2], at, [-2, -2]])
        # a word changed, left out or added
        at = np.maximum(np.maximum(wide[1:-1], wide[2:]) + 1, wide[:-2])
        diagonals = np.arange(low - 1, low - 1 + len(at))
        inside = (diagonals >= -n) & (diagonals <= m)
        at, diagonals = at[inside], diagonals[inside]
        low = int(diagonals[0])
        at = passed(np.minimum(at, np.minimum(n, m - diagonals)), diagonals)
    return errors


@F.arrow_udf(LongType())
def word_error_count(truth: pa.Array, said: pa.Array) -> pa.Array:
    # words are numbered within the batch, without a Python string for any of them
    told = truth.flatten().dictionary_encode()
    own = pc.fill_null(told.indices, len(told.dictionary)).to_numpy().astype(np.int64)
    words = pa.concat_arrays([told.dictionary, pa.nulls(1, told.dictionary.type)])
    other = pc.fill_null(pc.index_in(said.flatten(), words), -3).to_numpy().astype(np.int64)
    parts = zip(*(np.split(x, np.cumsum(pc.list_value_length(y).to_numpy())[:-1]) for x, y in ((own, truth), (other, said))), strict=True)
    return pa.array([errors_between(a, b) for a, b in parts] if len(truth) else [], pa.int64())


@F.pandas_udf(LongType())
def shared_count(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words that two lists have in common, each as often as it stands in both."""
    return pd.Series([(Counter(x) & Counter(y)).total() for x, y in zip(a, b, strict=True)])


def recognition(pairs: DataFrame, group: str, control: str) -> DataFrame:
    """By group the words of truth (array), those that said (array) gets wrong, their share, and the share of truth's control tokens (a pattern) that said holds.

    Both are split before; null lists are empty. Shares are null where there is nothing to divide by.
    """
    ship(pairs.sparkSession)
    empty = F.array().cast("array<string>")
    own = pairs.select(group, F.coalesce("truth", empty).alias("truth"), F.coalesce("said", empty).alias("said"))
    marked = lambda c: F.filter(c, lambda w: w.rlike(control))
    counted = own.withColumns({"_e": word_error_count("truth", "said"), "_t": marked("truth"), "_s": marked("said")}).withColumn("_k", shared_count("_t", "_s"))
    sums = counted.groupBy(group).agg(F.sum(F.size("truth")).alias("words"), F.sum("_e").alias("errors"), F.sum(F.size("_t")).alias("controls"), F.sum("_k").alias("_kept"))
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return sums.select(group, "words", "errors", share("errors", "words").alias("wer"), "controls", share("_kept", "controls").alias("recall"))
