"""Temperature scaling of scored answers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.functions import arrays as A

LOW, HIGH = 0.25, 5.0
POINTS, ROUNDS = 21, 6


def rescaled(scored: DataFrame, temperature: float) -> DataFrame:
    return scored.withColumn("probs", A.rescale(F.col("probs"), temperature))


def _losses(temperatures: list[float]):
    """For each temperature the sum of the soft-target losses of a task's rows, and how many have one. A null or missing
    probability counts as EPS; a row without probabilities or target, with a null in the target or with less target than probabilities
    has none."""
    t, floor = np.array(temperatures)[:, None], math.log(A.EPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, seen = np.zeros(len(temperatures)), 0, False
        for batch in batches:
            probs, target = batch.column("probs"), batch.column("target")
            size, other = (pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (probs, target))
            seen, held = seen or len(size) > 0, (size == other) & (size >= 0)
            if target.flatten().null_count:
                held[pc.list_parent_indices(target).filter(target.flatten().is_null()).to_numpy(zero_copy_only=False)] = False
            for i in np.flatnonzero((size >= 0) & (size < other)).tolist():  # rows that lack probabilities
                p, q = probs[i].as_py(), target[i].as_py()
                if None not in q:
                    z = np.log(np.maximum([x or 0.0 for x in p], A.EPS)) / t
                    z = np.maximum(z - np.log(np.exp(z).sum(axis=1, keepdims=True)), floor)
                    sums, n = sums - z @ q[: len(p)] - floor * sum(q[len(p) :]), n + 1
            n += int(held.sum())
            full = pa.array(held & (size > 0))
            p, q = (pc.fill_null(x.filter(full).flatten(), 0.0).to_numpy(zero_copy_only=False).astype(float) for x in (probs, target))
            size = size[held & (size > 0)]
            if not len(size):
                continue
            starts = np.cumsum(size) - size
            z = np.log(np.maximum(p, A.EPS))
            z = (z - np.repeat(np.maximum.reduceat(z, starts), size)) / t
            z -= np.repeat(np.log(np.add.reduceat(np.exp(z), starts, axis=1)), size, axis=1)
            sums -= np.maximum(z, floor) @ q
        if seen:
            yield pa.record_batch([pa.array(temperatures, pa.float64()), pa.array(sums), pa.array([n] * len(temperatures), pa.int64())], ["temperature", "s", "n"])

    return run


def nll_grid(scored: DataFrame, temperatures: list[float]) -> DataFrame:
    """temperature, nll: mean soft-target loss at each temperature, from one pass over the items, in Arrow batches: each value is
    taken at all temperatures at once."""
    given = list(dict.fromkeys(float(x) for x in temperatures))
    sums = scored.select("probs", "target").mapInArrow(_losses(given), "temperature double, s double, n long")
    return sums.groupBy("temperature").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("nll"))


def grid(low: float, high: float) -> list[float]:
    """POINTS temperatures, evenly spaced in the logarithm."""
    a, b = math.log(low), math.log(high)
    return [math.exp(a + (b - a) * i / (POINTS - 1)) for i in range(POINTS)]


def fit_temperature(scored: DataFrame) -> float:
    """The temperature of least loss in [LOW, HIGH]: ROUNDS grids, each around the best point of the last.

    The scored table is read once a round; persist or write it first if it is costly. The loss has one
    minimum in the logarithm of the temperature, which the two intervals beside the best point enclose.
    An empty table gives 1.
    """
    at = grid(LOW, HIGH)
    for _ in range(ROUNDS):
        found = {r["temperature"]: r["nll"] for r in nll_grid(scored, at).collect()}
        if not found:
            return 1.0
        best = min(range(POINTS), key=lambda i: (found[at[i]], i))
        at = grid(at[max(0, best - 1)], at[min(POINTS - 1, best + 1)])
    return at[POINTS // 2]
