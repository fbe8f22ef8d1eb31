"""Gradient descent whose gradients are sums over all rows: tasks add up their own rows, Spark adds up the tasks.

An epoch is one job over the whole table and one step of the weights, which are few and stay on the driver. No row is left
out, no group is gathered, and the order of rows does not matter, so any partitioning gives the same weights (up to the
rounding of sums). What is drawn (noise, dropout, starting weights) is drawn by hashes of row numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Called after each epoch with its number and the mean error before its step.
Progress = Callable[[int, float], None]


def totals(rows: DataFrame, kernel: Callable, shared: object, size: int) -> np.ndarray:
    """The sum of kernel(batch, shared), arrays of `size` numbers, over all batches of rows. Of a task only cells other than zero travel."""
    held_by_all = rows.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += kernel(batch, held_by_all.value)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": [at], "x": [total[at]]})

    cells = rows.mapInPandas(run, "i array<bigint>, x array<double>").select(F.explode(F.arrays_zip("i", "x")).alias("c"))
    got = cells.groupBy("c.i").agg(F.sum("c.x").alias("x")).toPandas()
    held_by_all.unpersist()
    out = np.zeros(size)
    out[got["i"].to_numpy(np.int64)] = got["x"].to_numpy(float)
    return out


def matrix_of(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def drawn(seed: int, step: int, m: np.ndarray, width: int) -> np.ndarray:
    """Numbers in [0, 1) of shape (rows, width), by a hash of (seed, step, row number, place)."""
    with np.errstate(over="ignore"):
        x = np.asarray(m, np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        x = x ^ (np.uint64(seed & 0xFFFFFFFF) << np.uint64(32)) ^ np.uint64((step * 0x632BE5AB) & 0xFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(a) for a in arrays])


def shaped(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([a.size for a in like])[:-1]
    return [x.reshape(a.shape) for x, a in zip(np.split(values, cuts), like)]


@dataclass
class Adam:
    """A step along the running mean of gradients over the root of that of their squares, element by element."""

    rate: float | np.ndarray
    first: float = 0.9
    second: float = 0.99
    mean: np.ndarray | None = None
    square: np.ndarray | None = None
    steps: int = 0

    def __call__(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if self.mean is None:
            self.mean, self.square = np.zeros_like(weights), np.zeros_like(weights)
        self.steps += 1
        self.mean = self.first * self.mean + (1 - self.first) * gradient
        self.square = self.second * self.square + (1 - self.second) * gradient**2
        return weights - self.rate * (self.mean / (1 - self.first**self.steps)) / (np.sqrt(self.square / (1 - self.second**self.steps)) + 1e-8)


@dataclass
class Fit:
    weights: list[np.ndarray]
    errors: list[float] = field(default_factory=list)


def descend(rows: DataFrame, start: list[np.ndarray], gradient: Callable, epochs: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray], decay: list[float] | None = None, progress: Progress | None = None) -> Fit:
    """`epochs` steps from `start`. gradient(weights, batch, epoch) gives (error, number of rows, gradients), each a sum over the batch;
    `decay` is added to the mean gradient as that share of the weights. Without rows the weights stay as they are."""
    weights, errors = [np.asarray(w, float) for w in start], []
    share = flat([np.full(w.shape, d) for w, d in zip(weights, decay or [0.0] * len(weights))])
    size = len(share)

    def kernel(batch: pd.DataFrame, shared: tuple) -> np.ndarray:
        error, count, parts = gradient(shared[0], batch, shared[1])
        return np.concatenate([[error, count], flat(parts)])

    for epoch in range(epochs):
        got = totals(rows, kernel, (weights, epoch), size + 2)
        if not got[1]:
            break
        errors.append(float(got[0] / got[1]))
        now = flat(weights)
        weights = shaped(step(now, got[2:] / got[1] + share * now), weights)
        if progress:
            progress(epoch, errors[-1])
    return Fit(weights, errors)
