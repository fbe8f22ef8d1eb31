"""Dense linear algebra: matrices as cells (i, j, x), small ones as NumPy arrays on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .agg import covariance


def cells(df: DataFrame) -> DataFrame:
    """(i, j, x) of a vector table (m, v)."""
    return df.select(F.col("m").alias("i"), F.posexplode("v").alias("j", "x")).select("i", F.col("j").cast("bigint").alias("j"), "x")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")


def multiply(a: DataFrame, b: DataFrame, transpose_a: bool = False, transpose_b: bool = False) -> DataFrame:
    """op(A) op(B): a join on the inner index and a sum, which partial aggregation shortens before the shuffle."""
    a, b = (transpose(x) if t else x for x, t in ((a, transpose_a), (b, transpose_b)))
    left, right = a.select("i", F.col("j").alias("k"), F.col("x").alias("p")), b.select(F.col("i").alias("k"), "j", F.col("x").alias("q"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("x"))


def combine(a: DataFrame, b: DataFrame, minus: bool = False) -> DataFrame:
    """A + B or A - B."""
    right = b.select("i", "j", F.col("x").alias("y"))
    return a.join(right, ["i", "j"]).select("i", "j", (F.col("x") - F.col("y") if minus else F.col("x") + F.col("y")).alias("x"))


def scaled(a: DataFrame, times: float = 1.0, plus: float = 0.0) -> DataFrame:
    return a.select("i", "j", (F.col("x") * times + plus).alias("x"))


def diagonal(df: DataFrame) -> DataFrame:
    """(i, j, x): a vector (m, v of one row) as the diagonal of a matrix, zeros elsewhere."""
    place = df.select(F.posexplode("v").alias("i", "d"), F.size("v").alias("n"))
    wide = place.select(F.col("i").cast("bigint").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), "d")
    return wide.select("i", F.col("j").cast("bigint").alias("j"), F.when(F.col("i") == F.col("j"), F.col("d")).otherwise(0.0).alias("x"))


def times_matrix(df: DataFrame, matrix: np.ndarray, out: str = "v") -> DataFrame:
    """Each vector times the rows of a small matrix: element k of the result is the dot product with row k."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in matrix))
    return df.withColumn(out, F.transform(rows, lambda r: vec.dot("v", r)))


def eigen_symmetric(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows), values falling; of each vector the element of largest magnitude is positive."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    values, columns = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(-values, kind="stable")
    rows = columns.T[order]
    signs = np.sign(rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)])
    return values[order], rows * np.where(signs == 0, 1, signs)[:, None]


def eigen_top(matrix: np.ndarray, count: int, rounds: int = 1000, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs of largest magnitude by power iteration and deflation, from a start vector of ones."""
    rest, values, rows = np.array(matrix, float), [], []
    for _ in range(min(count, len(rest))):
        x = np.ones(len(rest)) / np.sqrt(len(rest))
        value = 0.0
        for _ in range(rounds):
            y = rest @ x
            size = np.linalg.norm(y)
            if size == 0:
                break
            y /= size
            new = float(y @ rest @ y)
            done = abs(new - value) <= tolerance * max(1.0, abs(new))
            x, value = y, new
            if done:
                break
        values.append(value)
        rows.append(x)
        rest = rest - value * np.outer(x, x)
    return np.array(values), np.array(rows).reshape(-1, len(rest))


@dataclass(frozen=True)
class Covariance:
    """A mean, a covariance matrix and its eigenpairs (rows, values falling)."""

    mean: np.ndarray
    cov: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    count: int


def principal_components(df: DataFrame, count: int | None = None) -> Covariance:
    """Covariance over the cluster, eigenpairs on the driver; `count` of them, or all."""
    mean, cov = covariance(df)
    values, vectors = eigen_symmetric(cov)
    top = len(values) if count is None else count
    return Covariance(mean, cov, values[:top], vectors[:top], df.count())


def assign(cost: np.ndarray) -> tuple[list[int], float]:
    """The cheapest assignment: for each row (task) its column (worker) or -1, and the total.

    Shortest augmenting paths with potentials, O(n^3), on one small matrix; rectangular ones are allowed.
    """
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        of, total = assign(cost.T)
        out = [-1] * cost.shape[0]
        for worker, task in enumerate(of):
            if task >= 0:
                out[task] = worker
        return out, total
    rows, cols = cost.shape
    u, v, match = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, int)  # match[c]: row of column c, from 1
    for row in range(1, rows + 1):
        match[0], at = row, 0
        least, came, used = np.full(cols + 1, np.inf), np.zeros(cols + 1, int), np.zeros(cols + 1, bool)
        while True:
            used[at] = True
            i = match[at]
            slack = cost[i - 1] - u[i] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], at
            open_ = np.where(used[1:], np.inf, least[1:])
            nxt = int(np.argmin(open_)) + 1
            delta = open_[nxt - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = nxt
            if match[at] == 0:
                break
        while at:
            match[at] = match[came[at]]
            at = came[at]
    out = [-1] * rows
    for c in range(1, cols + 1):
        if match[c]:
            out[match[c] - 1] = c - 1
    return out, float(sum(cost[r, c] for r, c in enumerate(out) if c >= 0))


def assign_all(problems: DataFrame) -> DataFrame:
    """(problem_id, task, worker, cost) rows to (problem_id, task, worker, total): each problem is solved where its cells meet."""
    import pandas as pd

    def run(cells_of: pd.DataFrame) -> pd.DataFrame:
        grid = cells_of.pivot(index="task", columns="worker", values="cost")
        of, total = assign(grid.to_numpy())
        workers = grid.columns.to_numpy()
        return pd.DataFrame({"problem_id": cells_of["problem_id"].iloc[0], "task": grid.index.to_numpy(), "worker": [int(workers[c]) if c >= 0 else -1 for c in of], "total": total})

    return problems.groupBy("problem_id").applyInPandas(run, "problem_id int, task int, worker int, total double")
