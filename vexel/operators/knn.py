"""Nearest neighbours of a set of queries among all rows of a vector table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vec

#: Bytes of query vectors that are sent to every task at once; more queries go in as many blocks.
BLOCK_BYTES = 16 << 20
#: A task compares so many queries with so many rows at a time, and measures so many pairs at a time: its memory is that of its best rows.
TILE_QUERIES, TILE_ROWS, TILE_PAIRS = 256, 1024, 1 << 15

#: The distances of rows, an array (rows, elements), from one query.
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _distances(kind: str | Distance, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances of shape (queries, rows)."""
    if callable(kind):
        return np.array([kind(rows, q) for q in queries], float).reshape(len(queries), len(rows))
    if kind in ("euclidean2", "euclidean"):
        out = np.empty((len(queries), len(rows)))
        for i, q in enumerate(queries):  # differences first: equal vectors have distance 0 exactly
            d = rows - q
            out[i] = np.einsum("ij,ij->i", d, d)
        return out if kind == "euclidean2" else np.sqrt(out)
    if kind == "cosine":
        size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        return np.where(size == 0, 2.0, 1.0 - (queries @ rows.T) / np.where(size == 0, 1.0, size))
    if kind == "histogram_intersection":
        sums = queries.sum(axis=1)[:, None]
        common = np.stack([np.minimum(rows, q).sum(axis=1) for q in queries])
        return np.where(sums == 0, 1.0, 1.0 - common / np.where(sums == 0, 1.0, sums))
    raise ValueError(f"no such distance: {kind}")


def _bounds(kind: str | Distance, rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what each distance lies, of shape (queries, rows): by one matrix product and its rounding, or else the distance itself."""
    if kind not in ("euclidean2", "euclidean", "cosine"):
        d = _distances(kind, rows, queries)
        return d, d
    own, other = np.einsum("ij,ij->i", queries, queries)[:, None], np.einsum("ij,ij->i", rows, rows)[None, :]
    rounding = 8 * (rows.shape[1] + 8) * np.finfo(float).eps
    if kind == "cosine":
        size = np.sqrt(own) * np.sqrt(other)
        near = np.where(size == 0, 2.0, 1.0 - (queries @ rows.T) / np.where(size == 0, 1.0, size))
        return near - rounding, near + rounding
    near, off = own + other - 2 * (queries @ rows.T), rounding * (own + other)
    if kind == "euclidean2":
        return near - off, near + off
    return np.sqrt(np.maximum(near - off, 0)) * (1 - rounding), np.sqrt(np.maximum(near + off, 0)) * (1 + rounding)


def _paired(kind: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The distance of each row from the query at the same place. Equal pairs have equal distances, wherever they are met."""
    if kind == "cosine":
        size = np.sqrt(np.einsum("ij,ij->i", queries, queries)) * np.sqrt(np.einsum("ij,ij->i", rows, rows))
        return np.where(size == 0, 2.0, 1.0 - np.einsum("ij,ij->i", rows, queries) / np.where(size == 0, 1.0, size))
    d = rows - queries  # differences first: equal vectors have distance 0 exactly
    d = np.einsum("ij,ij->i", d, d)
    return d if kind == "euclidean2" else np.sqrt(d)


#: In the place of a row that has not been found.
_NONE = np.iinfo(np.int64).max


def _nearer(kind: str | Distance, k: int, m: np.ndarray, rows: np.ndarray, queries: np.ndarray, itself: np.ndarray | None, best_m: np.ndarray, best_d: np.ndarray) -> None:
    """Puts the rows that are nearer to a query than its `k` best into these, (queries, k) by distance and m; `itself` has the row no query may find."""
    low, high = _bounds(kind, rows, queries)
    exact = high is low
    if itself is not None:
        at = itself[:, None] == m[None, :]
        low, high = np.where(at, np.inf, low), np.where(at, np.inf, high)
    reach = best_d[:, -1]
    if len(m) >= k and np.isnan(reach).any():  # of the first rows only the best are measured
        reach = np.fmin(reach, np.partition(high, k - 1, axis=1)[:, k - 1])
    q, r = np.nonzero(~(low > reach[:, None]))
    if not len(q):
        return
    d = low[q, r]
    if not exact:
        for at in range(0, len(q), TILE_PAIRS):
            some = slice(at, at + TILE_PAIRS)
            d[some] = np.where(np.isposinf(d[some]), np.inf, _paired(kind, rows[r[some]], queries[q[some]]))
    touched = np.unique(q)
    q, d, found = np.concatenate([np.repeat(touched, k), q]), np.concatenate([best_d[touched].ravel(), d]), np.concatenate([best_m[touched].ravel(), m[r]])
    order = np.lexsort((found, d, q))
    q = q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    best_d[q[keep], place[keep]], best_m[q[keep], place[keep]] = d[order][keep], found[order][keep]


def nearer_in_tiles(kind: str | Distance, k: int, m: np.ndarray, rows: np.ndarray, queries: np.ndarray, itself: np.ndarray | None, best_m: np.ndarray, best_d: np.ndarray) -> None:
    """`_nearer` for any number of rows and queries."""
    for at in range(0, len(m) if len(queries) else 0, TILE_ROWS):
        part = slice(at, at + TILE_ROWS)
        for own in (slice(i, i + TILE_QUERIES) for i in range(0, len(queries), TILE_QUERIES)):
            _nearer(kind, k, m[part], rows[part], queries[own], None if itself is None else itself[own], best_m[own], best_d[own])


def knn(base: DataFrame, queries: DataFrame, k: int, distance: str | Distance = "euclidean2", exclude_self: bool = False) -> DataFrame:
    """(qid, rank, m, dist): of each query (qid, v) the `k` nearest rows of base (m, v), ties by m. `distance` has a name, or is a `Distance`.

    Queries are few beside the rows: they are sent to the tasks in blocks of at most `BLOCK_BYTES`, every task
    keeps its own best `k` of each query, and only these are shuffled. Rows are read once for each block and dealt evenly over
    the tasks, whatever the files are; for many queries there is `vector_index`. Rows and queries whose vector is null are left out.
    """
    base = base.filter("v is not null")
    rows = queries.select("qid", "v").filter("v is not null").orderBy("qid").toLocalIterator()  # in pieces; only one block is held
    out, block, held = None, [], 0
    for row in rows:
        block.append(row)
        held += 8 * len(row["v"])
        if held >= BLOCK_BYTES:
            out, block, held = _united(out, _block(base, block, k, distance, exclude_self)), [], 0
    if block or out is None:
        out = _united(out, _block(base, block, k, distance, exclude_self))
    return out


def _united(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _block(base: DataFrame, block: list, k: int, distance: str | Distance, exclude_self: bool) -> DataFrame:
    ids = np.array([r["qid"] for r in block], np.int64)
    context = base.sparkSession.sparkContext
    shared = context.broadcast((ids, np.array([r["v"] for r in block], float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, queries = shared.value
        best_m, best_d = np.full((len(qids), k), _NONE), np.full((len(qids), k), np.nan)
        for batch in batches:
            for at in range(0, len(batch) if len(qids) else 0, TILE_ROWS):
                part = batch.iloc[at : at + TILE_ROWS]
                m, data = part["m"].to_numpy(np.int64), np.stack(part["v"].to_numpy())
                nearer_in_tiles(distance, k, m, data, queries, qids if exclude_self else None, best_m, best_d)
        have = (best_m != _NONE) & ~np.isinf(best_d)
        yield pd.DataFrame({"qid": np.repeat(qids, have.sum(axis=1)), "m": best_m[have], "dist": best_d[have]})

    best = base.select("m", "v").repartition(2 * context.defaultParallelism).mapInPandas(run, "qid bigint, m bigint, dist double")
    place = F.row_number().over(W.partitionBy("qid").orderBy("dist", "m"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "rank", "m", "dist")


def knn_by(base: DataFrame, queries: DataFrame, k: int, distance: Callable[[Column, Column], Column]) -> DataFrame:
    """`knn` for any distance that is a column expression of (row, query); `queries` must be small enough to broadcast.

    Every pair is a row that is sorted, which is for small tables; `knn` takes a function of arrays for large ones. The size of
    the queries is checked: above `BLOCK_BYTES` this raises, and `knn` or several calls are the way.
    """
    size = queries.agg(F.coalesce(F.sum(F.size("v") * F.lit(8).cast("bigint")), F.lit(0))).first()[0]
    if size > BLOCK_BYTES:
        raise ValueError(f"{size} bytes of queries are more than the {BLOCK_BYTES} that are broadcast")
    pairs = base.select("m", "v").crossJoin(F.broadcast(queries.select("qid", F.col("v").alias("_q"))))
    pairs = pairs.select("qid", "m", distance(F.col("v"), F.col("_q")).alias("dist"))
    place = F.row_number().over(W.partitionBy("qid").orderBy("dist", "m"))
    return pairs.withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "rank", "m", "dist")


def nearest(base: DataFrame, queries: DataFrame, distance: str = "euclidean2", exclude_self: bool = False) -> DataFrame:
    """(qid, m, dist): the nearest row of each query, the smallest m in a tie."""
    return knn(base, queries, 1, distance, exclude_self).select("qid", "m", "dist")


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, predicted, votes): the most frequent label among the neighbours, the smallest in a tie.

    `labels` (m, label) is joined by key, so it can be of any size.
    """
    counts = neighbours.select("qid", "m").join(labels, "m").groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy("qid").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "label")).alias("b")).select("qid", F.col("b.label").alias("predicted"), (-F.col("b.votes")).alias("votes"))
