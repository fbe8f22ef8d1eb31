"""Centroid clustering by sort-means: centroids are tried in the order of their distance from the one a vector had before."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, stored

#: Components beyond it have squared distances that no long holds.
LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors of exactly `dims` components, none null or not finite, as integers floor(scale * x)."""
    whole = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    number = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    within = lambda y: F.when(F.abs(y) <= LARGEST, y).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} has no distance in a long")).cast("bigint"))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform("v", lambda x: within(number(x)).cast("int")).alias("v"))


def first_by_hash(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the `k` smallest SHA-256 of `seed:vec_id`, in that order; equal ids by their vectors, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def between(centroids: np.ndarray) -> np.ndarray:
    """Squared distances between centroids."""
    return ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)


def nearest(data: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, number of distances computed) of each vector; in a tie the smaller number.

    A vector starts at the centroid `before`. Others follow in the order of their distance from that one, and the scan
    ends strictly beyond twice the vector's own distance to it: none further can be as near. A centroid at exactly twice
    the distance may tie, so it is still tried.
    """
    apart = between(centroids)
    at, best, tried = before.copy(), np.zeros(len(data), np.int64), np.ones(len(data), np.int64)
    for own in np.unique(before):
        rows = np.flatnonzero(before == own)
        start = ((data[rows] - centroids[own]) ** 2).sum(axis=1)
        now_at, now = np.full(len(rows), own), start.copy()
        left = np.arange(len(rows))
        for other in np.lexsort((np.arange(len(centroids)), apart[own])):
            if other == own:
                continue
            left = left[apart[own, other] <= 4 * start[left]]
            if not len(left):
                break
            d = ((data[rows[left]] - centroids[other]) ** 2).sum(axis=1)
            tried[rows[left]] += 1
            closer = (d < now[left]) | ((d == now[left]) & (other < now_at[left]))
            now[left[closer]], now_at[left[closer]] = d[closer], other
        at[rows], best[rows] = now_at, now
    return at, best, tried


@dataclass
class Clustering:
    """`centroids` as integers; `rows` (vec_id, v, cluster, distance, tried) with the squared distance and how many were computed."""

    centroids: np.ndarray
    rows: DataFrame


def _assigned(state: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """One pass: vectors stay where they are, with the cluster of this round instead of the last one's."""
    schema = pa.schema([("vec_id", state.select("vec_id").limit(0).toArrow().schema.field(0).type), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("tried", pa.int32())])
    shared = state.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.asarray(batch.column(1).flatten()).astype(np.int64).reshape(len(batch), -1)
            at, best, tried = nearest(data, np.asarray(batch.column(2)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(schema.field("v").type), pa.array(at, pa.int32()), pa.array(best, pa.int64()), pa.array(tried, pa.int32())], schema=schema)

    return state.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, distance bigint, tried int")


def sort_means(vectors: DataFrame, start: np.ndarray, rounds: int) -> Clustering:
    """`rounds` rounds over (vec_id, v) with integer components, from the centroids `start`; then all are assigned once more.

    A round is a pass that reads the vectors with their last clusters and writes them with the new ones (the last round's
    table goes then), and a sum by cluster that tasks begin on their own rows: a cluster of any size is one row for each task.
    Only centroids, as many numbers as the model has, reach the driver. Sums are exact, and a new component is the floor of
    sum over count; a cluster without vectors keeps its centroid. Rounds end early when no centroid moves, as all
    further ones would give the same. Repeated vectors and ids are rows like others. Without vectors or
    centroids there are no rows.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids, dims = np.asarray(start, np.int64), start.shape[1] if len(start) else 0
    state = stored(vectors.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).alias("tried")), "vectors")
    if not len(centroids):
        return Clustering(centroids, state.limit(0))
    settled = False
    for step in range(rounds + 1):
        if settled:
            break
        new = stored(_assigned(state, centroids, kind), "assigned")
        discard(state)
        state = new
        if step < rounds:
            sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims))).collect()
            moved = centroids.copy()
            for row in sums:
                moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
            settled, centroids = bool((moved == centroids).all()), moved
    return Clustering(centroids, state)


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that has `dims` finite components.

    Starting centroids are the vectors of the smallest hashes of their ids; a vector of null id is clustered but starts
    none unless there are too few others. Of an empty table the result is empty. Other columns are ignored.
    """
    own = stored(whole_numbers(pick(vectors, (id_col, "vec_id"), (vec_col, "v")), dims, scale), "kept")
    done = sort_means(own, first_by_hash(own, k, seed), rounds)
    discard(own)
    spark = vectors.sparkSession
    inertia = {r["cluster"]: r["d"] for r in done.rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(done.centroids.tolist())]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.rows.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
