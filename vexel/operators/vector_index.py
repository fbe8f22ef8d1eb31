"""An index of a vector table for many nearest-neighbour queries: inverted lists over k-means cells.

Every row is in the list of its nearest cell. A query visits the lists of its nearest cells, in one join for all queries; what
these miss can be found by a second join with the lists that may still hold a nearer row, which makes the answer exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import discard, stored
from . import cluster
from .gradient import matrix_of
from .knn import _NONE, TILE_ROWS, nearer_in_tiles


@dataclass
class VectorIndex:
    """`rows` (list, part, m, v) has all rows of the table; a list is group * cells + cell. Of the lists with rows: `parts`, over which a
    list is dealt, and `radius`, the distance of its farthest row from the cell's centroid. Both are as many numbers as there
    are lists, and stay on the driver with the centroids."""

    centroids: np.ndarray
    rows: DataFrame
    parts: dict[int, int]
    radius: dict[int, float]
    grouped: bool

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def close(self) -> None:
        """Deletes the table of the lists."""
        discard(self.rows)


def build(df: DataFrame, cells: int, group: str | None = None, sample_rows: int = 100_000, max_epoch: int = 8, part_rows: int = 20_000, seed: int = 11) -> VectorIndex:
    """An index over all rows (m, v) of `df`. With `group` (a column of numbers from 0 on) a query finds rows of its own group only.

    Cells are fitted on about `sample_rows` rows (all, if there are no more), taken by a hash of m; every row is then
    indexed. A list of more than `part_rows` rows is dealt over several parts by a hash, so a cell that holds a third of the
    table is many tasks. Rows whose vector is null are not indexed. An empty table has an index without cells.
    """
    rows = df.select("m", "v", (F.col(group) if group else F.lit(0)).cast("bigint").alias("g")).filter("v is not null")
    count = rows.count()
    share = min(1.0, sample_rows / max(count, 1))
    place = F.pmod(F.xxhash64(F.lit(seed), "m"), F.lit(1 << 40))
    sample = stored(rows.filter(place <= F.lit(share * (1 << 40))).select("m", "v", place.alias("h")), "sample")
    start = [r["v"] for r in sample.orderBy("h", "m").limit(cells).collect()]
    centroids = cluster.lloyd(sample, np.array(start, float), max_epoch).means if start else np.zeros((0, 0))
    discard(sample)
    if not len(centroids):
        return VectorIndex(centroids, stored(rows.selectExpr("g as list", "g as part", "m", "v"), "lists"), {}, {}, group is not None)
    told = cluster.assign(rows, centroids).select((F.col("g") * len(centroids) + F.col("cluster")).alias("list"), "m", "v", "d2")
    told = stored(told, "assigned")
    facts = told.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("d2")).collect()
    parts = {r["list"]: -(-r["n"] // part_rows) for r in facts}
    known = told.sparkSession.createDataFrame(list(parts.items()), "list bigint, parts bigint")  # a row for each list
    dealt = told.join(F.broadcast(known), "list").select("list", F.pmod(F.xxhash64("m"), F.col("parts")).alias("part"), "m", "v")
    index = VectorIndex(centroids, stored(dealt, "lists"), parts, {r["list"]: float(np.sqrt(r["d2"])) for r in facts}, group is not None)
    discard(told)
    return index


def _visits(index: VectorIndex, queries: DataFrame, probes: int, beyond: bool) -> DataFrame:
    """`queries` (qid, v, g, bound) once for each list to visit: those of the `probes` nearest cells, or those further ones that may hold
    a row whose squared distance from the query is within `bound` (that of the k-th row found)."""
    groups = sorted({i // index.cells for i in index.radius})
    radius = np.full((len(groups) + 1, index.cells), np.nan)  # the last is of groups without rows
    for i, far in index.radius.items():
        radius[groups.index(i // index.cells), i % index.cells] = far
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, np.array(groups, np.int64), radius))

    @F.pandas_udf("array<bigint>")
    def lists(v: pd.Series, g: pd.Series, bound: pd.Series) -> pd.Series:
        centroids, groups, radius = shared.value
        out = []
        for at in range(0, len(v), TILE_ROWS):
            part = slice(at, at + TILE_ROWS)
            d, own, reach = np.sqrt(cluster.squared(matrix_of(v.iloc[part]), centroids)), g.iloc[part].to_numpy(np.int64), np.sqrt(bound.iloc[part].to_numpy(float))
            place = np.minimum(np.searchsorted(groups, own), len(groups) - 1)
            around = radius[np.where(groups[place] == own, place, len(groups))]
            order = np.argsort(np.where(np.isnan(around), np.inf, d), axis=1, kind="stable")
            visit = np.zeros(d.shape, bool)
            np.put_along_axis(visit, order[:, :probes], True, axis=1)
            if beyond:  # the bound of a list gives way to the rounding of distances
                visit = ~visit & (d - around <= reach[:, None] * (1 + 1e-9) + 1e-12)
            visit &= ~np.isnan(around)
            out += [i * len(centroids) + np.flatnonzero(one) for i, one in zip(own, visit)]
        return pd.Series(out, dtype=object)

    return queries.select("qid", "v", "bound", F.explode(lists("v", "g", "bound")).alias("list"))


def _met(index: VectorIndex, visits: DataFrame, k: int, exclude_self: bool, block_queries: int) -> DataFrame:
    """(qid, m, dist): the best `k` rows within the bound of each (query, part of a list), by one cogrouped join. Many queries of one
    list are dealt over blocks. Rows beyond a query's bound are not returned, so lists in which nothing is near add no rows."""
    visits = stored(visits, "visits")
    counts = {r["list"]: -(-r["n"] // block_queries) for r in visits.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = visits.sparkSession
    facts = spark.createDataFrame([(i, index.parts[i], b) for i, b in counts.items()], "list bigint, parts bigint, blocks bigint")  # a row for each list
    asked = visits.join(F.broadcast(facts), "list").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    held = index.rows.join(F.broadcast(facts), "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    key = ["list", "part", "block"]

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "m": np.zeros(0, np.int64), "dist": np.zeros(0)})
        qid, bound = asked["qid"].to_numpy(np.int64), asked["bound"].to_numpy(float)
        best_m, best_d = np.full((len(qid), k), _NONE), np.repeat(np.where(np.isinf(bound), np.nan, bound)[:, None], k, axis=1)
        nearer_in_tiles("euclidean2", k, held["m"].to_numpy(np.int64), matrix_of(held["v"]), matrix_of(asked["v"]), qid if exclude_self else None, best_m, best_d)
        have = (best_m != _NONE) & ~np.isinf(best_d)
        return pd.DataFrame({"qid": np.repeat(qid, have.sum(axis=1)), "m": best_m[have], "dist": best_d[have]})

    found = asked.select(*key, "qid", "v", "bound").groupBy(*key).cogroup(held.select(*key, "m", "v").groupBy(*key)).applyInPandas(best, "qid bigint, m bigint, dist double")
    found = stored(_first(found, k), "found")
    discard(visits)
    return found


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best `k` of each query's finds, which are at most k for each list part it visited (and within its bound)."""
    place = F.row_number().over(W.partitionBy("qid").orderBy("dist", "m"))
    return found.select("qid", "m", "dist").withColumn("rank", place).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, exact: bool = False, exclude_self: bool = False, block_queries: int = 5_000) -> DataFrame:
    """(qid, rank, m, dist): of each query (qid, v[, g]) the `k` nearest rows by squared distance, ties by m.

    Rows of the `probes` nearest lists are looked at: all queries in one join, whatever their number. With `exact`, a second
    join visits every further list that may hold a row (by the distance of its centroid less its radius) within the k-th distance
    found, returns the rows within it only, and no row is missed; a query that found fewer than `k` rows visits all. Without it rows in lists not visited
    are missed, and `recall` tells how many. A query whose vector is null has no rows.
    """
    own = queries.select("qid", "v", (F.col("g") if index.grouped else F.lit(0)).cast("bigint").alias("g")).filter("v is not null")
    if not index.cells:
        return own.select("qid", F.lit(1).alias("rank"), F.col("qid").alias("m"), F.lit(0.0).alias("dist")).limit(0)
    found = _met(index, _visits(index, own.withColumn("bound", F.lit(float("inf"))), probes, False), k, exclude_self, block_queries)
    if exact:
        bound = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("bound"))
        further = own.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        found = _first(found.unionByName(_met(index, _visits(index, further, probes, True), k, exclude_self, block_queries)), k)
    return found.select("qid", "rank", "m", "dist")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true (qid, m) pairs that were found."""
    got = truth.select("qid", "m").join(found.select("qid", "m", F.lit(1).alias("hit")), ["qid", "m"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return got[0] / got[1] if got[1] else 1.0


def probes_for(index: VectorIndex, k: int, target: float = 0.9, sample_queries: int = 200, seed: int = 12) -> int:
    """The least number of lists, of 1, 2, 4 ..., whose recall of the `k` nearest reaches `target` for about `sample_queries` indexed rows."""
    rows = index.rows
    share = min(1.0, sample_queries / max(rows.count(), 1))
    some = F.pmod(F.xxhash64(F.lit(seed), "m"), F.lit(1 << 40)) <= F.lit(share * (1 << 40))
    asked = rows.filter(some).select(F.col("m").alias("qid"), "v", F.expr(f"list div {max(index.cells, 1)}").alias("g"))
    truth = stored(search(index, asked, k, max(1, index.cells // 8), exact=True, exclude_self=True), "truth")
    probes = 1
    while probes < index.cells and recall(search(index, asked, k, probes, exclude_self=True), truth) < target:
        probes *= 2
    discard(truth)
    return min(probes, max(index.cells, 1))
