"""Hierarchical quantisers: trees of k-means, of k-means in a principal subspace, and of softmax regressors.

A tree is a list of levels; a level maps a node's path to what decides among its children. A row's leaf is its path in
mixed radix. A level is trained as a whole: each pass over the rows is one job for all of its nodes, whose tasks add up
their own rows by (node, child). Rows never meet in their node, so a node may hold any share of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import discard, stored
from . import cluster, learn
from .agg import covariance_of, moments
from .gradient import Progress, totals
from .linalg import eigen_symmetric


@dataclass
class Node:
    """What decides among children: centroids, after a projection if there is one, or a regressor's weights."""

    means: np.ndarray
    basis: np.ndarray | None = None
    weights: np.ndarray | None = None

    def distances(self, data: np.ndarray) -> np.ndarray:
        """(rows, children): the smaller the nearer."""
        if self.weights is not None:
            return -(data @ self.weights.T)
        return cluster.squared(data @ self.basis.T if self.basis is not None else data, self.means)


@dataclass
class Tree:
    shape: list[int]
    levels: list[dict[int, Node]] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return int(np.prod(self.shape))

    def descend(self, data: np.ndarray, height: int | None = None, beam: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance at the last level) of each row; with `beam` the best few parents of the last level are tried."""
        height = len(self.levels) if height is None else min(height, len(self.levels))
        at, last = np.zeros(len(data), np.int64), np.zeros(len(data))
        for y in range(height):
            if beam > 1 and y == height - 2:
                return self._beam(data, at, y, beam)
            chosen, dist = np.zeros(len(data), np.int64), np.full(len(data), np.inf)
            for node in np.unique(at):
                if node in self.levels[y]:
                    rows = np.flatnonzero(at == node)
                    d = self.levels[y][node].distances(data[rows])
                    chosen[rows] = d.argmin(axis=1)
                    dist[rows] = d.min(axis=1)
            at, last = at * self.shape[y] + chosen, dist
        return at, last

    def _beam(self, data: np.ndarray, at: np.ndarray, y: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        leaf, best = np.zeros(len(data), np.int64), np.full(len(data), np.inf)
        for i, node in enumerate(at):
            if node not in self.levels[y]:
                continue
            near = np.argsort(self.levels[y][node].distances(data[i : i + 1])[0], kind="stable")[:beam]
            for child in node * self.shape[y] + near:
                if child in self.levels[y + 1]:
                    d = self.levels[y + 1][child].distances(data[i : i + 1])[0]
                    if d.min() < best[i]:
                        leaf[i], best[i] = child * self.shape[y + 1] + d.argmin(), d.min()
        return leaf, best

    def leaf_mean(self, label: int) -> np.ndarray | None:
        node = self.levels[-1].get(label // self.shape[-1])
        return None if node is None else node.means[label % self.shape[-1]]


def label(df: DataFrame, tree: Tree, height: int | None = None, beam: int = 1) -> DataFrame:
    """`df` with `leaf` and `dist`. Nothing is shuffled; the tree is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("leaf bigint, dist double")
    def run(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"leaf": np.zeros(0, int), "dist": np.zeros(0)})
        leaf, dist = shared.value.descend(np.stack(v.to_numpy()).astype(float), height, beam)
        return pd.DataFrame({"leaf": leaf, "dist": dist})

    return df.withColumn("_l", run("v")).withColumn("leaf", F.col("_l.leaf")).withColumn("dist", F.col("_l.dist")).drop("_l")


def _by_node(nodes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, places of its rows) of every node among the rows."""
    order = np.argsort(nodes, kind="stable")
    cuts = np.flatnonzero(np.diff(nodes[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield int(nodes[own[0]]), own


def _best_of(rows: DataFrame, n: int) -> DataFrame:
    """Of (node, key, m, v) the `n` rows of least (key, m) of every node: tasks keep their own best, and only these are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            held = held.sort_values(["node", "key", "m"], kind="stable").groupby("node", sort=False).head(n)
        if held is not None:
            yield held

    best = rows.select("node", "key", "m", "v").mapInPandas(run, "node bigint, key double, m bigint, v array<double>")
    place = F.row_number().over(W.partitionBy("node").orderBy("key", "m"))
    return best.withColumn("place", place).filter(F.col("place") <= n)


def _vectors_of(best: DataFrame) -> dict[int, np.ndarray]:
    out: dict[int, list] = {}
    for row in best.orderBy("node", "place").collect():
        out.setdefault(row["node"], []).append(row["v"])
    return {node: np.array(v, float) for node, v in out.items()}


def _first_rows(here: DataFrame, fan: int) -> dict[int, np.ndarray]:
    """Of every node its first `fan` rows by m."""
    return _vectors_of(_best_of(here.withColumn("key", F.lit(0.0)), fan))


def _plus_plus(here: DataFrame, fan: int, seed: int) -> dict[int, np.ndarray]:
    """k-means++ in every node at once: a pass draws candidates for each node's next mean, another one weighs them."""
    tries = round(2 + np.log10(max(fan, 1)))
    unit = lambda step: (F.pmod(F.xxhash64(F.lit(seed + step), "node", "m"), F.lit(1 << 52)).cast("double") + 1.0) / float((1 << 52) + 1)
    means = _vectors_of(_best_of(here.withColumn("key", unit(0)), 1))
    for step in range(1, fan):
        shared = here.sparkSession.sparkContext.broadcast(means)

        @F.pandas_udf("double")
        def gap(v: pd.Series, node: pd.Series) -> pd.Series:
            out = np.zeros(len(v))
            data = learn.matrix_of(v) if len(v) else None
            for own, at in _by_node(node.to_numpy(np.int64)):
                out[at] = cluster.squared(data[at], shared.value[own]).min(axis=1)
            return pd.Series(out)

        drawn = here.withColumn("gap", gap("v", "node")).filter("gap > 0")
        found = _vectors_of(_best_of(drawn.withColumn("key", -F.ln(unit(step)) / F.col("gap")), tries))
        order = sorted(found)

        def potentials(batch: pd.DataFrame, held: tuple) -> np.ndarray:
            have, new, place = held
            out, data = np.zeros((len(place), tries)), learn.matrix_of(batch["v"])
            for own, at in _by_node(batch["node"].to_numpy(np.int64)):
                if own in new:
                    near = cluster.squared(data[at], have[own]).min(axis=1)
                    out[place[own], : len(new[own])] += np.minimum(near[:, None], cluster.squared(data[at], new[own])).sum(axis=0)
            return out.ravel()

        cost = totals(here.select("v", "node"), potentials, (means, found, {n: i for i, n in enumerate(order)}), len(order) * tries).reshape(len(order), tries) if order else None
        best = {n: found[n][int(np.argmin(cost[i, : len(found[n])]))] for i, n in enumerate(order)}
        means = {n: np.vstack([have, best.get(n, have[-1])]) for n, have in means.items()}
    return means


def _lloyd(here: DataFrame, means: dict[int, np.ndarray], max_epoch: int, progress: Progress | None, level: int) -> dict[int, np.ndarray]:
    """K-means in every node at once, one job for each epoch: sums by (node, child), begun in the tasks. Until no row of any node
    moves, or `max_epoch` passes (0: no bound), the last of which moves no mean; an empty child keeps its mean."""
    order = sorted(means)
    place = {n: i for i, n in enumerate(order)}
    fan, width = max(len(m) for m in means.values()), next(iter(means.values())).shape[1]
    now, before, epoch = np.full((len(order), fan, width), np.inf), None, 0
    for n, m in means.items():
        now[place[n], : len(m)] = m

    def sums(batch: pd.DataFrame, held: tuple) -> np.ndarray:
        place, now, before = held
        out, data, error, moved = np.zeros((len(now), fan, width + 1)), learn.matrix_of(batch["v"]), 0.0, 0
        for own, at in _by_node(batch["node"].to_numpy(np.int64)):
            i = place[own]
            d = cluster.squared(data[at], now[i])
            child = d.argmin(axis=1)
            error += d.min(axis=1).sum()
            np.add.at(out[i], child, np.hstack([np.ones((len(at), 1)), data[at]]))
            if before is not None:
                moved += int((cluster.squared(data[at], before[i]).argmin(axis=1) != child).sum())
        return np.concatenate([[error, moved], out.ravel()])

    while True:
        got = totals(here.select("v", "node"), sums, (place, now, before), now.size // width * (width + 1) + 2)
        epoch += 1
        if progress:
            progress(level, float(got[0]))
        if before is not None and got[1] == 0 or max_epoch and epoch >= max_epoch:
            return {n: now[i, : len(means[n])] for n, i in place.items()}
        counts, added = np.split(got[2:].reshape(len(order), fan, width + 1), [1], axis=2)
        before, now = now, np.where(counts > 0, added / np.maximum(counts, 1), now)


def _level_means(here: DataFrame, fan: int, max_epoch: int, seed: int, seeding: str, progress: Progress | None, level: int) -> dict[int, np.ndarray]:
    means = _first_rows(here, fan) if seeding == "first" else _plus_plus(here, fan, seed)
    return _lloyd(here, means, max_epoch, progress, level) if means else {}


def _train(df: DataFrame, shape: list[int], level_of: Callable[[DataFrame, int, int], dict[int, Node]], base: Tree | None) -> Tree:
    """Level by level: the rows get their node from the levels above, then `level_of` (rows (m, v, node), fan, level) trains all nodes."""
    tree = Tree(list(shape))
    rows = df.select("m", "v")
    for y, fan in enumerate(shape):
        if base and y < len(base.levels) and base.shape[: y + 1] == tree.shape[: y + 1]:
            tree.levels.append(base.levels[y])
            continue
        here = stored(label(rows, tree).select("m", "v", F.col("leaf").alias("node")), "level")
        tree.levels.append(level_of(here, fan, y))
        discard(here)
    return tree


def kmeans_tree(df: DataFrame, shape: list[int], max_epoch: int = 50, seed: int = 11, base: Tree | None = None, seeding: str = "plus_plus", progress: Progress | None = None) -> Tree:
    """K-means in every node, level by level; `base` lends its levels as long as the shapes agree. `seeding` is plus_plus, or first: a
    node begins with its first rows by m. Nodes without rows have no means. The number of jobs follows levels, children
    and epochs, not nodes."""
    return _train(df, shape, lambda here, fan, y: {n: Node(m) for n, m in _level_means(here, fan, max_epoch, seed + y, seeding, progress, y).items()}, base)


def _bases(here: DataFrame, components: int) -> dict[int, np.ndarray]:
    """The top principal directions of every node's own rows. Covariances are decomposed in the tasks; only directions are collected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases = [eigen_symmetric(covariance_of(c, np.array(s), np.array(p))[1])[1][:components] for c, s, p in zip(batch["count"], batch["sums"], batch["products"])]
            yield pd.DataFrame({"key": batch["key"], "n": [len(b) for b in bases], "basis": [b.ravel() for b in bases]})

    got = moments(here, "node").mapInPandas(run, "key bigint, n int, basis array<double>").collect()
    return {r["key"]: np.array(r["basis"]).reshape(r["n"], -1) for r in got}


def pca_kmeans_tree(df: DataFrame, shape: list[int], components: int, max_epoch: int = 50, seed: int = 11, base: Tree | None = None, seeding: str = "plus_plus", progress: Progress | None = None) -> Tree:
    """As `kmeans_tree`, in the top principal directions of each node's own rows (not centred)."""

    def level_of(here: DataFrame, fan: int, y: int) -> dict[int, Node]:
        shared = here.sparkSession.sparkContext.broadcast(_bases(here, components))

        @F.pandas_udf("array<double>")
        def project(v: pd.Series, node: pd.Series) -> pd.Series:
            out: list = [None] * len(v)
            data = learn.matrix_of(v) if len(v) else None
            for own, at in _by_node(node.to_numpy(np.int64)):
                for i, z in zip(at, data[at] @ shared.value[own].T):
                    out[i] = z
            return pd.Series(out, dtype=object)

        flat = stored(here.withColumn("v", project("v", "node")), "projected")
        means = _level_means(flat, fan, max_epoch, seed + y, seeding, progress, y)
        discard(flat)
        return {n: Node(m, shared.value[n]) for n, m in means.items()}

    return _train(df, shape, level_of, base)


def regression_tree(df: DataFrame, shape: list[int], params: learn.SoftmaxParams = learn.SoftmaxParams(), max_epoch: int = 5, seed: int = 11, base: Tree | None = None, seeding: str = "plus_plus", progress: Progress | None = None) -> Tree:
    """Softmax regressors that label their own rows (`learn.regressor_nodes`) in every node, all nodes of a level at once."""

    def level_of(here: DataFrame, fan: int, y: int) -> dict[int, Node]:
        means = _level_means(here, fan, 50, seed + y, seeding, progress, y)
        order = sorted(means)
        shared = here.sparkSession.sparkContext.broadcast((means, {n: i for i, n in enumerate(order)}))

        @F.pandas_udf("node int, label int")
        def begun(v: pd.Series, node: pd.Series) -> pd.DataFrame:
            out, data = np.zeros((len(v), 2), np.int32), learn.matrix_of(v) if len(v) else None
            for own, at in _by_node(node.to_numpy(np.int64)):
                out[at, 0] = shared.value[1][own]
                out[at, 1] = cluster.squared(data[at], shared.value[0][own]).argmin(axis=1)
            return pd.DataFrame(out, columns=["node", "label"])

        rows = here.withColumn("_b", begun("v", "node")).select("m", "v", F.col("_b.node").alias("node"), F.col("_b.label").alias("label"))
        weights = learn.regressor_nodes(rows, len(order), fan, params, rows, max_epoch, progress)
        return {n: Node(weights[i], weights=weights[i]) for i, n in enumerate(order)}

    return _train(df, shape, level_of, base)


def path_probabilities(tree: Tree, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, probabilities of the children taken, shape (rows, levels)) of a tree of regressors."""
    at, out = np.zeros(len(data), np.int64), np.zeros((len(data), len(tree.levels)))
    for y, level in enumerate(tree.levels):
        chosen = np.zeros(len(data), np.int64)
        for node in np.unique(at):
            if node in level:
                rows = np.flatnonzero(at == node)
                p = learn.softmax(data[rows] @ level[node].weights.T)
                chosen[rows] = p.argmax(axis=1)
                out[rows, y] = p.max(axis=1)
        at = at * tree.shape[y] + chosen
    return at, out


def leaf_probabilities(tree: Tree, data: np.ndarray) -> np.ndarray:
    """The softmax of every node of the last level, side by side; nodes without rows give zeros."""
    fan = tree.shape[-1]
    out = np.zeros((len(data), tree.leaves))
    for node, own in tree.levels[-1].items():
        out[:, node * fan : (node + 1) * fan] = learn.softmax(data @ own.weights.T)
    return out
