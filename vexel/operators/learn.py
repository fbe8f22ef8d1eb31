"""Supervised learners over (m, v, label).

Training goes over all rows: gradients are sums that tasks begin and Spark ends (`gradient`), order-dependent learners
train in chunks whose results are merged. Models are small and stay on the driver. Prediction is a pandas UDF with the
model broadcast, so it scales with the rows. Every trainer takes a `progress` that is called after each epoch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, stored
from . import vector_index
from .cluster import added, apply_scores, assign, gaussians, kmeans, log_scores
from .gradient import Adam, Progress, descend, drawn, matrix_of, totals
from .linalg import principal_components

BATCH = 32


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


# Softmax regression.
@dataclass(frozen=True)
class SoftmaxParams:
    max_epoch: int = 20
    rate: float = 0.5
    penalty: str = "none"  # none, l1 or l2
    strength: float = 0.0
    auto_balance: bool = True


@dataclass
class Softmax:
    weights: np.ndarray  # classes x elements, no bias

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        return softmax(data @ self.weights.T)

    def scores(self, data: np.ndarray) -> np.ndarray:
        return data @ self.weights.T


def _softmax_kernel(batch: pd.DataFrame, shared: tuple) -> np.ndarray:
    """Of each node the error and the gradient of its weights, over the rows that are in it and of a label."""
    weights, balance = shared
    error, grad = np.zeros(len(weights)), np.zeros(weights.shape)
    data, labels, nodes = matrix_of(batch["v"]), batch["label"].to_numpy(int), batch["node"].to_numpy(int)
    for node in np.unique(nodes):
        at = np.flatnonzero(nodes == node)
        x, y = data[at], labels[at]
        p = softmax(x @ weights[node].T)
        own = p[np.arange(len(at)), y]
        error[node] -= np.log(np.maximum(own, 1e-12)).sum()
        p[np.arange(len(at)), y] -= 1
        grad[node] += (p * (balance[node][y] * (own < 0.99))[:, None]).T @ x
    return np.concatenate([error, grad.ravel()])


def softmax_nodes(rows: DataFrame, nodes: int, k: int, params: SoftmaxParams = SoftmaxParams(), start: np.ndarray | None = None, progress: Progress | None = None) -> np.ndarray:
    """Weights (nodes, k, elements) of a regressor for each node, all trained by the same jobs, one for each epoch.

    rows (v, label, node) with labels 0 .. k - 1 and nodes 0 .. nodes - 1. Gradients are summed over all rows of a node; the step has
    momentum 0.9 and goes by `rate` over the mean squared length of the node's rows. Rows that are sure already (0.99) do
    not pull. A node whose error rises goes slower from there; one without rows keeps zeros.
    """
    facts = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("s"), F.max(F.size("v")).alias("size")).collect()
    if not facts:
        return np.zeros((nodes, k, 0))
    counts, length, width = np.zeros((nodes, k)), np.zeros(nodes), max(r["size"] for r in facts)
    for r in facts:
        counts[r["node"], r["label"]] += r["n"]
        length[r["node"]] += r["s"]
    size = np.maximum(counts.sum(axis=1), 1)
    most = counts.max(axis=1, keepdims=True)
    balance = (np.log(3 + most) / np.log(3 + counts)) ** 2 if params.auto_balance else np.ones((nodes, k))
    rate = params.rate / np.maximum(length / size, 1e-12)
    w = np.zeros((nodes, k, width)) if start is None else np.array(start, float)
    v, slow, last = np.zeros_like(w), np.ones(nodes), np.full(nodes, np.inf)
    for epoch in range(params.max_epoch):
        got = totals(rows.select("v", "label", "node"), _softmax_kernel, (w, balance), nodes * (1 + k * width))
        error, grad = got[:nodes] / size, got[nodes:].reshape(w.shape)
        worse = error > last
        slow, v = slow + worse, v * ~worse[:, None, None]
        own = (rate / slow)[:, None, None]
        v = 0.9 * v - own * grad / size[:, None, None]
        w = w + v
        if params.penalty == "l2":
            w *= 1 - params.rate * params.strength
        elif params.penalty == "l1":
            w = np.sign(w) * np.maximum(np.abs(w) - params.rate * params.strength / (1 + epoch), 0)
        last = error
        if progress:
            progress(epoch, float((error * size).sum() / size.sum()))
        if (error < 1e-7).all():
            break
    return w


def softmax_regression(df: DataFrame, k: int, params: SoftmaxParams = SoftmaxParams(), start: np.ndarray | None = None, progress: Progress | None = None) -> Softmax:
    """A regressor of the labels from all rows (`softmax_nodes` with one node); `start` are weights to begin with."""
    rows = df.select("v", "label", F.lit(0).alias("node"))
    return Softmax(softmax_nodes(rows, 1, k, params, None if start is None else start[None], progress)[0])


def regressor_nodes(rows: DataFrame, nodes: int, k: int, params: SoftmaxParams, labels: DataFrame, max_epoch: int, progress: Progress | None = None) -> np.ndarray:
    """Regressors that label their own rows, for all nodes at once: from `labels` (m, v, node, label), a regressor and its own labels in
    turn until 0.1 % of the rows move. rows has (m, v, node)."""
    held = stored(labels.select("m", "v", "node", "label"), "labels")
    weights = softmax_nodes(held, nodes, k, SoftmaxParams(10, params.rate, params.penalty, params.strength, True))
    for epoch in range(max_epoch if weights.shape[2] else 0):
        shared = rows.sparkSession.sparkContext.broadcast(weights)

        @F.pandas_udf("int")
        def own(v: pd.Series, node: pd.Series) -> pd.Series:
            out, data, at = np.zeros(len(v), np.int32), matrix_of(v) if len(v) else None, node.to_numpy(int)
            for n in np.unique(at):
                out[at == n] = (data[at == n] @ shared.value[n].T).argmax(axis=1)
            return pd.Series(out)

        again = stored(held.withColumn("before", F.col("label")).withColumn("label", own("v", "node")), "labels")
        moved = again.agg(F.avg((F.col("before") != F.col("label")).cast("double"))).first()[0] or 0.0
        discard(held)
        held = again
        weights = softmax_nodes(held, nodes, k, params)
        if progress:
            progress(epoch, moved)
        if epoch and moved < 0.001:
            break
    discard(held)
    return weights


def kmeans_regression(df: DataFrame, k: int, params: SoftmaxParams = SoftmaxParams(), max_epoch: int = 5, seed: int = 11, progress: Progress | None = None) -> Softmax:
    """Clusters by regressors: k-means labels to start with, then a regressor and its own labels in turn until 0.1 % move."""
    if not df.head(1):
        return Softmax(np.zeros((k, 0)))
    rows = df.select("m", "v", F.lit(0).alias("node"))
    labels = assign(rows, kmeans(df, k, 50, seed).means).withColumn("label", F.col("cluster"))
    return Softmax(regressor_nodes(rows, 1, k, params, labels, max_epoch, progress)[0])


# Confidence-weighted linear models (AROW), one against the rest.
@dataclass
class Arow:
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, data: np.ndarray) -> np.ndarray:
        s = data @ self.weights.T + self.bias
        return np.concatenate([s, -s], axis=1) if len(self.weights) == 1 else s


def arow_pass(w: np.ndarray, precision: np.ndarray, data: np.ndarray, labels: np.ndarray, classes: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(w, precision) of all classes after one pass over rows in their order. The last element of both is the bias, of input 1.

    A row whose margin is under 1 moves the weights by its shortfall over its own variance plus r, and adds x * x / r to the precision."""
    w, precision = w.copy(), precision.copy()
    for x, label in zip(np.hstack([data, np.ones((len(data), 1))]), labels):
        y = np.where(classes == label, 1.0, -1.0)
        short = 1 - y * (w @ x)
        at = np.flatnonzero(short > 0)
        if len(at):
            spread = x / precision[at]
            w[at] += (short[at] * y[at] / (spread @ x + r))[:, None] * spread
            precision[at] += x * x / r
    return w, precision


def arow_merged(w: np.ndarray, precision: np.ndarray, parts: int, weighted: np.ndarray, precisions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `parts` passes from the same (w, precision) come to together, by the sums of their precisions and of precision * w.

    Each adds what it learned, precision above the start's, to the start; weights are the precision-weighted mean."""
    total = precision + (precisions - parts * precision)
    return (precision * w + (weighted - parts * precision * w)) / total, total


def arow(df: DataFrame, k: int, r: float = 0.1, epochs: int = 5, seed: int = 11, chunk_rows: int = 10_000, progress: Progress | None = None) -> Arow:
    """Confidence-weighted linear classifiers of all labels; of two classes one weight vector is enough.

    Rows are dealt by a hash of m into chunks of about `chunk_rows`, so their number grows with the table and no class is one
    group. In an epoch every chunk passes over its own rows, in the order of another hash, from the same weights; what the chunks
    learned is summed element by element and merged (`arow_merged`). The result does not depend on the partitioning.
    """
    rows = df.select("m", "v", "label")
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).first()
    classes = np.arange(1 if k == 2 else k)
    n = (first["size"] or 0) + 1
    w, precision = np.zeros((len(classes), n)), np.ones((len(classes), n))
    parts = max(1, -(-first["n"] // chunk_rows))
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(seed), "m"), F.lit(parts)))
    for epoch in range(epochs if first["n"] else 0):
        shared = df.sparkSession.sparkContext.broadcast((w, precision))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            order = np.lexsort((frame["m"].to_numpy(), drawn(seed, epoch, frame["m"].to_numpy(), 1)[:, 0]))
            own, sure = arow_pass(*shared.value, matrix_of(frame["v"])[order], frame["label"].to_numpy(int)[order], classes, r)
            return pd.DataFrame({"x": [np.concatenate([[1.0], (own * sure).ravel(), sure.ravel()])]})

        got = added(dealt.groupBy("_chunk").applyInPandas(run, "x array<double>"), 1 + 2 * w.size)
        w, precision = arow_merged(w, precision, int(round(got[0])), got[1 : 1 + w.size].reshape(w.shape), got[1 + w.size :].reshape(w.shape))
        if progress:
            progress(epoch, float(np.abs(w).mean()))
    return Arow(w[:, :-1], w[:, -1])


# Gaussian Bayes.
@dataclass
class Bayes:
    models: list
    npca: int = 0

    def scores(self, data: np.ndarray) -> np.ndarray:
        return log_scores(self.models, data, self.npca)


def naive_bayes(df: DataFrame, k: int, npca: int = 0) -> Bayes:
    """One full-covariance Gaussian for each label, all from one pass over the rows."""
    return Bayes(gaussians(df, "label", k), npca)


# Perceptron with one hidden layer.
@dataclass
class Mlp:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    dropout: float = 0.0
    noise: float = 0.0

    def hidden(self, data: np.ndarray) -> np.ndarray:
        return sigmoid((1 - self.noise) * (data @ self.w1) + self.b1 / BATCH)

    def scores(self, data: np.ndarray) -> np.ndarray:
        return (1 - self.dropout) * (self.hidden(data) @ self.w2) + self.b2

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        return softmax(self.scores(data))

    def regression(self, data: np.ndarray) -> np.ndarray:
        return sigmoid(data @ self.w1 + self.b1 / BATCH) @ self.w2 + self.b2


def new_mlp(n: int, length: float, hidden: int, k: int, rng: np.random.Generator, dropout: float = 0.0, noise: float = 0.0) -> Mlp:
    """Small random weights for rows of n elements and mean length `length`."""
    scale = 1 / (max(length, 1e-6) * np.sqrt(0.8 * (hidden + 1)))
    return Mlp(rng.uniform(-1, 1, (n, hidden)) * scale, np.zeros(hidden), rng.uniform(-1, 1, (hidden, k)) / np.sqrt(hidden + 1), np.zeros(k), dropout, noise)


def gaussian_blobs(height: int, width: int, depth: int, hidden: int, variance: float, rng: np.random.Generator) -> np.ndarray:
    """Input weights shaped as a random blob on a height x width grid for each hidden unit."""
    y, x = np.mgrid[0:height, 0:width]
    out = np.zeros((height * width * depth, hidden))
    for j in range(hidden):
        cy, cx = rng.uniform(0, height), rng.uniform(0, width)
        blob = np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * variance))
        out[:, j] = (blob[:, :, None] * rng.uniform(-1, 1, depth)).ravel()
    return out


def mlp_gradient(weights: list[np.ndarray], x: np.ndarray, t: np.ndarray, linear: bool = False, keep_x: np.ndarray | None = None, keep_h: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
    """(error, gradients of w1, b1, w2, b2), summed over the rows; keep_x and keep_h are 0 where noise and dropout blank an element."""
    w1, b1, w2, b2 = weights
    x = x if keep_x is None else x * keep_x
    h = sigmoid(x @ w1 + b1 / BATCH)
    h = h if keep_h is None else h * keep_h
    out = h @ w2 + b2
    out = out if linear else softmax(out)
    error = 0.5 * ((out - t) ** 2).sum() if linear else -(t * np.log(np.maximum(out, 1e-12))).sum()
    delta = out - t
    back = (delta @ w2.T) * h * (1 - h)
    return float(error), [x.T @ back, back.sum(axis=0) / BATCH, h.T @ delta, delta.sum(axis=0)]


def train_mlp(rows: DataFrame, net: Mlp, epochs: int, rate: float, seed: int, linear: bool = False, progress: Progress | None = None) -> Mlp:
    """`net` after `epochs` steps over all rows (m, v, t); the output layer decays a little."""
    noise, dropout = net.noise, net.dropout

    def gradient(weights: list[np.ndarray], batch: pd.DataFrame, epoch: int) -> tuple:
        x, m = matrix_of(batch["v"]), batch["m"].to_numpy()
        keep_x = drawn(seed, 2 * epoch, m, x.shape[1]) >= noise if noise else None
        keep_h = drawn(seed, 2 * epoch + 1, m, weights[2].shape[0]) >= dropout if dropout else None
        error, parts = mlp_gradient(weights, x, matrix_of(batch["t"]), linear, keep_x, keep_h)
        return error, len(batch), parts

    got = descend(rows.select("m", "v", "t"), [net.w1, net.b1, net.w2, net.b2], gradient, epochs, Adam(rate), [0.0, 0.0, 5e-4, 0.0], progress)
    return Mlp(*got.weights, net.dropout, net.noise)


def one_hot(labels: np.ndarray, k: int) -> np.ndarray:
    """A row of zeros for a negative label."""
    out = np.zeros((len(labels), k))
    have = labels >= 0
    out[np.flatnonzero(have), labels[have]] = 1
    return out


def _shape_of(df: DataFrame) -> tuple[int, float]:
    """(elements, mean length) of the vectors."""
    got = df.agg(F.max(F.size("v")), F.avg(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    return got[0] or 0, got[1] or 0.0


def _one_hot(label: Column, k: int) -> Column:
    """1 at the label's place; zeros for a negative or null one."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce((i == label).cast("double"), F.lit(0.0)))


def mlp(df: DataFrame, k: int, hidden: int = 64, epochs: int = 50, rate: float = 0.05, dropout: float = 0.0, noise: float = 0.0, seed: int = 11, encoder: Dae | None = None, progress: Progress | None = None) -> Mlp:
    """A perceptron of the labels, from all rows; `encoder` lends its weights to the input layer."""
    n, length = _shape_of(df)
    net = new_mlp(n, length, encoder.w.shape[1] if encoder else hidden, k, np.random.default_rng(seed), dropout, noise)
    if encoder:
        net.w1, net.b1 = encoder.w.copy(), encoder.b * BATCH
    return train_mlp(df.select("m", "v", _one_hot(F.col("label"), k).alias("t")), net, epochs, rate, seed, progress=progress)


def mlp_targets(df: DataFrame, net: Mlp, input_rate: float, hidden_rate: float, start_epoch: int, end_epoch: int, seed: int = 11, progress: Progress | None = None) -> tuple[Mlp, float]:
    """(`net` after the epochs start_epoch .. end_epoch - 1 over all rows (m, v, label, t), share of rows told right in the last one).

    Targets `t` are the caller's own (soft labels, costs), and each layer has its rate. Noise and dropout belong to the number of
    the epoch, so a training can be cut into ranges; a step's running means begin anew with each range.
    """
    start = [net.w1, net.b1, net.w2, net.b2]
    rates = np.concatenate([np.full(a.size, r) for a, r in zip(start, (input_rate, input_rate, hidden_rate, hidden_rate))])
    step, right = Adam(rates), []

    def gradient(weights: list[np.ndarray], batch: pd.DataFrame, epoch: int) -> tuple:
        x, m = matrix_of(batch["v"]), batch["m"].to_numpy()
        keep_x = drawn(seed, 2 * (start_epoch + epoch), m, x.shape[1]) >= net.noise if net.noise else None
        keep_h = drawn(seed, 2 * (start_epoch + epoch) + 1, m, weights[2].shape[0]) >= net.dropout if net.dropout else None
        error, parts = mlp_gradient(weights[:4], x, matrix_of(batch["t"]), False, keep_x, keep_h)
        told = Mlp(*weights[:4], net.dropout, net.noise).scores(x).argmax(axis=1) == batch["label"].to_numpy(int)
        return error, len(batch), [*parts, np.array([told.sum()], float)]

    def own_step(weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        right.append(float(gradient[-1]))
        return np.append(step(weights[:-1], gradient[:-1]), 0.0)

    got = descend(df.select("m", "v", "label", "t"), [*start, np.zeros(1)], gradient, end_epoch - start_epoch, own_step, [0.0, 0.0, 5e-4, 0.0, 0.0], progress)
    return Mlp(*got.weights[:4], net.dropout, net.noise), right[-1] if right else 0.0


def mlp_regression(df: DataFrame, target: str, hidden: int = 32, epochs: int = 100, rate: float = 0.02, seed: int = 11, progress: Progress | None = None) -> Mlp:
    """A perceptron with linear outputs for the array column `target`, from all rows."""
    n, length = _shape_of(df)
    k = df.agg(F.max(F.size(target))).first()[0] or 0
    return train_mlp(df.select("m", "v", F.col(target).alias("t")), new_mlp(n, length, hidden, k, np.random.default_rng(seed)), epochs, rate, seed, linear=True, progress=progress)


@dataclass
class Bagging:
    """Several perceptrons; probabilities are averaged."""

    nets: list

    def scores(self, data: np.ndarray) -> np.ndarray:
        return np.mean([net.probabilities(data) for net in self.nets], axis=0)


# Denoising autoencoder with tied weights.
@dataclass
class Dae:
    w: np.ndarray
    b: np.ndarray
    c: np.ndarray
    linear: bool = False

    def encode(self, data: np.ndarray) -> np.ndarray:
        return sigmoid(data @ self.w + self.b)

    def decode(self, hidden: np.ndarray) -> np.ndarray:
        out = hidden @ self.w.T + self.c
        return out if self.linear else sigmoid(out)


def dae_gradient(net: Dae, x: np.ndarray, keep: np.ndarray | None = None, active: np.ndarray | None = None, sparsity: float = 0.0) -> tuple[float, list[np.ndarray]]:
    """(squared error, gradients of w, b, c, sums of the codes), summed over the rows; `keep` is 0 where noise blanks an element, `active` the
    mean codes that are drawn towards `sparsity`."""
    bad = x if keep is None else x * keep
    h = net.encode(bad)
    y = net.decode(h)
    out = (y - x) if net.linear else (y - x) * y * (1 - y)
    back = out @ net.w
    if sparsity > 0:
        back = back + 0.25 * ((1 - sparsity) / np.maximum(1 - active, 1e-3) - sparsity / np.maximum(active, 1e-3))
    back = back * h * (1 - h)
    return float(((y - x) ** 2).sum()), [bad.T @ back + out.T @ h, back.sum(axis=0), out.sum(axis=0), h.sum(axis=0)]


def dae(df: DataFrame, hidden: int, epochs: int = 30, rate: float = 0.02, noise: float = 0.2, sparsity: float = 0.0, linear: bool = True, seed: int = 11, progress: Progress | None = None) -> Dae:
    """A denoising autoencoder with tied weights, from all rows. The mean codes that sparsity needs are those of the epoch before."""
    n, length = _shape_of(df)
    scale = 1 / (max(length, 1e-6) * np.sqrt(0.8 * (hidden + 1)))
    start = [np.random.default_rng(seed).uniform(-1, 1, (n, hidden)) * scale, np.zeros(hidden), np.zeros(n), np.full(hidden, max(sparsity, 1e-3))]

    def gradient(weights: list[np.ndarray], batch: pd.DataFrame, epoch: int) -> tuple:
        x = matrix_of(batch["v"])
        keep = drawn(seed, epoch, batch["m"].to_numpy(), x.shape[1]) >= noise if noise else None
        error, parts = dae_gradient(Dae(*weights[:3], linear), x, keep, weights[3], sparsity)
        return error, len(batch), parts

    step, size = Adam(rate), sum(a.size for a in start[:3])

    def own_step(weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        return np.concatenate([step(weights[:size], gradient[:size]), gradient[size:]])  # the last are no weights but the new mean codes

    got = descend(df.select("m", "v"), start, gradient, epochs, own_step, [5e-4 if sparsity > 0 else 0.0, 0.0, 0.0, 0.0], progress)
    return Dae(*got.weights[:3], linear)


# Large-margin metric learning.
@dataclass
class Metric:
    matrix: np.ndarray

    def project(self, data: np.ndarray) -> np.ndarray:
        return data @ self.matrix.T


def lmca_scatter(L: np.ndarray, x: np.ndarray, label: int, targets: np.ndarray, near: np.ndarray, labels: np.ndarray, margin: float, push: float) -> np.ndarray:
    """What one row adds to the scatter matrix: its targets pull; rows of other labels among `near` push where they come closer than a target and the margin."""
    u, w = x - targets, x - near
    inside = (labels != label)[None, :] & (((u @ L.T) ** 2).sum(axis=1)[:, None] + margin > ((w @ L.T) ** 2).sum(axis=1)[None, :])
    pull = (1 - push) + push * inside.sum(axis=1)
    return (u * pull[:, None]).T @ u - push * ((w * inside.sum(axis=0)[:, None]).T @ w)


def lmca_step(L: np.ndarray, old: np.ndarray, scatter: np.ndarray, rate: float, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """(L, step) after a round: momentum 0.5, the gradient scaled to 0.5, the longest row scaled to one."""
    g = L @ (np.diag(np.diag(scatter)) if diagonal else scatter)
    g *= 0.5 / max(np.abs(g).max(), 1e-12)
    old = 0.5 * old + rate * g
    L = L - old
    return L / max(np.linalg.norm(L, axis=1).max(), 1e-12), old


def _neighbours(found: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """(m, name): the vectors and labels of the rows found for each row; at most k of them."""
    there = rows.select(F.col("m"), F.col("v").alias("nv"), F.col("label").alias("nl"))
    return found.join(there, "m").groupBy("qid").agg(F.collect_list(F.struct("nv", "nl")).alias(name)).withColumnRenamed("qid", "m")


def lmca(df: DataFrame, dims: int, k: int = 3, k_near: int = 10, margin: float = 0.5, push: float = 0.5, rate: float = 0.1, rounds: int = 10, start: str = "pca", diagonal: bool = False, seed: int = 11, cells: int = 16, cell_rows: int = 1_000, progress: Progress | None = None) -> Metric:
    """A linear map into `dims` dimensions that keeps each row's `k` nearest of its own label near and others out of the margin; all rows train.

    Target neighbours come from an index (`vector_index`) whose lists are kept apart by label; in a round the `k_near` nearest of
    every row in the mapped space come from an index of that space. Both are exact joins. A space of up to four dimensions has a cell
    for `cell_rows` rows (at most 1,024), as a query needs few of its cells; with more dimensions it would need most of them, and there are `cells`.
    Each row, with what it found, adds to one scatter matrix: tasks sum their rows, Spark the tasks. Rows whose label is null do not train.
    """
    rows = stored(df.select("m", "v", F.col("label").cast("int").alias("label")).filter("v is not null and label is not null"), "metric")
    n, _ = _shape_of(rows)
    if start == "pca":
        matrix = principal_components(rows, dims).vectors if n else np.zeros((dims, 0))
    elif start == "cov":
        cov = principal_components(rows).cov
        matrix = cov[np.argsort(-np.linalg.norm(cov, axis=1), kind="stable")[:dims]]
    elif start == "random":
        matrix = np.random.default_rng(seed).normal(size=(dims, n))
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    else:
        matrix = np.eye(dims, n)
    if not n:
        return Metric(matrix)
    own = vector_index.build(rows, cells, group="label", max_epoch=3, seed=seed)
    found = vector_index.search(own, rows.select(F.col("m").alias("qid"), "v", F.col("label").alias("g")), k, max(1, cells // 4), exact=True, exclude_self=True)
    targets = stored(_neighbours(found, rows, "targets"), "targets")
    own.close()
    old = np.zeros_like(matrix)
    fine = max(cells, min(rows.count() // cell_rows, 1024)) if dims <= 4 else cells

    def kernel(batch: pd.DataFrame, L: np.ndarray) -> np.ndarray:
        out = np.zeros((n, n))
        for x, label, pulled, near in zip(batch["v"], batch["label"], batch["targets"], batch["near"]):
            some = lambda found: np.array([f["nv"] for f in found], float)
            out += lmca_scatter(L, np.asarray(x, float), label, some(pulled), some(near), np.array([f["nl"] for f in near]), margin, push)
        return out.ravel()

    for step in range(rounds):
        mapped = stored(transform(rows, Metric(matrix).project), "mapped")
        space = vector_index.build(mapped, fine, max_epoch=3, seed=seed)
        near = vector_index.search(space, mapped.select(F.col("m").alias("qid"), "v"), k_near, max(1, cells // 4) if fine == cells else 2, exact=True, exclude_self=True)
        met = rows.join(targets, "m").join(_neighbours(near, rows, "near"), "m")
        scatter = totals(met.select("v", "label", "targets", "near"), kernel, matrix, n * n).reshape(n, n)
        space.close()
        discard(mapped)
        matrix, old = lmca_step(matrix, old, scatter, rate - 0.5 * rate * step / rounds, diagonal)
        if progress:
            progress(step, float(np.abs(scatter).mean()))
    discard(rows, targets)
    return Metric(matrix)


def predict(df: DataFrame, model, out: str = "predicted") -> DataFrame:
    """`df` with the best class of model.scores for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return apply_scores(df, lambda data: shared.value.scores(data), out)


def transform(df: DataFrame, function: Callable[[np.ndarray], np.ndarray], out: str = "v") -> DataFrame:
    """`df` with function(rows) as a vector column: encodings, projections, probabilities, hidden layers."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(function(np.stack(v.to_numpy()).astype(float))) if len(v) else [], dtype=object)

    return df.withColumn(out, run("v"))


def accuracy(df: DataFrame, predicted: str = "predicted", label: str = "label") -> float:
    return float(df.agg(F.avg((F.col(predicted) == F.col(label)).cast("double"))).first()[0])
