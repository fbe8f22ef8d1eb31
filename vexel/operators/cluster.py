"""Flat clustering: k-means with its seedings, LBG-U, x-means, k Gaussians, k regressors, self-organising maps, PLSI.

Centroids are few and stay on the driver; every pass over the rows is one job whose tasks add up their own sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, stored
from .agg import covariance_of, moments


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def squared(data: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Squared distances of shape (rows, means), exact zeros for equal vectors."""
    return np.stack([np.einsum("ij,ij->i", data - c, data - c) for c in means], axis=1) if len(means) else np.zeros((len(data), 0))


def assign(df: DataFrame, means: np.ndarray, out: str = "cluster") -> DataFrame:
    """`df` (m, v, ...) with the nearest mean (the first in a tie) and the squared distance `d2`. Nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(means, float))

    @F.pandas_udf("cluster int, d2 double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cluster": np.zeros(0, int), "d2": np.zeros(0)})
        d = squared(_stack(v), shared.value)
        at = d.argmin(axis=1)
        return pd.DataFrame({"cluster": at, "d2": d[np.arange(len(at)), at]})

    return df.withColumn("_n", nearest("v")).withColumn(out, F.col("_n.cluster")).withColumn("d2", F.col("_n.d2")).drop("_n")


@dataclass(frozen=True)
class Sums:
    """What one pass gathers for each mean: counts, sums, squared error and utility (second-best minus best distance)."""

    counts: np.ndarray
    sums: np.ndarray
    error: np.ndarray
    utility: np.ndarray
    moved: int
    gaps: np.ndarray  # rows by how much farther their second-best mean is than their best: place i is from 2 ** ((i - 160) / 4) on


def _gap(d: np.ndarray) -> np.ndarray:
    """How much farther the second-best mean is than the best, of squared distances (rows, means >= 2)."""
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2])
    return two[:, 1] - two[:, 0]


def one_pass(df: DataFrame, means: np.ndarray, before: np.ndarray | None = None) -> Sums:
    """A pass over (v): tasks return one row each. `before` are the means of the pass before, to count rows that move."""
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(means, float), before))
    k, n = means.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, old = shared.value
        counts, sums, error, utility, moved, gaps = np.zeros(k, np.int64), np.zeros((k, n)), np.zeros(k), np.zeros(k), 0, np.zeros(240)
        for batch in batches:
            if not len(batch):
                continue
            data = _stack(batch["v"])
            d = squared(data, now)
            at = d.argmin(axis=1)
            best = d[np.arange(len(at)), at]
            counts += np.bincount(at, minlength=k)
            np.add.at(sums, at, data)
            error += np.bincount(at, best, k)
            if k > 1:
                gaps += np.bincount(np.clip(np.floor(4 * np.log2(np.maximum(_gap(d), 1e-300))) + 160, 0, 239).astype(int), minlength=240)
                d[np.arange(len(at)), at] = np.inf
                utility += np.bincount(at, d.min(axis=1) - best, k)
            if old is not None:
                moved += int((squared(data, old).argmin(axis=1) != at).sum())
        yield pd.DataFrame({"x": [np.concatenate([counts, error, utility, [moved], gaps, sums.ravel()]).tolist()]})

    total = added(df.select("v").mapInPandas(run, "x array<double>"), k * (n + 3) + 241)
    counts, error, utility, rest = np.split(total, [k, 2 * k, 3 * k])
    return Sums(np.rint(counts).astype(np.int64), rest[241:].reshape(k, n), error, utility, int(round(rest[0])), np.rint(rest[1:241]).astype(np.int64))


def added(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' arrays `x`, element by element: added up in Spark, so only `size` numbers reach the driver."""
    cells = parts.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(size)
    out[cells["i"].to_numpy(np.int64)] = cells["x"].to_numpy(float)
    return out


def seed_plus_plus(df: DataFrame, k: int, seed: int = 11, tries: int | None = None) -> np.ndarray:
    """k-means++: each next mean is the best of `tries` rows drawn by squared distance.

    A row is drawn by the largest of u ** (1 / weight) with u a hash of (seed, m): one pass for each draw, no order.
    """
    tries = tries or round(2 + np.log10(max(k, 1)))
    first = df.select("v", F.xxhash64(F.lit(seed), "m").alias("h")).orderBy("h").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    means = [np.array(first[0]["v"], float)]
    for step in range(1, k):
        found = _drawn(df, np.array(means), seed + step, tries)
        if not found:
            means.append(means[-1])
            continue
        costs = _potentials(df, np.array(means), found)
        means.append(found[int(np.argmin(costs))])
    return np.array(means)


def _drawn(df: DataFrame, means: np.ndarray, seed: int, tries: int) -> list[np.ndarray]:
    rows = assign(df.select("m", "v"), means).filter("d2 > 0")
    unit = (F.pmod(F.xxhash64(F.lit(seed), "m"), F.lit(1 << 52)).cast("double") + 1.0) / float((1 << 52) + 1)
    top = rows.select("v", (F.ln(unit) / F.col("d2")).alias("key"), "m").orderBy(F.desc("key"), "m").limit(tries)
    return [np.array(r["v"], float) for r in top.collect()]


def _potentials(df: DataFrame, means: np.ndarray, candidates: list[np.ndarray]) -> np.ndarray:
    shared = df.sparkSession.sparkContext.broadcast((means, np.array(candidates)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, new = shared.value
        total = np.zeros(len(new))
        for batch in batches:
            if len(batch):
                data = _stack(batch["v"])
                total += np.minimum(squared(data, have).min(axis=1)[:, None], squared(data, new)).sum(axis=0)
        yield pd.DataFrame({"x": [total.tolist()]})

    return added(df.select("v").mapInPandas(run, "x array<double>"), len(candidates))


def seed_farthest(df: DataFrame, k: int, seed: int = 11) -> np.ndarray:
    """A drawn row first, then always the row that is farthest from all means so far (the smallest m in a tie)."""
    means = seed_plus_plus(df, 1, seed)
    while 0 < len(means) < k:
        far = assign(df.select("m", "v"), means).orderBy(F.desc("d2"), "m").limit(1).collect()
        means = np.vstack([means, far[0]["v"]])
    return means


def seed_random(k: int, n: int, seed: int = 11, sd: float = 0.1) -> np.ndarray:
    return np.random.default_rng(seed).normal(0.0, sd, (k, n))


@dataclass(frozen=True)
class Clusters:
    means: np.ndarray
    counts: np.ndarray
    error: float
    epochs: int


#: So many rows that lie between clusters are on the driver at most (64 MB at 64 elements), and of a smaller table one in four.
BETWEEN_ROWS = 1 << 17


def lloyd(df: DataFrame, means: np.ndarray, max_epoch: int = 0) -> Clusters:
    """Assign and average until no row moves or for `max_epoch` rounds (0: no bound); an empty cluster keeps its mean.

    The rounds grow with the table, and late ones move few rows. A row cannot move while the means have gone less than half
    of its gap, the difference of its distances from the two nearest. So rows of large gaps stay in the sums of the last pass, and rounds
    go over the few others until a row that was left out could move; then a pass over all rows follows, as it does at the end.
    """
    means, before, epoch = np.asarray(means, float), None, 0
    while True:
        got = one_pass(df, means, before)
        epoch += 1
        if before is not None and got.moved == 0 or max_epoch and epoch >= max_epoch:
            return Clusters(means, got.counts, float(got.error.sum()), epoch)
        before, means = means, _averages(got.counts, got.sums, means)
        reach = 2.0 ** ((int(np.searchsorted(np.cumsum(got.gaps), min(BETWEEN_ROWS, got.counts.sum() // 4), "right")) - 160) / 4)
        if len(means) > 1 and 4 * _gone(before, means) < reach:
            before, means, epoch = _rounds_between(df, got, before, means, epoch, max_epoch, reach)


def _averages(counts: np.ndarray, sums: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)


def _gone(before: np.ndarray, means: np.ndarray) -> float:
    """The farthest way of a mean."""
    return float(np.linalg.norm(means - before, axis=1).max())


def _between(df: DataFrame, means: np.ndarray, reach: float) -> np.ndarray:
    """The rows whose gap is under `reach`."""
    shared = df.sparkSession.sparkContext.broadcast(means)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[_gap(squared(_stack(batch["v"]), shared.value)) < reach]

    rows = df.select(F.col("v").cast("array<double>").alias("v")).mapInPandas(run, "v array<double>").toPandas()
    return _stack(rows["v"]) if len(rows) else np.zeros((0, means.shape[1]))


def _rounds_between(df: DataFrame, got: Sums, anchor: np.ndarray, means: np.ndarray, epoch: int, max_epoch: int, reach: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(means before, means, epoch) after the rounds that only rows with a gap under `reach` at `anchor` take part in. The round of the last
    means is left to a pass over all rows: a row may move in it, or none does."""
    rows = _between(df, anchor, reach)
    d = squared(rows, anchor)
    order = np.argsort(_gap(d), kind="stable")
    rows, d = rows[order], d[order]
    gaps, first, before = _gap(d), d.argmin(axis=1), anchor
    own = first.copy()
    while 2 * (way := _gone(anchor, means)) < reach * (1 - 1e-9) - 1e-12 and not (max_epoch and epoch + 1 >= max_epoch):
        some = int(np.searchsorted(gaps, 2 * way * (1 + 1e-9) + 1e-12, "right"))  # rows of larger gaps are still where they were
        at = first.copy()
        at[:some] = squared(rows[:some], means).argmin(axis=1)
        if (at == own).all():
            break
        own, epoch = at, epoch + 1
        counts, sums, moved = got.counts.copy(), got.sums.copy(), np.flatnonzero(at != first)
        for to, sign in ((at, 1), (first, -1)):
            np.add.at(counts, to[moved], sign)
            np.add.at(sums, to[moved], sign * rows[moved])
        before, means = means, _averages(counts, sums, means)
    return before, means, epoch


def kmeans(df: DataFrame, k: int, max_epoch: int = 0, seed: int = 11) -> Clusters:
    return lloyd(df, seed_plus_plus(df, k, seed), max_epoch)


def lbgu(df: DataFrame, k: int, kmeans_epochs: int = 50, max_epoch: int = 20, seed: int = 11) -> Clusters:
    """K-means, then the mean of least utility moves to the cluster of largest error, as long as the error falls."""
    best = kmeans(df, k, kmeans_epochs, seed)
    for _ in range(max_epoch if k > 1 else 0):
        got = one_pass(df, best.means)
        worst, least = int(np.argmax(got.error)), int(np.argmin(got.utility))
        if worst == least:
            break
        own = stored(assign(df.select("m", "v"), best.means).filter(F.col("cluster") == worst).select("m", "v"), "worst")
        halves = kmeans(own, 2, kmeans_epochs, seed)
        means = best.means.copy()
        means[worst], means[least] = halves.means[0], halves.means[-1]
        new = lloyd(df, means, kmeans_epochs)
        if new.error >= best.error:
            break
        best = new
    return best


def xmeans(df: DataFrame, max_k: int, max_epoch: int = 50, seed: int = 11) -> Clusters:
    """Clusters are cut in two as long as that lowers the Bayesian information criterion, up to `max_k` of them."""

    def criterion(got: Sums, spread: float, n: int) -> float:
        count, c = float(got.counts.sum()), len(got.counts)
        if spread <= 0 or count <= c:
            return np.inf if c > 1 else -np.inf
        parts = got.counts[got.counts > 0].astype(float)
        fit = float(np.sum(parts * np.log2(parts)) - count * np.log2(count) - count * n / 2 * np.log2(2 * np.pi * spread) - (count - c) / 2)
        return -fit + ((c - 1) + c * n + c) / 2 * np.log2(count)

    def spread_of(rows: DataFrame, means: np.ndarray, count: float) -> float:
        if count <= len(means):
            return 0.0
        return float(one_pass(rows, means).error.sum()) / (count - len(means)) / means.shape[1]

    labelled, done = df.select("m", "v"), []
    open_ = [(labelled, one_pass(labelled, seed_plus_plus(df, 1, seed)))]
    while open_:
        rows, whole = open_.pop()
        count = float(whole.counts.sum())
        mean = whole.sums / max(count, 1)
        if len(open_) + len(done) + 2 > max_k or count < 3:
            done.append(mean[0])
            continue
        halves = kmeans(rows, 2, max_epoch, seed)
        cut = one_pass(rows, halves.means)
        n = mean.shape[1]
        if (cut.counts == 0).any() or criterion(cut, spread_of(rows, halves.means, count), n) >= criterion(one_pass(rows, mean), spread_of(rows, mean, count), n):
            done.append(mean[0])
            continue
        for side in (0, 1):
            part = stored(assign(rows.select("m", "v"), halves.means).filter(F.col("cluster") == side).select("m", "v"), "part")
            open_.append((part, one_pass(part, halves.means[side : side + 1])))
    return lloyd(df, np.array(done), 1)


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    count: int

    def log_density(self, data: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Over the eigen directions [first, last); those without variance do not count."""
        last = len(self.values) if last is None else last
        keep = [i for i in range(first, min(last, len(self.values))) if self.values[i] > 1e-12]
        z = (data - self.mean) @ self.vectors[keep].T
        v = self.values[keep]
        return -0.5 * (np.log(2 * v) + z * z / v).sum(axis=1) - 0.5723649 * len(keep)

    def density(self, data: np.ndarray) -> np.ndarray:
        return np.exp(self.log_density(data))


def gaussians(df: DataFrame, key: str, k: int) -> list[Gaussian | None]:
    """A Gaussian for each value 0 .. k - 1 of `key`, from one pass; None where it has no rows."""
    from .linalg import eigen_symmetric

    out: list[Gaussian | None] = [None] * k
    for row in moments(df, key).collect():
        if 0 <= row["key"] < k:
            mean, cov = covariance_of(row["count"], np.array(row["sums"]), np.array(row["products"]))
            values, vectors = eigen_symmetric(cov)
            out[row["key"]] = Gaussian(mean, values, vectors, row["count"])
    return out


def log_scores(models: list[Gaussian | None], data: np.ndarray, npca: int = 0) -> np.ndarray:
    """(rows, classes): log prior + log density in the first `npca` directions (0: two fifths of them)."""
    total = sum(g.count for g in models if g)
    out = np.full((len(data), len(models)), -np.inf)
    for i, g in enumerate(models):
        if g:
            out[:, i] = np.log(g.count / total) + g.log_density(data, 0, npca or max(1, int(0.4 * len(g.mean))))
    return out


def apply_scores(df: DataFrame, score: Callable[[np.ndarray], np.ndarray], out: str = "cluster") -> DataFrame:
    """`df` with the first best column of score(rows)."""

    @F.pandas_udf("int")
    def best(v: pd.Series) -> pd.Series:
        return pd.Series(score(_stack(v)).argmax(axis=1) if len(v) else [], dtype="int32")

    return df.withColumn(out, best("v"))


def gaussian_clusters(df: DataFrame, k: int, npca: int = 0, max_epoch: int = 20, seed: int = 11) -> list[Gaussian | None]:
    """K-means++ seeds, then Gaussians and labels in turn until (nearly) no row changes sides."""
    labelled = assign(df.select("m", "v"), seed_plus_plus(df, k, seed)).select("m", "v", "cluster")
    models = gaussians(labelled, "cluster", k)
    for _ in range(max_epoch):
        counts = [g.count if g else 0 for g in models]
        labelled = apply_scores(df.select("m", "v"), lambda data, own=models: log_scores(own, data, npca))
        models = gaussians(labelled, "cluster", k)
        if [g.count if g else 0 for g in models] == counts:
            break
    return models


def som_start(df: DataFrame, units: int, seed: int = 11) -> np.ndarray:
    """Units drawn evenly between the smallest and the largest value of each element."""
    ends = df.select(F.posexplode("v").alias("n", "x")).groupBy("n").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("n").collect()
    low, high = np.array([r["lo"] for r in ends]), np.array([r["hi"] for r in ends])
    return np.random.default_rng(seed).uniform(0, 1, (units, len(low))) * (high - low) + low


def som(df: DataFrame, rows: int, cols: int, max_epoch: int = 20, seed: int = 11) -> np.ndarray:
    """A batch self-organising map of rows x cols units: every epoch pulls units to the rows of units around them."""
    units = som_start(df, rows * cols, seed)
    y, x = np.divmod(np.arange(rows * cols), cols)
    d2 = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
    for epoch in range(max_epoch):
        radius = max(1.0, 0.6 * max(rows, cols) * np.exp(-3.0 * epoch / max_epoch))
        got = one_pass(df, units)
        weight = np.where(d2 < radius * radius, np.exp(-d2 / (2 * radius * radius)), 0.0)
        mass = weight @ got.counts
        units = np.where(mass[:, None] > 0, (weight @ got.sums) / np.maximum(mass, 1e-12)[:, None], units)
    return units


def _grid_pull(rows: int, cols: int, radius: int) -> np.ndarray:
    """How much each unit of a rows x cols map is drawn to the rows of each other, within the radius."""
    y, x = np.divmod(np.arange(rows * cols), cols)
    d2 = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
    return np.where(d2 < radius * radius, np.exp(-d2 / (2.0 * radius * radius)), 0.0) if radius else np.zeros(d2.shape)


def som_epochs(df: DataFrame, units: np.ndarray, cols: int, begin: int, end: int, max_epoch: int, passes: int = 5, progress: Callable[[int, float], None] | None = None) -> np.ndarray:
    """A map's units (rows * cols, n) after epochs begin .. end - 1 of `max_epoch`, the rule of whole tables.

    In a pass every row draws the units around its nearest one by 40 / (max_epoch * rows of the table); the radius falls
    from 0.6 of the longer side to one. The epoch's number alone says how wide it is, so a run may stop and go on from its
    units. Below about 40 epochs steps overshoot.
    """
    units = np.array(units, float)
    rows = len(units) // cols
    side = 0.6 * max(rows, cols)
    for epoch in range(begin, end):
        pull = _grid_pull(rows, cols, int(side * np.exp(-epoch * np.log(side) / max_epoch)))
        for _ in range(passes):
            got = one_pass(df, units)
            total = int(got.counts.sum())
            if not total:
                return units
            units = units + 40.0 / (max_epoch * total) * (pull @ got.sums - (pull @ got.counts)[:, None] * units)
        if progress:
            progress(epoch, float(got.error.sum() / total))
    return units


@dataclass(frozen=True)
class SomStream:
    """Rows dealt into `parts` micro-batches by a hash of (seed, m): files of the shared folder, a folder for each part."""

    rows: DataFrame
    parts: int
    total: int
    seed: int

    def order(self, epoch: int, turn: int) -> list[int]:
        """The order of the parts in a pass, drawn anew for each."""
        return np.random.default_rng([self.seed, epoch, turn]).permutation(self.parts).tolist()

    def close(self) -> None:
        discard(self.rows)


def som_stream(df: DataFrame, parts: int = 16, seed: int = 11) -> SomStream:
    """Deals all rows of (m, v) for `som_online`. Parts are split over tasks by a million rows."""
    total = df.count()
    salts = max(1, -(-total // (parts * 1_000_000)))
    part = F.pmod(F.xxhash64(F.lit(seed), "m"), F.lit(parts)).cast("int")
    salt = F.pmod(F.xxhash64("m", F.lit(seed)), F.lit(salts))
    dealt = df.select("v", part.alias("part"), salt.alias("salt")).repartition("part", "salt").drop("salt")
    return SomStream(stored(dealt, "som", by="part"), parts, total, seed)


def som_online(data: SomStream, units: np.ndarray, cols: int, begin: int, end: int, max_epoch: int, passes: int = 5, rate: float = 0.1, progress: Callable[[int, float], None] | None = None) -> np.ndarray:
    """A map's units after epochs begin .. end - 1 of `max_epoch`, moved after every micro-batch.

    All rows of a micro-batch find their nearest units in one job over its own files. A unit then goes to the weighted mean
    of the rows around it by 1 - (1 - rate / rows of the table) ** (sum of their weights), which is where it comes to when
    they draw it one after the other. The radius begins at the longer side. Order and radius follow from the epoch's number, so two
    ranges of epochs give what one run gives.
    """
    units = np.array(units, float)
    rows = len(units) // cols
    fall = np.log(0.5 * cols) / max_epoch
    for epoch in range(begin, end):
        pull = _grid_pull(rows, cols, int(max(rows, cols) * np.exp(-epoch * fall)))
        error = 0.0
        for turn in range(passes if data.total else 0):
            error = 0.0
            for part in data.order(epoch, turn):
                got = one_pass(data.rows.filter(F.col("part") == part), units)
                mass = pull @ got.counts
                share = 1 - (1 - min(rate / data.total, 1.0)) ** mass
                units = units + share[:, None] * np.where(mass[:, None] > 0, (pull @ got.sums) / np.maximum(mass, 1e-300)[:, None] - units, 0.0)
                error += got.error.sum()
        if progress:
            progress(epoch, float(error / max(data.total, 1)))
    return units


@dataclass(frozen=True)
class Topics:
    """PLSI: P(z) as numbers; P(d | z) and P(w | z) as tables (d, p) and (w, p) with an element of `p` for each topic."""

    z: np.ndarray
    d: DataFrame
    w: DataFrame


def _drawn_shares(keys: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, p): shares between a half and one by a hash, the same in any partitioning."""
    unit = lambda z: F.pmod(F.xxhash64(F.lit(seed), F.lit(key), key, z), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return keys.select(key).filter(F.col(key).isNotNull()).distinct().select(key, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda z: unit(z) * 0.5 + 0.5).alias("p"))


def _summed(df: DataFrame, k: int) -> np.ndarray:
    """The k sums over the rows of an array column `p`."""
    got = df.agg(*(F.sum(F.get("p", F.lit(i))).alias(str(i)) for i in range(k))).first()
    return np.array([x or 0.0 for x in got])


def _scaled(df: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    return df.select(key, F.zip_with("p", F.array(*(F.lit(float(x)) for x in by)), lambda p, x: F.try_divide(p, x)).alias("p"))


def plsi(counts: DataFrame, k: int, steps: int = 30, seed: int = 11, start: tuple[DataFrame, DataFrame] | None = None) -> Topics:
    """Tempered EM (exponent 1000 / (1000 + step)) over (d, w, n), one row for each pair of a document and a word.

    P(d | z) and P(w | z) are tables of the shared folder; a step joins the counts with both and sums the shares of the
    topics by document and by word. Only P(z), k numbers, reaches the driver. `start` are unscaled tables (d, p) and (w, p)
    to begin with. Rows whose d, w or n is null do not count; of an empty table both tables are empty and P(z) is even.
    """
    counts = counts.select("d", "w", F.col("n").cast("double").alias("n")).filter(F.col("d").isNotNull() & F.col("w").isNotNull() & F.col("n").isNotNull())
    tables = dict(zip("dw", start or (_drawn_shares(counts, "d", k, seed), _drawn_shares(counts, "w", k, seed))))
    tables = {key: stored(df, f"plsi-{key}") for key, df in tables.items()}
    mass = {key: _summed(df, k) for key, df in tables.items()}
    z = np.full(k, 1 / k)
    for step in range(steps if mass["d"].any() else 0):
        beta = 1000.0 / (1000.0 + step)
        own = {key: _scaled(tables[key], key, mass[key]).withColumnRenamed("p", f"p{key}") for key in "dw"}
        prior = F.array(*(F.lit(float(x)) for x in z))
        share = F.zip_with(prior, F.zip_with("pd", "pw", lambda a, b: F.pow(a * b, F.lit(beta))), lambda a, b: a * b)
        new = {}
        for last, other in (("d", "w"), ("w", "d")):
            # The table of the key that is summed by is joined last, so its partitioning serves the sums too.
            joined = counts.join(own[other], other).join(own[last], last).select(last, "n", share.alias("s"))
            part = joined.withColumn("t", F.greatest(F.aggregate("s", F.lit(0.0), lambda a, b: a + b), F.lit(1e-300)))
            new[last] = stored(part.groupBy(last).agg(F.array(*(F.sum(F.col("n") * F.get("s", F.lit(i)) / F.col("t")) for i in range(k))).alias("p")), f"plsi-{last}")
        discard(*tables.values())
        tables, mass = new, {key: _summed(df, k) for key, df in new.items()}
        z = mass["d"] / max(mass["d"].sum(), 1e-300)
    return Topics(z, *(_scaled(tables[key], key, mass[key]) for key in "dw"))
