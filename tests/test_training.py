"""Distributed training: gradients, merges and trees against NumPy, in any partitioning."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.harness import compare
from vexel.operators import agg, cluster, gradient, knn, learn, tree, vector_index
from vexel.plans import catalog, learn_queries
from vexel.plans.cluster_queries import blobs


def arrays(df):
    rows = df.orderBy("m").collect()
    return np.array([r["v"] for r in rows], float), np.array([r["label"] for r in rows], int)


@pytest.mark.parametrize("fit", [
    lambda df: [learn.softmax_regression(df, 4, learn.SoftmaxParams(12)).weights],
    lambda df: (lambda n: [n.w1, n.b1, n.w2, n.b2])(learn.mlp(df, 4, hidden=6, epochs=8, dropout=0.2, noise=0.2)),
    lambda df: (lambda n: [n.w, n.b, n.c])(learn.dae(df, 5, epochs=8, sparsity=0.1)),
    lambda df: (lambda n: [n.weights, n.bias])(learn.arow(df, 4, epochs=2, chunk_rows=30)),
])
def test_same_weights_in_any_partitioning(spark, fit):
    df = blobs(spark, each=40)
    one, many = fit(df.coalesce(1)), fit(df.repartition(7, "label").sortWithinPartitions(F.desc("m")))
    assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(one, many))


def test_gradients_are_slopes_of_the_error():
    rng = np.random.default_rng(1)
    x, t = rng.normal(size=(9, 5)), np.eye(3)[rng.integers(0, 3, 9)]
    for linear in (False, True):
        w = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=(4, 3)), rng.normal(size=3)]
        _, parts = learn.mlp_gradient(w, x, t, linear)
        for k, a in enumerate(w):
            for at in itertools.islice(np.ndindex(a.shape), 6):
                up, down = [b.copy() for b in w], [b.copy() for b in w]
                up[k][at] += 1e-6
                down[k][at] -= 1e-6
                slope = (learn.mlp_gradient(up, x, t, linear)[0] - learn.mlp_gradient(down, x, t, linear)[0]) / 2e-6
                assert abs(slope - parts[k][at]) < 1e-5
    net = learn.Dae(rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=5), True)
    _, (gw, *_) = learn.dae_gradient(net, x)
    up, down = net.w.copy(), net.w.copy()
    up[2, 1] += 1e-6
    down[2, 1] -= 1e-6
    slope = (learn.dae_gradient(learn.Dae(up, net.b, net.c, True), x)[0] - learn.dae_gradient(learn.Dae(down, net.b, net.c, True), x)[0]) / 2e-6
    assert abs(slope / 2 - gw[2, 1]) < 1e-5  # the error is the square, the gradient that of half of it


def test_merge_of_two_passes_by_hand():
    w, p = np.array([[1.0, 0.0]]), np.array([[2.0, 1.0]])
    a, b = (np.array([[2.0, 1.0]]), np.array([[5.0, 3.0]])), (np.array([[0.0, 4.0]]), np.array([[3.0, 2.0]]))
    got, sure = learn.arow_merged(w, p, 2, a[0] * a[1] + b[0] * b[1], a[1] + b[1])
    assert sure.tolist() == [[2 + 3 + 1, 1 + 2 + 1]]
    assert np.allclose(got, [[(2 * 1 + (10 - 2) + (0 - 2)) / 6, (0 + 3 + 8) / 4]])
    same, again = learn.arow_merged(w, p, 3, 3 * w * p, 3 * p)
    assert np.allclose(same, w) and np.allclose(again, p)


def test_arow_in_chunks_equals_passes_by_hand(spark):
    df = blobs(spark, k=2, each=30)
    got = learn.arow(df, 2, epochs=1, chunk_rows=20)
    rows = df.withColumn("c", F.pmod(F.xxhash64(F.lit(11), "m"), F.lit(3))).orderBy("m").collect()
    start, sums = (np.zeros((1, 9)), np.ones((1, 9))), [0, np.zeros((1, 9)), np.zeros((1, 9))]
    for chunk in {r["c"] for r in rows}:
        own = sorted((gradient.drawn(11, 0, np.array([r["m"]]), 1)[0, 0], r["m"], r["v"], r["label"]) for r in rows if r["c"] == chunk)
        w, p = learn.arow_pass(*start, np.array([r[2] for r in own]), np.array([r[3] for r in own]), np.array([0]), 0.1)
        sums = [sums[0] + 1, sums[1] + w * p, sums[2] + p]
    w, _ = learn.arow_merged(*start, *sums)
    assert np.allclose(np.append(got.weights, got.bias), w)


def test_epoch_ranges_targets_and_progress(spark):
    df = blobs(spark, each=40)
    seen = []
    net = learn.new_mlp(8, 3.0, 8, 4, np.random.default_rng(1))
    rows = df.withColumn("t", learn._one_hot(F.col("label"), 4))
    first, _ = learn.mlp_targets(rows, net, 0.1, 0.1, 0, 6, progress=lambda e, x: seen.append((e, x)))
    _, right = learn.mlp_targets(rows, first, 0.05, 0.05, 6, 12)
    assert [e for e, _ in seen] == list(range(6)) and seen[-1][1] < seen[0][1] and right > 0.9
    still, _ = learn.mlp_targets(rows, net, 0.0, 0.1, 0, 2)
    assert (still.w1 == net.w1).all() and (still.w2 != net.w2).any()  # each layer has its rate
    none = df.filter("m < 0")
    assert learn.softmax_regression(none, 4).weights.shape == (4, 0) and learn.arow(none, 4).weights.shape == (4, 0)


def kmeans_by_hand(data, means, passes):
    for p in range(passes):
        at = ((data[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        if p < passes - 1:
            means = np.array([data[at == j].mean(axis=0) if (at == j).any() else c for j, c in enumerate(means)])
    return means, at


def leaves_by_hand(data, shape, passes):
    if not shape:
        return np.zeros(len(data), int)
    means, at = kmeans_by_hand(data, data[: shape[0]], passes)
    out, below = np.zeros(len(data), int), int(np.prod(shape[1:]))
    for j in range(len(means)):
        out[at == j] = j * below + leaves_by_hand(data[at == j], shape[1:], passes)
    return out


@pytest.mark.parametrize("shape", [[3, 2], [2, 2, 2], [5, 3]])
def test_tree_equals_recursion(spark, shape):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(150, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "m bigint, v array<double>").repartition(5)
    own = tree.kmeans_tree(df, shape, 4, seeding="first")
    got = [r["leaf"] for r in tree.label(df, own).orderBy("m").collect()]
    assert got == leaves_by_hand(data, shape, 4).tolist()


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_follow_levels_not_nodes(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)))], "m bigint, v array<double>")
    wide = jobs_of(spark, "wide", lambda: tree.kmeans_tree(df, [12, 2, 2], 2, seeding="first"))
    narrow = jobs_of(spark, "narrow", lambda: tree.kmeans_tree(df, [2, 2, 2], 2, seeding="first"))
    assert wide == narrow


@pytest.mark.parametrize("train", [
    lambda df, seen: tree.kmeans_tree(df, [2, 2], 10, progress=seen),
    lambda df, seen: tree.pca_kmeans_tree(df, [2, 2], 4, 10, progress=seen),
    lambda df, seen: tree.regression_tree(df, [2, 2], learn.SoftmaxParams(8), 2, progress=seen),
])
def test_trees_keep_labels_together(spark, train):
    df, seen = blobs(spark, each=40), []
    own = train(df, lambda e, x: seen.append(x))
    assert agg.purity(tree.label(df, own).withColumn("cluster", F.col("leaf"))).first()[0] > 0.7 and seen


def test_moments_of_keys(spark):
    df = blobs(spark, each=30).repartition(6)
    data, labels = arrays(df)
    for r in agg.moments(df, "label").collect():
        own = data[labels == r["key"]]
        assert r["count"] == len(own) and np.allclose(r["sums"], own.sum(axis=0)) and np.allclose(np.reshape(r["products"], (8, 8)), own.T @ own)
    assert agg.moments(df.filter("m < 0")).count() == 0 and cluster.gaussians(df.filter("m < 0"), "label", 2) == [None, None]


def metric_by_hand(start, data, labels, k, k_near, margin, push, rate, rounds):
    matrix, old = start.copy(), np.zeros_like(start)
    d = ((data[:, None] - data[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for step in range(rounds):
        z = data @ matrix.T
        dz = ((z[:, None] - z[None]) ** 2).sum(axis=2)
        np.fill_diagonal(dz, np.inf)
        scatter = np.zeros((data.shape[1], data.shape[1]))
        for i in range(len(data)):
            same = [j for j in np.argsort(d[i], kind="stable") if labels[j] == labels[i] and j != i][:k]
            for j in same:
                u = data[i] - data[j]
                scatter += (1 - push) * np.outer(u, u)
                for far in np.argsort(dz[i], kind="stable")[:k_near]:
                    if labels[far] != labels[i] and dz[i, j] + margin > dz[i, far]:
                        w = data[i] - data[far]
                        scatter += push * (np.outer(u, u) - np.outer(w, w))
        g = matrix @ scatter
        g *= 0.5 / np.abs(g).max()
        old = 0.5 * old + (rate - 0.5 * rate * step / rounds) * g
        matrix = matrix - old
        matrix /= np.linalg.norm(matrix, axis=1).max()
    return matrix


def test_metric_rounds_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    data, labels = rng.normal(size=(90, 4)), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(data, labels))] + [(200, None, 1), (201, [1.0] * 4, None)], "m bigint, v array<double>, label int").repartition(5)
    got = learn.lmca(df, 3, k=2, k_near=7, rounds=2, start="identity", cells=5)
    assert np.allclose(got.matrix, metric_by_hand(np.eye(3, 4), data, labels, 2, 7, 0.5, 0.5, 0.1, 2))


def test_metric_rounds_with_many_cells_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    data, labels = rng.normal(size=(60, 4)), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(data, labels))], "m bigint, v array<double>, label int").repartition(3)
    got = learn.lmca(df, 2, k=2, k_near=7, rounds=1, start="identity", cells=2, cell_rows=6)
    assert np.allclose(got.matrix, metric_by_hand(np.eye(2, 4), data, labels, 2, 7, 0.5, 0.5, 0.1, 1))


def nearest_by_hand(data, ids, queries, k, allowed=lambda q, i: True):
    out = []
    for q, v in queries:
        order = sorted((float(((data[j] - v) ** 2).sum()), i) for j, i in enumerate(ids) if i != q and allowed(q, i))[:k]
        out += [(q, rank + 1, i, round(d, 9)) for rank, (d, i) in enumerate(order)]
    return sorted(out)


def told(found):
    return sorted((r["qid"], r["rank"], r["m"], round(r["dist"], 9)) for r in found.collect())


@pytest.mark.parametrize("part_rows, block", [(20_000, 5_000), (7, 3)])
def test_index_is_exact_with_hot_cells_and_ties(spark, part_rows, block):
    rng = np.random.default_rng(5)
    data = np.round(rng.normal(size=(240, 3)), 1)
    data[:80] = [0.5, 0.5, 0.5]  # a third of the rows is one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(900, None)], "m bigint, v array<double>").repartition(4)
    index = vector_index.build(df, 6, part_rows=part_rows)
    assert index.rows.count() == 240 and (max(index.parts.values()) > 10 or part_rows > 7)
    queries = df.filter("m % 5 = 0").select(F.col("m").alias("qid"), "v")
    got = told(vector_index.search(index, queries, 4, 1, exact=True, exclude_self=True, block_queries=block))
    assert got == nearest_by_hand(data, range(240), [(i, data[i]) for i in range(0, 240, 5)], 4)
    some = vector_index.search(index, queries, 4, 2, exclude_self=True, block_queries=block)
    assert 0.5 < vector_index.recall(some, knn.knn(df.filter("v is not null"), queries, 4, exclude_self=True)) <= 1
    assert 1 <= vector_index.probes_for(index, 4, 0.9) <= 6


def test_further_lists_return_rows_within_the_bound_only(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(200, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "m bigint, v array<double>").repartition(3)
    index, met, real = vector_index.build(df, 5), [], vector_index._met
    monkeypatch.setattr(vector_index, "_met", lambda *args: met.append(real(*args)) or met[-1])
    queries = df.filter("m % 4 = 0").select(F.col("m").alias("qid"), "v")
    got = told(vector_index.search(index, queries, 4, 2, exact=True, exclude_self=True))
    assert got == nearest_by_hand(data, range(200), [(i, data[i]) for i in range(0, 200, 4)], 4)
    first, further = (x.collect() for x in met)
    bound = {r["qid"]: r["dist"] for r in first if r["rank"] == 4}
    assert further and all(r["dist"] <= bound[r["qid"]] for r in further)


def test_index_of_groups_and_empty_index(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(data)], "m bigint, v array<double>, g int")
    index = vector_index.build(df, 4, group="g")
    got = told(vector_index.search(index, df.select(F.col("m").alias("qid"), "v", "g"), 30, 1, exact=True, exclude_self=True))
    assert got == nearest_by_hand(data, range(60), list(enumerate(data)), 30, lambda q, i: q % 3 == i % 3)
    none = vector_index.build(df.filter("m < 0"), 4)
    assert none.cells == 0 and vector_index.search(none, df.select(F.col("m").alias("qid"), "v"), 3, 1, exact=True).count() == 0
    index.close()


def test_scans_do_not_follow_queries(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 3)))], "m bigint, v array<double>")
    index = vector_index.build(df, 4)
    few = jobs_of(spark, "few", lambda: vector_index.search(index, df.limit(3).select(F.col("m").alias("qid"), "v"), 3, 2).collect())
    many = jobs_of(spark, "many", lambda: vector_index.search(index, df.select(F.col("m").alias("qid"), "v"), 3, 2).collect())
    assert abs(few - many) <= 1  # `limit` may take one job of its own


def test_probabilities_of_every_document_with_its_class(spark, tmp_path):
    told = [(i, "der hund" if i % 2 else "the cat sat", "de" if i % 2 else "en") for i in range(40)]
    odd = [(40, None, "en"), (41, "", "de"), (42, "THE CAT SAT", None), (43, "Ж€ \U0001f600", None)]
    spark.createDataFrame(told + odd, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    rows, bad = compare(spark, "lr_probability", catalog.QUERIES["lr_probability"], catalog.SQL["lr_probability"], str(tmp_path))
    assert rows == 44 and not bad, bad[:3]
    got = {r["m"]: r for r in catalog.QUERIES["lr_probability"](spark, str(tmp_path)).collect()}
    assert got[42]["label"] == 1 and got[42]["p"] == got[0]["p"] > got[40]["p"] == 0.25


def test_shares_of_letters_are_those_of_single_counts():
    for text in ("", "aab çßß", "Ж?\U0001f600zz", "x" * 300):
        assert learn_queries.shares(text).tolist() == [np.sqrt(100.0 * text.count(c) / max(len(text), 1)) for c in learn_queries.LETTERS]


def test_rounds_between_clusters_are_those_over_all_rows(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(1500, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "m bigint, v array<double>").coalesce(2)
    passes, real = [], cluster.one_pass
    monkeypatch.setattr(cluster, "one_pass", lambda *a: passes.append(1) or real(*a))
    got = cluster.lloyd(df, x[:5])
    means, own, epochs = x[:5], None, 0
    while True:
        at = cluster.squared(x, means).argmin(axis=1)
        epochs += 1
        if own is not None and (at == own).all():
            break
        own, means = at, np.array([x[at == j].mean(axis=0) for j in range(5)])
    assert got.epochs == epochs > 1.5 * len(passes) and got.counts.tolist() == np.bincount(at).tolist() and np.abs(got.means - means).max() < 1e-9
    part = cluster.lloyd(df, x[:5], epochs - 3)
    assert part.epochs == epochs - 3 and part.counts.sum() == 1500
