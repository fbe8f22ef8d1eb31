"""Text arrays, lists of matrices and nested models through their files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import cluster, frame, learn, tree
from vexel.plans.cluster_queries import blobs
from vexel.sources import matrix


def test_text_in_splits_keeps_row_numbers(spark, tmp_path):
    rows = [[float(i), i / 3, -1.0] for i in range(4000)]
    (tmp_path / "a.txt").write_text("1 4000 3 1 4000\n" + "".join(" ".join(f"{x:E}" for x in r) + "\n" + "\n" * (i % 7 == 0) for i, r in enumerate(rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = matrix.numbered_lines(spark, str(tmp_path / "a.txt"))
        assert lines.rdd.getNumPartitions() > 8
        got = matrix.read_text(spark, str(tmp_path / "a.txt")).orderBy("m").collect()
        head = matrix.read_header(spark, str(tmp_path / "a.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["m"] for r in got] == list(range(4000)) and np.allclose([r["v"] for r in got], rows, atol=1e-3)
    assert [tuple(r) for r in head] == [(1, 4000, 3, 1, 4000)]


def test_part_files_in_order_are_the_text(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("m"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("v")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        matrix.write_text(df, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "t").glob("part-*"))
    whole = "".join(p.read_text() for p in parts).splitlines()
    assert len(parts) > 1 and whole[0] == "1 300 2 1 300" and whole[1:] == [f"{i:E} {0.5:E}" for i in range(300)]
    assert [(r["m"], r["v"][0]) for r in matrix.read_text(spark, str(tmp_path / "t")).orderBy("m").collect()] == [(i, i) for i in range(300)]


@pytest.mark.parametrize("stretch", [65_536, 7])
def test_arrays_of_lists_in_text_with_rows_like_headers(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(matrix, "_STRETCH", stretch)
    text = "2 3 5 1 3\n" + "1 9 2 1 9\n" * 6 + "1 1 2 1 1\n0.5 0.25\n" + "1 0 3 1 0\n" + "1 30 1 1 30\n" + "".join(f"{i}\n" for i in range(30)) + "trailing 1 2\n"
    (tmp_path / "a.txt").write_text(text)
    got = [(r["array_index"], r["list"], r["m"], r["v"]) for r in matrix.read_text_arrays(spark, str(tmp_path / "a.txt")).orderBy("array_index", "list", "m").collect()]
    assert got == [(0, k, m, [1, 9, 2, 1, 9]) for k in range(2) for m in range(3)] + [(1, 0, 0, [0.5, 0.25])] + [(3, 0, i, [i]) for i in range(30)]
    assert matrix.read_header(spark, str(tmp_path / "a.txt")).count() == 4


def test_three_levels_through_text_and_bytes(spark, tmp_path):
    rows = frame.constant_lists(spark, 3, 4, 5).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("array_index"), "list", "m", F.transform("v", lambda x, i: x + F.col("list") * 100 + F.col("m") * 10 + i).alias("v"))
    want = rows.withColumn("list", F.col("list").cast("bigint")).orderBy("array_index", "list", "m").collect()
    matrix.write_text_arrays(rows, str(tmp_path / "t"))
    order = ["array_index", "list", "m"]
    assert matrix.read_text_arrays(spark, str(tmp_path / "t")).orderBy(order).collect() == want
    (tmp_path / "b.bin").write_bytes(b"".join(bytes(r["content"]) for r in matrix.binary_of(rows).orderBy("array_index").collect()))
    assert matrix.read_binary(spark, str(tmp_path / "b.bin")).select(*order, "v").orderBy(order).collect() == want
    one = frame.list_of(rows.filter("array_index = 1"), 2).orderBy("m").collect()
    assert [r["v"][4] for r in one] == [204, 214, 224, 234]
    assert spark.range(1).select(frame.list_value(F.lit(2), F.lit(1), F.lit(3), 4, 5).alias("x")).first()[0] == 48


def same(a, b):
    if isinstance(a, np.ndarray):
        return a.shape == b.shape and (a == b).all()
    if isinstance(a, (list, tuple)):
        return type(a) is type(b) and len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return list(a) == list(b) and all(same(a[k], b[k]) for k in a)
    if hasattr(a, "__dataclass_fields__"):
        return type(a) is type(b) and all(same(getattr(a, k), getattr(b, k)) for k in a.__dataclass_fields__)
    return type(a) is type(b) and a == b


def test_every_model_kind_comes_back(spark, tmp_path):
    df, rng = blobs(spark, each=15), np.random.default_rng(1)
    data = np.array([r["v"] for r in df.collect()])
    net = learn.new_mlp(8, 2.0, 3, 4, rng, 0.1, 0.2)
    models = [
        learn.Softmax(rng.normal(size=(4, 8))), learn.Arow(rng.normal(size=(4, 8)), rng.normal(size=4)), learn.naive_bayes(df, 5, 3), net, learn.Bagging([net, learn.new_mlp(8, 1.0, 2, 4, rng)]),
        learn.Dae(rng.normal(size=(8, 3)), np.zeros(3), np.zeros(8), True), learn.Metric(np.zeros((0, 8))), cluster.Clusters(rng.normal(size=(2, 8)), np.array([1.0, 2.0]), 0.5, 3),
        tree.kmeans_tree(df, [2, 2], 2, seeding="first"), tree.pca_kmeans_tree(df, [2, 2], 3, 2, seeding="first"), tree.Tree([2], [{0: tree.Node(rng.normal(size=(2, 8)), weights=rng.normal(size=(2, 8)))}]),
    ]
    for i, model in enumerate(models):
        matrix.save_model(spark, model, str(tmp_path / f"m{i}"))
        again = matrix.load_model(spark, type(model), str(tmp_path / f"m{i}"))
        assert same(model, again), type(model)
        if hasattr(model, "scores"):
            assert (model.scores(data) == again.scores(data)).all()
        if isinstance(model, tree.Tree):
            assert all((x == y).all() for x, y in zip(model.descend(data), again.descend(data)))
    with pytest.raises(TypeError):
        matrix.load_model(spark, learn.Mlp, str(tmp_path / "m0"))
