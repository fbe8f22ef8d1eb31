"""Tiled background state, maps by ranges of epochs, convolution by an encoder, areas and pools of images."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import cluster, frame, image, learn
from vexel.streaming import background

FRAMES = "camera_id bigint, frame_no bigint, v array<double>"


def _history(cameras, count, n, seed=0):
    rng = np.random.default_rng(seed)
    return [(c, k, (rng.normal(50, 3, n) + (80 * (rng.random(n) < 0.2))).tolist()) for c in cameras for k in range(count)]


def _fold(rows, models):
    out = {}
    for camera, number, v in sorted(rows):
        mean, amplitude = models[camera]
        mask, mean, amplitude = background.step(mean, amplitude, np.array(v), background.Settings())
        models[camera] = (mean, amplitude)
        out[camera, number] = mask.tolist()
    return out


@pytest.mark.parametrize("tile", [1, 3, 7, 1024])
def test_background_is_the_fold_on_any_tiling(spark, tile):
    rows = _history((1, 2), 25, 10)
    frames = spark.createDataFrame(rows[::-1], FRAMES).repartition(3)
    models = background.train(frames)
    known = {r["camera_id"]: (np.array(r["mean"]), np.array(r["amplitude"])) for r in models.collect()}
    want = _fold(rows, known)
    got = {(r["camera_id"], r["frame_no"]): r["mask"] for r in background.segment(frames, models, tile=tile).collect()}
    assert got == want
    assert any(any(m) for m in want.values()) and not all(all(m) for m in want.values())


def test_background_of_odd_rows(spark):
    rows = _history((1, 2), 4, 5)
    twice = rows + [rows[1], (1, 2, [0.0] * 5), (None, 0, [1.0] * 5), (1, None, [1.0] * 5), (1, 9, None)]
    frames = spark.createDataFrame(twice, FRAMES)
    models = background.train(spark.createDataFrame(rows, FRAMES)).filter("camera_id = 1")
    got = background.segment(frames, models, tile=2).collect()
    assert sorted((r["camera_id"], r["frame_no"]) for r in got) == [(1, 0), (1, 1), (1, 1), (1, 2), (1, 2), (1, 3)]
    assert all(len(r["mask"]) == 5 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, background.segment(frames.repartition(5), models, tile=5).collect()))
    assert background.segment(frames.limit(0), models).count() == 0


def test_background_streams_a_long_history(spark):
    """A history is folded as it streams by: batches of few rows give the same as one, and no group is gathered."""
    frames = spark.range(20_000).select(F.lit(1).cast("bigint").alias("camera_id"), F.col("id").alias("frame_no"), F.array(F.col("id") % 7 * 5.0, F.when(F.col("id") % 50 == 0, 200.0).otherwise(10.0)).alias("v"))
    models = background.train(frames)
    tiles = background.segment_tiles(frames, models, tile=1)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan
    whole = background.segment(frames, models).agg(F.count(F.lit(1)), F.sum(F.col("mask")[0]), F.sum(F.col("mask")[1])).first()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        parts = background.segment(frames, models, tile=1).agg(F.count(F.lit(1)), F.sum(F.col("mask")[0]), F.sum(F.col("mask")[1])).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == parts and whole[0] == 20_000 and whole[2] == 400


def test_tiled_stream_equals_batch(spark, tmp_path):
    rows = _history((1, 2), 12, 5)
    frames = spark.createDataFrame(rows, FRAMES)
    models = background.train(frames)
    want = {(r["camera_id"], r["tile"], r["frame_no"]): r["mask"] for r in background.segment_tiles(frames, models, tile=2).collect()}
    known = {r["camera_id"]: (r["mean"], r["amplitude"]) for r in models.collect()}
    for part in (0, 1):  # two micro-batches
        frames.filter(f"frame_no div 6 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = background.segment_stream(stream, known, tile=2).writeStream.format("memory").queryName("tiles").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["camera_id"], r["tile"], r["frame_no"]): r["mask"] for r in spark.table("tiles").collect()}
    assert got == want


def _points(spark, count=60, n=3):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(count, n)) + 4 * rng.integers(0, 2, (count, 1))
    return data, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "m bigint, v array<double>")


def test_map_epochs_by_brute_force(spark):
    data, rows = _points(spark)
    units = data[:6].copy()
    got = cluster.som_epochs(rows.repartition(3), units, 3, 2, 4, 50, passes=2)
    y, x = np.divmod(np.arange(6), 3)
    for epoch in (2, 3):
        radius = int(0.6 * 3 * np.exp(-epoch * np.log(0.6 * 3) / 50))
        for _ in range(2):
            add = np.zeros_like(units)
            for v in data:
                at = int(((units - v) ** 2).sum(axis=1).argmin())
                for u in range(6):
                    d2 = (y[u] - y[at]) ** 2 + (x[u] - x[at]) ** 2
                    if d2 < radius**2:
                        add[u] += np.exp(-d2 / (2 * radius**2)) * (v - units[u])
            units = units + 0.1 / len(data) * (400 / 50) * add
    assert radius == 1
    np.testing.assert_allclose(got, units, atol=1e-9)


def test_map_of_micro_batches(spark):
    data, rows = _points(spark)
    stream = cluster.som_stream(rows, 5, seed=3)
    own = {p: [] for p in range(5)}
    for r in stream.rows.collect():
        own[r["part"]].append(r["v"])
    assert sum(map(len, own.values())) == len(data) == stream.total
    start, heard = data[:6], []
    once = cluster.som_online(stream, start, 3, 0, 2, 2, 2, rate=30.0, progress=lambda epoch, error: heard.append((epoch, error)))
    again = cluster.som_online(stream, cluster.som_online(stream, start, 3, 0, 1, 2, 2, rate=30.0), 3, 1, 2, 2, 2, rate=30.0)
    assert np.array_equal(once, again)
    assert [e for e, _ in heard] == [0, 1] and heard[1][1] < heard[0][1]
    # Row after row, nearest units as they were before the batch.
    units = start.copy()
    y, x = np.divmod(np.arange(6), 3)
    for epoch in range(2):
        radius = int(0.5 * 3 * np.exp(-epoch * np.log(0.5 * 3) / 2) * 2)
        for turn in range(2):
            for part in stream.order(epoch, turn):
                before = units.copy()
                mean, mass = np.zeros_like(units), np.zeros(6)
                for v in np.array(own[part]):
                    at = int(((before - v) ** 2).sum(axis=1).argmin())
                    w = np.exp(-((y - y[at]) ** 2 + (x - x[at]) ** 2) / (2 * radius**2)) * ((y - y[at]) ** 2 + (x - x[at]) ** 2 < radius**2)
                    mean, mass = mean + w[:, None] * v, mass + w
                held = mass > 0
                units[held] += (1 - (1 - 0.5) ** mass[held])[:, None] * (mean[held] / mass[held, None] - units[held])
    np.testing.assert_allclose(once, units, atol=1e-9)
    stream.close()


def test_empty_map(spark):
    none = spark.createDataFrame([], "m bigint, v array<double>")
    units = np.ones((4, 2))
    stream = cluster.som_stream(none, 2)
    assert np.array_equal(cluster.som_online(stream, units, 2, 0, 2, 4), units)
    assert np.array_equal(cluster.som_epochs(none, units, 2, 0, 2, 4), units)


def test_convolution_equals_patch_by_patch(spark):
    rng = np.random.default_rng(1)
    sizes = [(9, 7), (6, 12), (3, 3)]
    pictures = [rng.normal(size=(r, c, 2)) for r, c in sizes]
    images = spark.createDataFrame([(i, *a.shape, a.ravel().tolist()) for i, a in enumerate(pictures)], image.SCHEMA)
    net = learn.Dae(rng.normal(size=(18, 5)), rng.normal(size=5), np.zeros(18))
    maps = {r["image_id"]: np.array(r["data"]).reshape(r["rows"], r["cols"], r["n"]) for r in image.convolve(images, net.encode, 3).collect()}
    patches = {(r["image_id"], r["row"], r["col"]): np.array(r["v"]) for r in image.patches(images, 3).collect()}
    assert {i: m.shape for i, m in maps.items()} == {0: (6, 4, 5), 1: (3, 9, 5), 2: (0, 0, 0)}
    assert len(patches) == 6 * 4 + 3 * 9
    for (i, y, x), patch in patches.items():
        np.testing.assert_allclose(patch, pictures[i][y : y + 3, x : x + 3].ravel())
        np.testing.assert_allclose(maps[i][y, x], net.encode(patch[None])[0])
    pooled = image.apply(image.convolve(images, net.encode, 3).filter("image_id < 2"), lambda a: image.max_pooling(a, 3, 2)).collect()
    assert sorted((r["rows"], r["cols"], r["n"]) for r in pooled) == [(1, 4, 5), (3, 2, 5)]


def test_patches_on_a_grid(spark):
    a = np.arange(100.0).reshape(10, 10, 1)
    got = image.patches(spark.createDataFrame([(0, 10, 10, 1, a.ravel().tolist())], image.SCHEMA), 4, 3, 2).collect()
    assert [(r["row"], r["col"], r["v"][0]) for r in got] == [(y, x, float(int(6 / 3 * y) * 10 + int(6 / 2 * x))) for y in range(3) for x in range(2)]


def test_pools_and_areas_by_plain_loops():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(7, 9, 2))
    for size, stride in ((2, 2), (3, 2), (3, 1)):
        rows, cols = 7 // stride, 9 // stride
        for y in range(rows):
            for x in range(cols):
                window = a[y * stride : y * stride + size, x * stride : x * stride + size]
                np.testing.assert_allclose(image.max_pooling(a, size, stride)[y, x], np.maximum(window.max(axis=(0, 1)), 0))
                np.testing.assert_allclose(image.average_pooling(a, size, stride)[y, x], window.mean(axis=(0, 1)))
    for shape in ((1, 1), (1, 8), (20, 30), (64, 64)):
        labels = rng.integers(0, 3, shape)
        got = image.components(labels)
        seen, count = np.full(shape, -1), 0
        for y, x in np.ndindex(shape):
            if seen[y, x] < 0:
                open_ = [(y, x)]
                seen[y, x] = count
                while open_:
                    cy, cx = open_.pop()
                    for ny in range(max(0, cy - 1), min(shape[0], cy + 2)):
                        for nx in range(max(0, cx - 1), min(shape[1], cx + 2)):
                            if seen[ny, nx] < 0 and labels[ny, nx] == labels[y, x]:
                                seen[ny, nx] = count
                                open_.append((ny, nx))
                count += 1
        assert np.array_equal(got, seen)
    spiral = np.zeros((41, 41), int)
    spiral[1::2] = 1
    spiral[1::4, -1], spiral[3::4, 0] = 0, 0
    assert image.components(spiral).max() == 20


def test_transposed_grid_and_images(spark):
    rows = spark.range(6).select(F.col("id").alias("m"), F.array(F.col("id").cast("double")).alias("v"))
    assert [r["v"][0] for r in frame.transpose_grid(rows, 2, 3).orderBy("m").collect()] == [0, 3, 1, 4, 2, 5]
    a = np.arange(12.0).reshape(2, 3, 2)
    got = image.transposed(spark.createDataFrame([(7, 2, 3, 2, a.ravel().tolist())], image.SCHEMA)).first()
    assert (got["rows"], got["cols"], got["n"]) == (3, 2, 2)
    assert np.array_equal(np.array(got["data"]).reshape(3, 2, 2), a.transpose(1, 0, 2))
