"""Operators against known answers and brute force."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vexel.functions import vec
from vexel.operators import agg, cluster, frame, image, index, keypoint, knn, learn, linalg, scale, tree
from vexel.plans.cluster_queries import blobs
from vexel.plans.image_queries import blob_images
from vexel.sources import matrix
from vexel.streaming import background


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_ieee_division(spark):
    got = one(spark, vec.div(arr(1, -1, 0, 6), arr(0, 0, 0, 3)))
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 2


def test_nan_is_skipped_and_equals_nothing(spark):
    v = arr(1, math.nan, 3)
    assert one(spark, vec.maximum(v)) == 3 and one(spark, vec.argmax(v)) == 2 and one(spark, vec.minimum(v)) == 1
    assert one(spark, vec.equal(v, v)) is False and one(spark, vec.equal(arr(1, 2), arr(1, 2))) is True


def test_signs_and_rounding(spark):
    assert one(spark, vec.sign(F.lit(0.0))) == 1 and one(spark, vec.sign_strict(F.lit(0.0))) == -1
    assert one(spark, vec.round_half(F.lit(-1.7))) == -1 and one(spark, vec.trunc(F.lit(-1.7))) == -1


def test_degenerate_vectors(spark):
    zero = arr(0, 0)
    assert one(spark, vec.norm(zero)) == 0 and one(spark, vec.cosine(zero, arr(1, 0))) == 2
    assert one(spark, vec.histogram_intersection(arr(1, 1), zero)) == 1
    assert one(spark, vec.normalize_l2(zero)) == [0, 0] and one(spark, vec.normalize_shift(arr(5, 5), 0, 1)) == [5, 5]
    assert one(spark, vec.variance(arr(4))) == 0 and one(spark, vec.find_index(arr(1, 2), 0, 2, 9)) == -1


def test_vector_length_is_checked(spark):
    assert frame.checked(frame.create(spark, [[1, 2]]), 2).count() == 1
    with pytest.raises(Exception, match="instead of"):
        frame.checked(frame.create(spark, [[1, 2], [1]]), 2).collect()


def test_random_vectors_do_not_depend_on_partitions(spark):
    a = frame.random_vectors(spark, 50, 4, 7).orderBy("m").collect()
    b = frame.random_vectors(spark, 50, 4, 7).repartition(3).orderBy("m").collect()
    assert a == b and all(0 <= x < 1 for r in a for x in r["v"])
    normal = np.array([r["v"] for r in frame.normal_vectors(spark, 400, 5, 1).collect()])
    assert abs(normal.mean()) < 0.1 and abs(normal.std() - 1) < 0.1


def test_reshaping_round_trip(spark):
    df = frame.create(spark, [[1, 2, 3, 4], [5, 6, 7, 8]])
    assert frame.assemble(frame.explode(df)).orderBy("m").collect() == df.orderBy("m").collect()
    assert frame.flatten(df).first()["v"] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [r["v"] for r in frame.unfold(df, 2).orderBy("m", "part").collect()] == [[1, 2], [3, 4], [5, 6], [7, 8]]


def test_known_eigenvalues():
    values, rows = linalg.eigen_symmetric(np.array([[1, 0.5, 0.3], [0.5, 1, 0.6], [0.3, 0.6, 1]]))
    assert np.allclose(values, [1.943781, 0.706878, 0.349341], atol=1e-6)
    top, vectors = linalg.eigen_top(np.array([[1, 0.5, 0.3], [0.5, 1, 0.6], [0.3, 0.6, 1]]), 2)
    assert np.allclose(top, values[:2], atol=1e-6) and abs(vectors[0] @ rows[0]) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize(("cost", "total"), [([[(i + 1) * (j + 1) for i in range(4)] for j in range(4)], 20), ([[(i + 1) * (j + 1) for i in range(3)] for j in range(4)], 10), ([[(4 - j) * (5 - i) for j in range(3)] for i in range(5)], 16)])
def test_known_assignments(cost, total):
    assert linalg.assign(np.array(cost, float))[1] == total


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_the_cheapest(rows, cols, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (rows, cols)).astype(float)
    small, large = (cost, cols) if rows <= cols else (cost.T, rows)
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(large), len(small)))
    of, total = linalg.assign(cost)
    assert total == best and sum(c >= 0 for c in of) == min(rows, cols)


def test_column_variance_of_one_row(spark):
    assert [r["variance"] for r in agg.column_variance(frame.create(spark, [[1, 2]])).collect()] == [0, 0]


def test_knn_beyond_one_block(spark, monkeypatch):
    df = frame.random_vectors(spark, 60, 3, 5)
    queries = df.filter("m < 20").select(F.col("m").alias("qid"), "v")
    whole = knn.knn(df, queries, 4).orderBy("qid", "rank").collect()
    monkeypatch.setattr(knn, "BLOCK_BYTES", 100)
    assert knn.knn(df, queries, 4).orderBy("qid", "rank").collect() == whole
    with pytest.raises(ValueError, match="bytes"):
        knn.knn_by(df, queries, 4, vec.euclidean2)


def test_knn_ties_and_empty_tables(spark):
    df = frame.create(spark, [[0, 0], [1, 0], [1, 0], [0, 1]])
    got = knn.knn(df, df.filter("m = 0").select(F.col("m").alias("qid"), "v"), 3, exclude_self=True).orderBy("rank").collect()
    assert [r["m"] for r in got] == [1, 2, 3]
    none = df.limit(0)
    assert knn.knn(none, df.select(F.col("m").alias("qid"), "v"), 2).count() == 0
    assert knn.knn(df, none.select(F.col("m").alias("qid"), "v"), 2).count() == 0


def test_whitening_without_rotation(spark):
    df = frame.normal_vectors(spark, 300, 4, 3)
    out = scale.whiten_all(df, scale.zca_train(df, 0.0, components=2, keep_space=False))
    _, cov = agg.covariance(out)
    assert np.allclose(cov, np.eye(2), atol=1e-6)


def test_kmeans_finds_the_groups_in_any_partitioning(spark):
    df = blobs(spark, each=60)
    got = cluster.kmeans(df, 4, 20)
    again = cluster.kmeans(df.repartition(5), 4, 20)
    assert sorted(got.counts) == [60] * 4 and np.allclose(np.sort(got.means, axis=0), np.sort(again.means, axis=0))
    assert agg.purity(cluster.assign(df, got.means)).first()[0] == 1.0


def test_empty_cluster_keeps_its_mean(spark):
    df = frame.create(spark, [[0, 0], [0, 1]])
    got = cluster.lloyd(df, np.array([[0.0, 0.5], [100.0, 100.0]]), 5)
    assert got.means[1].tolist() == [100, 100] and got.counts.tolist() == [2, 0]


def test_gaussian_clusters_and_plsi(spark):
    rows = blobs(spark, each=60)
    models = cluster.gaussian_clusters(rows, 4, npca=8)
    labelled = cluster.apply_scores(rows, lambda data: cluster.log_scores(models, data, 8))
    assert agg.purity(labelled).first()[0] > 0.6
    counts = spark.range(200).select((F.col("id") / 10).cast("int").alias("d"), (F.col("id") % 10).cast("int").alias("w"))
    counts = counts.withColumn("n", F.when((F.col("d") < 10) == (F.col("w") < 5), 9.0).otherwise(0.1))
    got = cluster.plsi(counts, 2, 20)
    word = np.array([r["p"] for r in got.w.orderBy("w").collect()])
    none = cluster.plsi(counts.limit(0), 2, 5)
    assert np.allclose(got.z, 0.5, atol=0.05) and none.z.tolist() == [0.5, 0.5] and none.w.count() == none.d.count() == 0
    assert np.allclose(word.sum(axis=0), 1) and len(set(word[:5].argmax(axis=1))) == 1 and word[0].argmax() != word[9].argmax()


def test_tree_labels_and_inheritance(spark):
    df = blobs(spark, each=40)
    own = tree.kmeans_tree(df, [2, 2], 10)
    labelled = tree.label(df, own).select(F.col("leaf").alias("cluster"), "label")
    assert own.leaves == 4 and agg.purity(labelled).first()[0] > 0.7
    heir = tree.kmeans_tree(df, [2, 3], 5, base=own)
    assert np.allclose(heir.levels[0][0].means, own.levels[0][0].means)
    data = np.array([r["v"] for r in df.collect()])
    assert (own.descend(data, beam=2)[1] <= own.descend(data)[1] + 1e-9).all() and own.leaf_mean(0) is not None


@pytest.mark.parametrize("fit", [lambda df: learn.softmax_regression(df, 4), lambda df: learn.arow(df, 4), lambda df: learn.naive_bayes(df, 4, 8), lambda df: learn.mlp(df, 4, hidden=16, epochs=15)])
def test_learners_predict_rows_they_have_not_seen(spark, fit):
    parts = frame.split(blobs(spark, each=80), "m", 11)
    model = fit(parts.filter("split = 'train'"))
    assert learn.accuracy(learn.predict(parts.filter("split = 'test'"), model)) > 0.9


def test_two_class_arow_has_one_vector(spark):
    df = blobs(spark, k=2, each=60)
    model = learn.arow(df, 2)
    assert model.weights.shape[0] == 1 and learn.accuracy(learn.predict(df, model)) > 0.9


def test_metric_learning_keeps_labels_together(spark):
    df = blobs(spark, each=25)
    model = learn.lmca(df, 3, rounds=3)
    data, labels = np.array([r["v"] for r in df.orderBy("m").collect()]), np.array([r["label"] for r in df.orderBy("m").collect()])
    z = model.project(data)
    d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert (labels[d.argmin(axis=1)] == labels).mean() > 0.9


def test_autoencoder_learns(spark):
    df = blobs(spark, each=60)
    data = np.array([r["v"] for r in df.collect()])
    off = lambda m: np.mean((m.decode(m.encode(data)) - data) ** 2)
    assert off(learn.dae(df, 6, epochs=25)) < 0.8 * off(learn.dae(df, 6, epochs=1))


def test_image_kernels_by_brute_force():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 255, (11, 13)).astype(float)
    assert [image.star_area(r) for r in range(1, 8)] == [6, 12, 34, 68, 114, 136, 198]
    for r in (1, 2, 3, 5):
        side = int(r / np.sqrt(2) + 0.5)
        want = np.zeros_like(x)
        for y, c in np.ndindex(x.shape):
            for v, u in np.ndindex(x.shape):
                down = v - y if v >= y else y - 1 - v
                want[y, c] += x[v, u] * ((-side <= v - y < side and -side <= u - c < side) + (-r + down <= u - c <= r - 2 - down))
        assert np.allclose(image.star_sum(x, r), want)
        assert np.allclose(image.Star(x, 7).sums(r, 2), want[::2, ::2])
    big = rng.integers(0, 9, (40, 25)).astype(float)
    tilted = image.integral_tilted(big[:, :, None])
    for y, c in [(1, 0), (7, 3), (40, 25), (33, 0), (40, 12)]:
        assert tilted[y, c] == sum(big[v, u] for v in range(y) for u in range(25) if abs(u - c + 1) <= y - 1 - v)
    assert image.resize(x[:, :, None], 11, 13)[:, :, 0].tolist() == x.tolist()
    assert image.components(np.array([[1, 1, 0], [0, 1, 0], [1, 0, 0]])).max() == 1
    assert len(image.rectangle_feature(x[:, :, None])) == 1152
    assert image.integral(x[:, :, None])[-1, -1] == x.sum()


def spotted(seed, size=220, spots=40):
    """Discs of many sizes and levels on soft noise."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size]
    out = 128 + 6 * rng.normal(size=(size, size))
    for _ in range(spots):
        cy, cx, r = rng.uniform(0, size), rng.uniform(0, size), rng.uniform(4, 16)
        out[(y - cy) ** 2 + ((x - cx) * rng.uniform(0.7, 1.4)) ** 2 <= r * r] = rng.uniform(0, 255)
    return out


def test_keypoints_of_discs(spark):
    got = keypoint.keypoints(blob_images(spark)).filter("image_id = 0").collect()
    assert got and all(len(r["desc"]) == 72 for r in got)
    assert min(math.hypot(r["y"] - 60, r["x"] - 60) for r in got) < 8
    flat = np.full((80, 80, 1), 128.0)
    assert keypoint.extract(flat, keypoint.Params()) == [] and keypoint.extract(flat[:5, :5], keypoint.Params()) == []


def test_radii_grow_by_the_factor():
    got = keypoint.radii(keypoint.Params())
    now, want = 6.16885, [6]
    while len(want) < 17:
        now *= 1.090508
        if int(now + 0.5) > want[-1]:
            want.append(int(now + 0.5))
    assert got == want


def test_detection_equals_a_search_pixel_by_pixel():
    p = keypoint.Params(response=9.0, levels=9)
    x = spotted(3, 150, 25)
    size, star = keypoint.radii(p), image.Star(x, 200)
    field = np.array([(star.sums(2 * r) - star.sums(r)) / (image.star_area(2 * r) - image.star_area(r)) - star.sums(r) / image.star_area(r) for r in size])
    grid, begin = {}, 4 * size[0] + (4 * size[0]) % 2
    for y in range(begin, 150 - begin, 2):
        for c in range(begin, 150 - begin, 2):
            levels = [s for s in range(0, len(size), 2) if all(0 <= q - 4 * size[s] and q + 4 * size[s] < 150 for q in (y, c))]
            for s in levels:
                if s + 4 in levels:
                    a, b, d = (field[s + k, y, c] for k in (0, 2, 4))
                    if (b > 0 and a < b > d) or (b < 0 and a > b < d):
                        under, over = abs(field[s + 1, y, c]) * np.sign(b * field[s + 1, y, c]), abs(field[s + 3, y, c]) * np.sign(b * field[s + 3, y, c])
                        to = (s + 1 if under > over else s + 3) if abs(b) < under else (s + 2 if abs(b) > over else s + 3)
                        grid[to, y, c] = field[to, y, c]
    want = set()
    for (s, y, c), r in grid.items():
        near = int(size[s] + 0.5)
        if not 1 <= s < len(size) - 1 or abs(r) < 9 or min(y, c) < near or max(y, c) + near + 1 >= 150:
            continue
        around = [v for (t, yy, cc), v in grid.items() if t == s and (yy, cc) != (y, c) and abs(yy - y) <= near and (c - int(np.sqrt(max(near**2 - (yy - y) ** 2, 0)) + 0.5)) // 2 <= cc // 2 < (c + int(np.sqrt(max(near**2 - (yy - y) ** 2, 0)) + 0.5) + 1) // 2]
        if not any(v * np.sign(r) > abs(r) for v in around):
            soft = star.sums(keypoint.star_of(2 * size[s])) / image.star_area(keypoint.star_of(2 * size[s]))
            at, reach = slice(y - 2 * size[s], y + 2 * size[s] + 1), slice(c - 2 * size[s], c + 2 * size[s] + 1)
            dy, dx = (np.roll(soft, 1, 0) - np.roll(soft, -1, 0))[at, reach], (np.roll(soft, 1, 1) - np.roll(soft, -1, 1))[at, reach]
            det = (dx**2).sum() * (dy**2).sum() - (dx * dy).sum() ** 2
            if not ((dx**2).sum() + (dy**2).sum()) ** 2 / det >= p.edge:
                want.add((s, y, c))
    got = {(lv, y, c) for _, y, c, _, lv in keypoint.detect(x, p)}
    assert want and got == want


def match_rate(a, b):
    p = keypoint.Params()
    one, two = (np.array([k[6] for k in keypoint.extract(np.asarray(x)[:, :, None], p)]) for x in (a, b))
    assert len(one) > 5 and len(two) > 5
    near = 1 - (one @ two.T) / (np.linalg.norm(one, axis=1)[:, None] * np.linalg.norm(two, axis=1)[None, :])
    return (near.min(axis=1) < 0.05).mean()


def test_keypoints_match_when_turned_and_not_across_images():
    x = spotted(5)
    turned = [match_rate(x, np.rot90(x, k)) for k in (1, 2, 3)]
    other = match_rate(x, spotted(6))
    assert min(turned) > 0.5 > other, (turned, other)


def test_text_binary_and_model_files(spark, tmp_path):
    df = frame.create(spark, [[1.5, -2, 3, 4, 5], [6, 7, 8, 9, 10]])
    matrix.write_text(df, str(tmp_path / "t"))
    assert matrix.read_text(spark, str(tmp_path / "t")).select("m", "v").orderBy("m").collect() == df.orderBy("m").collect()
    raw = matrix.to_bytes(np.array([[1.5, -2, 3, 4, 5]])) + matrix.to_bytes(np.array([[1.0, 2.0]]))
    assert len(raw) == 20 + 32 + 20 + 8 and [x.tolist() for x in matrix.from_bytes(raw)] == [[[1.5, -2, 3, 4, 5]], [[1, 2]]]
    (tmp_path / "b.bin").write_bytes(raw)
    assert matrix.read_binary(spark, str(tmp_path / "b.bin")).count() == 2
    bad = spark.createDataFrame([("nonsense",), ("< 1 1 2 1 1: 1.0 >",), ("< 1 1 2 1 1: 1.0 x >",)], "s string")
    assert matrix.deserialize(bad).count() == 0
    matrix.save_model(spark, learn.Softmax(np.eye(3)), str(tmp_path / "m"))
    assert matrix.load_model(spark, learn.Softmax, str(tmp_path / "m")).weights.tolist() == np.eye(3).tolist()


def test_index_and_time(spark):
    assert [r["prime"] for r in index.primes(spark, 5).collect()] == [2, 3, 5, 7, 11]
    last = index.primes(spark).agg(F.count("i"), F.max("prime")).first()
    assert tuple(last) == (16384, 180503)
    assert one(spark, index.sha1_hex(F.lit("abc"))) == "a9993e364706816aba3e25717850c26c9cd0d89d"
    parts = one(spark, index.to_parts(F.lit(951782400)))
    assert (parts["year"], parts["month"], parts["day"], parts["weekday"], parts["yearday"]) == (2000, 2, 29, 2, 59)


def test_streamed_background_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(c, n, [10.0 + rng.normal(), 90.0 if n % 7 == 6 else 20.0]) for c in (1, 2) for n in range(20)]
    frames = spark.createDataFrame(rows, "camera_id bigint, frame_no bigint, v array<double>")
    models = background.train(frames)
    batch = {(r["camera_id"], r["frame_no"]): r["mask"] for r in background.segment(frames, models).collect()}
    assert any(m[1] for m in batch.values())
    known = {r["camera_id"]: (r["mean"], r["amplitude"]) for r in models.collect()}
    frames.filter("frame_no < 12").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    query = background.segment_stream(stream, known).writeStream.format("memory").queryName("masks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    frames.filter("frame_no >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # two late frames again
    query.processAllAvailable()
    query.stop()
    streamed = {(r["camera_id"], r["frame_no"]): r["mask"] for r in spark.sql("select * from masks").collect()}
    assert streamed == batch


def test_row_stream(spark, tmp_path):
    (tmp_path / "rows").mkdir()
    (tmp_path / "rows" / "a.txt").write_text("1 -1 2 -1 -1\n1.0E+00 2.0\n3 4\n")
    query = background.row_stream(spark, str(tmp_path / "rows")).writeStream.format("memory").queryName("rows_in").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["v"] for r in spark.sql("select v from rows_in").collect()) == [[1, 2], [3, 4]]


def test_ranked_numbers_all_ranges(spark):
    rows = spark.range(5000).select(F.col("id").alias("m"), (F.col("id") * 7919 % 10).alias("k")).repartition(7)
    got = [(r["m"], r["rank"]) for r in frame.ranked(rows, F.desc("k"), F.col("m")).orderBy("rank").collect()]
    want = sorted(range(5000), key=lambda m: (-(m * 7919 % 10), m))
    assert got == [(m, i + 1) for i, m in enumerate(want)]
    assert frame.ranked(rows.filter("m < 0"), F.col("m")).count() == 0


def test_strings_of_each_key(spark):
    rows = spark.createDataFrame([(0, 4, [1.0, -2.5]), (0, 2, [3.0, 0.0]), (1, 9, [7.0])], "k int, m bigint, v array<double>")
    back = matrix.deserialize(matrix.serialize(rows, "k"), keys=("k",)).orderBy("k", "m").collect()
    assert [(r["k"], r["m"], r["v"]) for r in back] == [(0, 0, [3.0, 0.0]), (0, 1, [1.0, -2.5]), (1, 0, [7.0])]


def _largest_difference(rows, q):
    assert len(rows) <= knn.TILE_ROWS
    return np.abs(rows - q).max(axis=1)


@pytest.mark.parametrize("kind", ["euclidean2", "euclidean", "cosine", "histogram_intersection", _largest_difference])
def test_knn_in_tiles_is_the_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 5, (2500, 4)).astype(float)  # with many ties
    data[::50] += rng.random((50, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "m bigint, v array<double>").repartition(2)
    got = {(r["qid"], r["rank"]): r["m"] for r in knn.knn(df, df.filter("m % 7 = 0").select(F.col("m").alias("qid"), "v"), 4, kind if callable(kind) else str(kind), exclude_self=True).collect()}
    for i in range(0, 2500, 7):
        if callable(kind):
            d = np.abs(data - data[i]).max(axis=1)
        else:
            one = np.repeat(data[i : i + 1], len(data), axis=0)
            d = knn._distances(kind, data, data[i : i + 1])[0] if kind == "histogram_intersection" else knn._paired(kind, data, one)
            assert np.allclose(d, knn._distances(kind, data, data[i : i + 1])[0])
        d[i] = np.inf
        assert [got[i, r] for r in (1, 2, 3, 4)] == np.argsort(d, kind="stable")[:4].tolist()


def test_knn_memory_of_a_task_does_not_grow_with_the_queries():
    import tracemalloc

    rng = np.random.default_rng(5)
    rows, queries = rng.random((knn.TILE_ROWS, 16)), rng.random((8 * knn.TILE_QUERIES, 16))
    best_m, best_d = np.full((len(queries), 5), knn._NONE), np.full((len(queries), 5), np.nan)
    peaks = []
    for count in (1, 8):
        tracemalloc.start()
        for at in range(0, count * knn.TILE_QUERIES, knn.TILE_QUERIES):
            own = slice(at, at + knn.TILE_QUERIES)
            knn._nearer("euclidean2", 5, np.arange(len(rows)), rows, queries[own], None, best_m[own], best_d[own])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] and (best_m != knn._NONE).all()


@pytest.mark.parametrize("kind", ["euclidean2", "euclidean", "cosine", "histogram_intersection", _largest_difference])
def test_knn_memory_is_that_of_a_tile_for_every_distance(kind):
    import tracemalloc

    rng = np.random.default_rng(6)
    rows, queries = rng.random((4 * knn.TILE_ROWS, 16)), rng.random((6 * knn.TILE_QUERIES, 16))
    peaks = []
    for some, own in ((rows[: knn.TILE_ROWS], queries[: knn.TILE_QUERIES]), (rows, queries)):
        best_m, best_d = np.full((len(own), 5), knn._NONE), np.full((len(own), 5), np.nan)
        tracemalloc.start()
        knn.nearer_in_tiles(kind, 5, np.arange(len(some)), some, own, None, best_m, best_d)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (best_m != knn._NONE).all()
    assert peaks[1] < 1.2 * peaks[0]  # 24 times the pairs
