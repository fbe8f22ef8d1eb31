"""Queries of clustering and of hierarchical quantisers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import cluster, learn, tree
from ..scratch import stored
from .registry import query, table
from .vector_queries import E, vectors

K = 8
_D2 = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - c.v[i]) * (a.v[i] - c.v[i])))"
_ASSIGNED = f"{E}, d as (select a.m, a.label, c.m as cluster, {_D2} as d2 from e a, e c where c.m < {K}), s as (select m, any_value(label) as label, arg_min(cluster, (d2, cluster))::int as cluster, min(d2) as d2 from d group by m)"


def first_rows(df: DataFrame, k: int = K) -> np.ndarray:
    return np.array([r["v"] for r in df.filter(F.col("m") < k).orderBy("m").collect()], float)


def blobs(spark: SparkSession, k: int = 4, each: int = 200, n: int = 8) -> DataFrame:
    """(m, v, label): well separated groups with a spread that is a fixed function of m and n."""
    noise = lambda i: F.pmod(F.xxhash64(F.lit(3), F.col("id"), i), F.lit(10_001)).cast("double") / 10_000.0 - 0.5
    label = (F.col("id") % k).cast("int")
    return spark.range(k * each).select(F.col("id").alias("m"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % k == F.col("id") % k, 2.0).otherwise(0.0) + noise(i)).alias("v"), label.alias("label"))


def told(spark: SparkSession, got: cluster.Clusters) -> DataFrame:
    rows = [(i, int(c), got.error, got.epochs, m.tolist()) for i, (c, m) in enumerate(zip(got.counts, got.means))]
    return spark.createDataFrame(rows, "cluster int, count bigint, error double, epochs int, mean array<double>")


@query(f"with {_ASSIGNED} select m, cluster, round(d2, 6) as d2 from s")
def kmeans_assign(spark, sf_dir):
    """Each vector's nearest of the first eight."""
    rows = vectors(spark, sf_dir)
    return cluster.assign(rows, first_rows(rows)).select("m", "cluster", F.round("d2", 6).alias("d2"))


@query(f"with {_ASSIGNED} select cluster, n::int as n, count(*) as count, round(avg(v[n + 1]), 6) + 0.0 as mean from s join e using (m), range(64) t(n) group by cluster, n")
def kmeans_one_step(spark, sf_dir):
    """Means after one pass."""
    rows = vectors(spark, sf_dir)
    got = cluster.one_pass(rows, first_rows(rows))
    cells = [(i, n, int(c), float(x / c)) for i, (c, s) in enumerate(zip(got.counts, got.sums)) if c for n, x in enumerate(s)]
    return spark.createDataFrame(cells, "cluster int, n int, count bigint, mean double").withColumn("mean", F.round(F.col("mean") + 0.0, 6))


@query(f"with {_ASSIGNED}, c as (select cluster, label, count(*) as c from s group by cluster, label) select round(sum(most) / sum(al), 6) as purity from (select max(c) as most, sum(c) as al from c group by cluster)")
def kmeans_purity(spark, sf_dir):
    from ..operators import agg

    rows = vectors(spark, sf_dir)
    return agg.purity(cluster.assign(rows, first_rows(rows))).select(F.round("purity", 6).alias("purity"))


def _fixpoint(rows: DataFrame, got: cluster.Clusters) -> DataFrame:
    """What clusters that have settled must fulfil: every mean is that of its rows, and the error is their squared distances'."""
    means = _means(rows.sparkSession, got)
    placed = cluster.assign(rows, got.means)
    own = placed.select("cluster", F.posexplode("v").alias("n", "x")).groupBy("cluster", "n").agg(F.avg("x").alias("x"))
    off = own.join(means, ["cluster", "n"], "full").agg(F.max(F.abs(F.col("x") - F.col("mean"))).alias("off"))
    told = placed.agg(F.count(F.lit(1)).alias("rows"), F.sum("d2").alias("d2"))
    return told.join(off).select("rows", F.lit(len(got.means)).alias("clusters"), F.lit(int(got.counts.sum())).cast("bigint").alias("counted"), F.round("off", 6).alias("off"), F.round(F.abs(F.col("d2") - got.error), 6).alias("error_off"))


def _means(spark: SparkSession, got: cluster.Clusters) -> DataFrame:
    """(cluster, n, mean) of the clusters that have rows."""
    return spark.createDataFrame([(i, n, float(x)) for i, (c, m) in enumerate(zip(got.counts, got.means)) if c for n, x in enumerate(m)], "cluster int, n int, mean double")


_settled = lambda k: f"select count(*) as rows, {k} as clusters, count(*) as counted, 0.0 as off, 0.0 as error_off from embeddings"


@query(_settled(10))
def kmeans(spark, sf_dir):
    """K-means++ seeds, then passes until no row moves."""
    rows = vectors(spark, sf_dir)
    return _fixpoint(rows, cluster.kmeans(rows, 10))


@query(_settled(6))
def kmeans_init_dist(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _fixpoint(rows, cluster.lloyd(rows, cluster.seed_farthest(rows, 6)))


@query(_settled(6))
def kmeans_init_rand(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _fixpoint(rows, cluster.lloyd(rows, cluster.seed_random(6, 64)))


def _lloyd_sql(steps: int) -> str:
    """Means and counts of so many passes from the first eight vectors."""
    out = f"with {E}, m0 as (select m as cluster, v from e where m < {K})"
    for s in range(steps):
        out += f", s{s} as (select m, arg_min(cluster, (d2, cluster)) as cluster from (select a.m, c.cluster, {_D2} as d2 from e a, m{s} c) group by m)"
        out += f", u{s} as (select cluster, list(x order by n) as v from (select cluster, n, avg(e.v[n + 1]) as x from s{s} join e using (m), range(64) t(n) group by cluster, n) group by cluster)"
        out += f", m{s + 1} as (select o.cluster, coalesce(u.v, o.v) as v from m{s} o left join u{s} u using (cluster))"
    return out + f" select cluster::int as cluster, n::int as n, round(v[n + 1], 6) + 0.0 as mean from m{steps}, range(64) t(n)"


@query(_lloyd_sql(3))
def kmeans_steps(spark, sf_dir):
    """Means after three whole passes from the first eight vectors; an empty cluster keeps its mean."""
    rows = vectors(spark, sf_dir)
    got = cluster.lloyd(rows, first_rows(rows), 4)  # the fourth pass counts with the means of the third
    cells = [(i, n, float(x)) for i, m in enumerate(got.means) for n, x in enumerate(m)]
    return spark.createDataFrame(cells, "cluster int, n int, mean double").select("cluster", "n", F.round(F.col("mean") + 0.0, 6).alias("mean"))


@query()
def lbgu(spark, sf_dir):
    return told(spark, cluster.lbgu(vectors(spark, sf_dir), 6, 10, 3))


@query()
def xmeans(spark, sf_dir):
    return told(spark, cluster.xmeans(vectors(spark, sf_dir), 6, 5))


@query()
def knb(spark, sf_dir):
    """Clusters of Gaussians."""
    rows = vectors(spark, sf_dir)
    models = cluster.gaussian_clusters(rows, 4)
    return cluster.apply_scores(rows, lambda data: cluster.log_scores(models, data)).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("rows"))


@query()
def klr(spark, sf_dir):
    """Clusters of softmax regressors."""
    rows = vectors(spark, sf_dir)
    return cluster.apply_scores(rows, learn.kmeans_regression(rows, 4, max_epoch=2).scores).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("rows"))


@query()
def som(spark, sf_dir):
    units = cluster.som(vectors(spark, sf_dir), 3, 4, 6)
    return spark.createDataFrame([(i // 4, i % 4, u.tolist()) for i, u in enumerate(units)], "row int, col int, v array<double>")


def _som_sql(epochs: int, max_epoch: int) -> str:
    """Units of a 3 x 4 map after one pass in each epoch, from the first twelve vectors."""
    out = f"with {E}, g as (select count(*) as rows from e), m0 as (select m as cluster, v from e where m < 12)"
    for s in range(epochs):
        radius = int(2.4 * np.exp(-s * np.log(2.4) / max_epoch))
        out += f", p{s} as (select u, k, exp(-d2 / {2.0 * radius * radius}) as w from (select u, k, pow(u // 4 - k // 4, 2) + pow(u % 4 - k % 4, 2) as d2 from range(12) a(u), range(12) b(k)) where d2 < {radius * radius})"
        out += f", s{s} as (select m, arg_min(cluster, (d2, cluster)) as k from (select a.m, c.cluster, {_D2} as d2 from e a, m{s} c) group by m)"
        out += f", z{s} as (select k, n, count(*) as c, sum(e.v[n + 1]) as x from s{s} join e using (m), range(64) t(n) group by k, n)"
        out += f", q{s} as (select u, n, sum(w * x) as x, sum(w * c) as mass from p{s} join z{s} using (k) group by u, n)"
        out += f", m{s + 1} as (select cluster, list(x order by n) as v from (select cluster, t.n, o.v[t.n + 1] + {40.0 / max_epoch} / rows * (coalesce(q.x, 0) - coalesce(q.mass, 0) * o.v[t.n + 1]) as x from g, m{s} o cross join range(64) t(n) left join q{s} q on q.u = o.cluster and q.n = t.n) group by cluster)"
    return out + f" select cluster::int as unit, n::int as n, round(v[n + 1], 6) + 0.0 as x from m{epochs}, range(64) t(n)"


@query(_som_sql(3, 60))
def som_epochs(spark, sf_dir):
    """A map after three epochs over all vectors, in two ranges."""
    rows = vectors(spark, sf_dir)
    units = cluster.som_epochs(rows, first_rows(rows, 12), 4, 0, 1, 60, passes=1)
    units = cluster.som_epochs(rows, units, 4, 1, 3, 60, passes=1)
    cells = [(u, n, float(x)) for (u, n), x in np.ndenumerate(units)]
    return spark.createDataFrame(cells, "unit int, n int, x double").select("unit", "n", F.round(F.col("x") + 0.0, 6).alias("x"))


@query(f"with {E} select unit::int as unit, true as same, (select count(*) from e) as rows, true as nearer from range(12) t(unit)")
def som_online(spark, sf_dir):
    """Two ranges of epochs of micro-batches give the units of one run, from all vectors, and come nearer to them than the start."""
    rows = vectors(spark, sf_dir)
    data, start, rate = cluster.som_stream(rows, 4), first_rows(rows, 12), 20.0
    once = cluster.som_online(data, start, 4, 0, 3, 3, 1, rate)
    half = cluster.som_online(data, start, 4, 0, 2, 3, 1, rate)
    twice = cluster.som_online(data, half, 4, 2, 3, 3, 1, rate)
    nearer = bool(cluster.one_pass(data.rows, once).error.sum() < cluster.one_pass(data.rows, start).error.sum())
    data.close()
    told = [(u, bool(np.array_equal(a, b)), data.total, nearer) for u, (a, b) in enumerate(zip(once, twice))]
    return spark.createDataFrame(told, "unit int, same boolean, rows bigint, nearer boolean")


_PLSI_STEPS = 3


def _plsi_sql() -> str:
    begun = lambda key, a, b, m: f"select {key}, z, p / sum(p) over (partition by z) as p from (select {key}, z, (1 + ({key} * {a} + z * {b}) % {m})::double as p from (select distinct {key} from c), range(2) t(z))"
    out = f"with c as (select l_suppkey as d, l_partkey % 50 as w, sum(l_quantity)::double as n from lineitem group by d, w), z0 as (select z, 0.5::double as p from range(2) t(z)), d0 as ({begun('d', 7, 3, 5)}), w0 as ({begun('w', 5, 11, 7)})"
    for s in range(_PLSI_STEPS):
        out += f", j{s} as (select c.d, c.w, d.z, n, z.p * pow(d.p * w.p, {1000.0 / (1000 + s)}) as p from c join d{s} d on d.d = c.d join w{s} w on w.w = c.w and w.z = d.z join z{s} z on z.z = d.z)"
        out += f", q{s} as (select d, w, z, n * p / sum(p) over (partition by d, w) as p from j{s})"
        out += f", d{s + 1} as (select d, z, sum(p) / sum(sum(p)) over (partition by z) as p from q{s} group by d, z), w{s + 1} as (select w, z, sum(p) / sum(sum(p)) over (partition by z) as p from q{s} group by w, z), z{s + 1} as (select z, sum(p) / sum(sum(p)) over () as p from q{s} group by z)"
    return out + f" select w, round(max(p) filter (z = 0), 6) as z0, round(max(p) filter (z = 1), 6) as z1 from w{_PLSI_STEPS} group by w"


@query(_plsi_sql())
def plsi(spark, sf_dir):
    """Two topics of suppliers and groups of parts, weighed by quantity, after three steps from a stated start."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("d"), (F.col("l_partkey") % 50).alias("w")).agg(F.sum(F.col("l_quantity").cast("double")).alias("n"))
    counts = stored(rows, "counts")
    begun = lambda key, a, b, m: counts.select(key).distinct().select(key, F.array(*((F.lit(1) + (F.col(key) * a + z * b) % m).cast("double") for z in range(2))).alias("p"))
    got = cluster.plsi(counts, 2, _PLSI_STEPS, start=(begun("d", 7, 3, 5), begun("w", 5, 11, 7)))
    return got.w.select("w", F.round(F.col("p")[0], 6).alias("z0"), F.round(F.col("p")[1], 6).alias("z1"))


def _leaves(df: DataFrame, own: tree.Tree) -> DataFrame:
    return tree.label(df, own).groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("dist"), 6).alias("dist"))


def _tree_sql(shape: list[int], passes: int) -> str:
    """Level by level: every node begins with its first rows, then assigns and averages; the last pass moves no mean."""
    out = f"with {E}, r0 as (select m, v, 0 as node from e)"
    d2 = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - c.v[i]) * (a.v[i] - c.v[i])))"
    for y, fan in enumerate(shape):
        out += f", m{y}_0 as (select node, row_number() over (partition by node order by m) - 1 as child, v from r{y} qualify row_number() over (partition by node order by m) <= {fan})"
        for s in range(passes):
            out += f", s{y}_{s} as (select a.m, a.node, arg_min(child, (({d2}), child)) as child, min({d2}) as d2 from r{y} a join m{y}_{s} c using (node) group by a.m, a.node)"
            if s < passes - 1:
                out += f", u{y}_{s} as (select node, child, list(x order by n) as v from (select s.node, s.child, n, avg(r.v[n + 1]) as x from s{y}_{s} s join r{y} r using (m), range(64) t(n) group by s.node, s.child, n) group by node, child)"
                out += f", m{y}_{s + 1} as (select o.node, o.child, coalesce(u.v, o.v) as v from m{y}_{s} o left join u{y}_{s} u using (node, child))"
        out += f", r{y + 1} as (select m, r.v, s.node * {fan} + s.child as node, s.d2 from s{y}_{passes - 1} s join r{y} r using (m))"
    return out + f" select node as leaf, count(*) as rows, round(avg(d2), 6) as dist from r{len(shape)} group by node"


@query(_tree_sql([4, 2], 3))
def kmeans_tree(spark, sf_dir):
    """Leaves of a tree whose nodes begin with their first rows."""
    rows = vectors(spark, sf_dir)
    return _leaves(rows, tree.kmeans_tree(rows, [4, 2], 3, seeding="first"))


@query()
def kmeans_tree_beam(spark, sf_dir):
    """Leaves with the two best parents tried, in a tree that inherits its first level."""
    rows = vectors(spark, sf_dir)
    base = tree.kmeans_tree(rows, [3], 5)
    own = tree.kmeans_tree(rows, [3, 2], 5, base=base)
    return tree.label(rows, own, beam=2).select("m", "leaf", F.round("dist", 6).alias("dist"))


@query()
def pca_kmeans_tree(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _leaves(rows, tree.pca_kmeans_tree(rows, [3, 2], 8, 5))


@query()
def klr_tree(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    own = tree.regression_tree(rows, [2, 2], learn.SoftmaxParams(5), 1)
    return tree.label(rows, own).groupBy("leaf", "label").agg(F.count(F.lit(1)).alias("rows"))


@query("select i as m, i // 4 as parent, i % 4 as child, (i // 4) * 4 + i % 4 as leaf from range(16) t(i)")
def tree_paths(spark, sf_dir):
    """A leaf is its path in mixed radix."""
    m = F.col("id")
    return spark.range(16).select(m.alias("m"), vec.row_of(m, 4).alias("parent"), vec.col_of(m, 4).alias("child"), vec.index_of(vec.row_of(m, 4), vec.col_of(m, 4), 4).alias("leaf"))
