"""Queries of vector expressions, frames, aggregates, linear algebra, neighbours and scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import agg, frame, knn, linalg, scale, vector_index
from .registry import QUERIES, SQL, query, table

E = "e as (select vec_id as m, list_transform(embedding, lambda x: x::double) as v, label from embeddings)"
N = "range(1, len(a.v) + 1)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m, v, w): each vector with the next one by id."""
    rows = vectors(spark, sf_dir).select("m", "v")
    return rows.join(rows.select((F.col("m") - 1).alias("m"), F.col("v").alias("w")), "m")


def cells(df: DataFrame, v) -> DataFrame:
    return df.select("m", F.posexplode(v).alias("n", "x")).select("m", "n", F.round(F.col("x") + 0.0, 6).alias("x"))


def _unnest(expression: str, source: str) -> str:
    return f"with {E}, r as (select m, unnest(range(len(o))) as n, unnest(o) as x from (select a.m, {expression} as o from {source})) select m, n::int as n, round(x, 6) + 0.0 as x from r"


def _elementwise(name: str, build, expression: str, two: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = pairs(spark, sf_dir) if two else vectors(spark, sf_dir)
        return cells(df, build())

    run.__doc__ = f"(m, n, x): {name.replace('_', ' ')} of each vector" + (" and the next one." if two else ".")
    QUERIES[name] = run
    SQL[name] = _unnest(expression, "e a join e b on b.m = a.m + 1" if two else "e a")


_one = lambda body: f"list_transform(a.v, lambda x: {body})"
_two = lambda body: f"list_transform({N}, lambda i: {body})"
_elementwise("vec_sqrt", lambda: vec.vsqrt(vec.each("v", F.abs)), _one("sqrt(abs(x))"))
_elementwise("vec_not10", lambda: vec.vnot(vec.each("v", lambda x: F.when(x > 0, x).otherwise(0.0))), _one("case when x > 0 then 0.0 else 1.0 end"))
_elementwise("vec_pows", lambda: vec.vpow("v", 3.0), _one("pow(x, 3)"))
_elementwise("vec_adds", lambda: vec.adds("v", 0.5), _one("x + 0.5"))
_elementwise("vec_subs", lambda: vec.subs("v", 0.5), _one("x - 0.5"))
_elementwise("vec_muls", lambda: vec.muls("v", 2.5), _one("x * 2.5"))
_elementwise("vec_divs", lambda: vec.divs("v", 2.5), _one("x / 2.5"))
_elementwise("vec_inv", lambda: vec.vinv(vec.adds("v", 2.0)), _one("1 / (x + 2)"))
_elementwise("vec_clip", lambda: vec.clip("v", -0.1, 0.1), _one("greatest(least(x, 0.1), -0.1)"))
_elementwise("vec_sign", lambda: vec.each("v", vec.sign), _one("case when x >= 0 then 1.0 else -1.0 end"))
_elementwise("vec_sigmoid", lambda: vec.each("v", vec.sigmoid), _one("1 / (1 + exp(-x))"))
_elementwise("vec_log2", lambda: vec.each("v", lambda x: vec.log2(F.abs(x) + 1.0)), _one("log2(abs(x) + 1)"))
_elementwise("vec_round", lambda: vec.each("v", lambda x: vec.round_half(x * 10.0)), _one("trunc(x * 10 + 0.5)"))
_elementwise("vec_fill", lambda: vec.fill("v", 1.5), _one("1.5"))
_elementwise("matrix_scale", lambda: vec.muls("v", 3.0), _one("x * 3"))
_elementwise("vec_add", lambda: vec.add("v", "w"), _two("a.v[i] + b.v[i]"), True)
_elementwise("vec_sub", lambda: vec.sub("v", "w"), _two("a.v[i] - b.v[i]"), True)
_elementwise("vec_mul", lambda: vec.mul("v", "w"), _two("a.v[i] * b.v[i]"), True)
_elementwise("vec_div", lambda: vec.div("v", vec.adds("w", 2.0)), _two("a.v[i] / (b.v[i] + 2)"), True)
_elementwise("vec_max", lambda: vec.vmax("v", "w"), _two("greatest(a.v[i], b.v[i])"), True)
_elementwise("vec_min", lambda: vec.vmin("v", "w"), _two("least(a.v[i], b.v[i])"), True)
_elementwise("vec_in_range", lambda: vec.in_range("v", vec.subs("w", 0.1), vec.adds("w", 0.1)), _two("case when b.v[i] - 0.1 <= a.v[i] and a.v[i] <= b.v[i] + 0.1 then 1.0 else 0.0 end"), True)
_elementwise("vec_subsm", lambda: vec.subs_masked("w", "v", 0.25, vec.in_range("v", vec.fill("v", 0.0), vec.fill("v", 9.0))), _two("case when a.v[i] >= 0 then a.v[i] - 0.25 else b.v[i] end"), True)
_elementwise("normalize_l1", lambda: vec.normalize_l1("v"), _one("x / list_sum(list_transform(a.v, lambda y: abs(y)))"))
_elementwise("normalize_l2", lambda: vec.normalize_l2(vec.muls("v", 3.0)), _one("x / sqrt(list_sum(list_transform(a.v, lambda y: y * y)))"))
_elementwise("normalize_shift", lambda: vec.normalize_shift("v", 0.0, 255.0), _one("(x - list_min(a.v)) * 255 / (list_max(a.v) - list_min(a.v))"))
_elementwise("standardize_local", lambda: vec.standardize_local("v", 0.01), _one("(x - list_avg(a.v)) / sqrt(list_var_samp(a.v) + 0.01)"))


def _scalar(name: str, build, expression: str, two: bool = False, whole: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = pairs(spark, sf_dir) if two else vectors(spark, sf_dir)
        value = build()
        return df.select("m", (value if whole else F.round(value + 0.0, 6)).alias("value"))

    run.__doc__ = f"(m, value): {name.replace('_', ' ')}" + (" with the next vector." if two else ".")
    QUERIES[name] = run
    value = expression if whole else f"round({expression}, 6) + 0.0"
    SQL[name] = f"with {E} select a.m, {value} as value from " + ("e a join e b on b.m = a.m + 1" if two else "e a")


_scalar("vec_dot", lambda: vec.dot("v", "w"), "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))", True)
_scalar("vec_norm", lambda: vec.norm("v"), "sqrt(list_sum(list_transform(a.v, lambda x: x * x)))")
_scalar("vec_sum", lambda: vec.total("v"), "list_sum(a.v)")
_scalar("vec_mean", lambda: vec.mean("v"), "list_avg(a.v)")
_scalar("vec_var", lambda: vec.variance("v"), "list_var_samp(a.v)")
_scalar("vec_var_about", lambda: vec.variance("v", F.lit(0.1)), "list_sum(list_transform(a.v, lambda x: (x - 0.1) * (x - 0.1))) / (len(a.v) - 1)")
_scalar("vec_maxs", lambda: vec.maximum("v"), "list_max(a.v)")
_scalar("vec_mins", lambda: vec.minimum("v"), "list_min(a.v)")
_scalar("vec_absmax", lambda: vec.absmax("v"), "list_max(list_transform(a.v, lambda x: abs(x)))")
_scalar("vec_argmax", lambda: vec.argmax("v"), "(list_position(a.v, list_max(a.v)) - 1)::int", whole=True)
_scalar("vec_argmin", lambda: vec.argmin("v"), "(list_position(a.v, list_min(a.v)) - 1)::int", whole=True)
_scalar("vec_nonzero_index", lambda: vec.nonzero_index(vec.each("v", lambda x: F.when(x > 0.1, x).otherwise(0.0)), 4, 64), "coalesce(list_min(list_filter(range(4, 64), lambda i: a.v[i + 1] > 0.1)), -1)::int", whole=True)
_scalar("vec_find_index", lambda: vec.find_index(vec.each("v", vec.sign), 8, 64, 1.0), "coalesce(list_min(list_filter(range(8, 64), lambda i: a.v[i + 1] >= 0)), -1)::int", whole=True)
_scalar("vec_eq", lambda: vec.equal(vec.each("v", vec.sign), vec.each("w", vec.sign)), "list_transform(a.v, lambda x: x >= 0) = list_transform(b.v, lambda x: x >= 0)", True, True)
_scalar("euclidean", lambda: vec.euclidean("v", "w"), "sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))", True)
_scalar("euclidean2", lambda: vec.euclidean2("v", "w"), "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))", True)
_scalar("cosine", lambda: vec.cosine("v", "w"), "1 - list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / sqrt(list_sum(list_transform(a.v, lambda x: x * x))) / sqrt(list_sum(list_transform(b.v, lambda x: x * x)))", True)
_scalar("histogram_intersection", lambda: vec.histogram_intersection(vec.each("v", F.abs), vec.each("w", F.abs)), "1 - list_sum(list_transform(range(1, len(a.v) + 1), lambda i: least(abs(a.v[i]), abs(b.v[i])))) / list_sum(list_transform(b.v, lambda x: abs(x)))", True)


# Frames.
@query(f"with {E} select m, n, round(x, 6) + 0.0 as x from (select m, unnest(range(16)) as n, unnest(v[9:24]) as x from e where m between 10 and 29)")
def frame_block(spark, sf_dir):
    return cells(frame.block(vectors(spark, sf_dir).select("m", "v"), 10, 20, 8, 16), F.col("v")).withColumn("n", F.col("n").cast("bigint"))


@query(f"with {E} select m, rank, round(x, 6) + 0.0 as x from (select m, v[4] as x, row_number() over (order by v[4] desc, m) as rank from e)")
def sort_rows(spark, sf_dir):
    """All rows in falling order of one element, with their rank."""
    rows = vectors(spark, sf_dir).select("m", F.element_at("v", 4).alias("x"))
    return frame.ranked(rows, F.desc("x"), F.col("m")).select("m", "rank", F.round(F.col("x") + 0.0, 6).alias("x"))


@query(f"with {E} select count(*) as rows, sum(m)::bigint as ids, round(sum(list_sum(v)), 4) as total from (select m, v from e where m not between 5 and 14 union all select m - 100 + 5, v from e where m between 100 and 109)")
def copy_rows(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("m", "v")
    return frame.copy_rows(rows, 5, rows, 100, 10).agg(F.count(F.lit(1)).alias("rows"), F.sum("m").alias("ids"), F.round(F.sum(vec.total("v")), 4).alias("total"))


@query(f"with {E} select a.m, n::int as n, round(case when n = 0 then b.v[6] else a.v[n + 1] end, 6) + 0.0 as x from e a join e b on a.m = b.m, range(64) t(n)")
def copy_column(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("m", "v")
    return cells(frame.copy_column(rows, 0, rows, 5), F.col("v"))


@query(f"with {E} select m, (i // 8)::int as part, (i % 8)::int as n, round(v[i + 1], 6) + 0.0 as x from e, range(64) t(i)")
def unfold(spark, sf_dir):
    out = frame.unfold(vectors(spark, sf_dir).select("m", "v"), 8)
    return out.select("m", "part", F.posexplode("v").alias("n", "x")).select("m", "part", "n", F.round(F.col("x") + 0.0, 6).alias("x"))


@query("select o_orderkey as m, case when ('0x' || md5(o_orderkey::varchar || '-11')[1:8])::bigint % 4 < 1 then 'test' else 'train' end as split from orders")
def split_train_test(spark, sf_dir):
    return frame.split(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("m")), "m", 11)


@query("select o_orderkey as m, row_number() over (order by md5(o_orderkey::varchar || '-7'), o_orderkey) as rank from orders")
def shuffle_hash(spark, sf_dir):
    """Every row's place in a seeded shuffle."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("m"))
    return frame.ranked(rows, frame.shuffle_key(F.col("m"), 7), F.col("m"))


@query("select i // 7 as row, i % 7 as col, (i // 7) * 7 + i % 7 as m from range(100) t(i)")
def row_addressing(spark, sf_dir):
    m = F.col("id")
    row, col = vec.row_of(m, 7), vec.col_of(m, 7)
    return spark.range(100).select(row.alias("row"), col.alias("col"), vec.index_of(row, col, 7).alias("m"))


# Aggregates.
@query(f"with {E}, c as (select unnest(range(64)) as n, unnest(v) as x from e) select n::int as n, round(avg(x), 6) + 0.0 as mean from c group by n")
def col_mean(spark, sf_dir):
    return agg.column_mean(vectors(spark, sf_dir)).select("n", F.round(F.col("mean") + 0.0, 6).alias("mean"))


@query(f"with {E}, c as (select unnest(range(64)) as n, unnest(v) as x from e) select n::int as n, round(var_samp(x), 6) as variance from c group by n")
def col_var(spark, sf_dir):
    return agg.column_variance(vectors(spark, sf_dir)).select("n", F.round("variance", 6).alias("variance"))


@query(f"with {E}, c as (select m, unnest(range(64)) as n, unnest(v) as x from e) select a.n::int as i, b.n::int as j, round(covar_samp(a.x, b.x), 6) + 0.0 as cov from c a join c b using (m) group by a.n, b.n")
def cov_matrix(spark, sf_dir):
    return agg.covariance_cells(vectors(spark, sf_dir)).select("i", "j", F.round(F.col("cov") + 0.0, 6).alias("cov"))


for _name, _run, _score in (
    ("row_max_norm", agg.max_norm_row, "-list_sum(list_transform(v, lambda x: x * x * x * x))"),
    ("row_min_norm", agg.min_norm_row, "list_sum(list_transform(v, lambda x: x * x * x * x))"),
    ("row_max_sum", agg.max_sum_row, "-list_sum(list_transform(v, lambda x: x * x))"),
    ("row_min_sum", agg.min_sum_row, "list_sum(list_transform(v, lambda x: x * x))"),
):
    # The vectors are of unit length, so the squares and their rounded sums would tie: norms are taken of the squares, sums of the plain elements.
    if "norm" in _name:
        QUERIES[_name] = lambda spark, sf_dir, f=_run: f(vectors(spark, sf_dir).select("m", vec.each("v", lambda x: x * x).alias("v")))
        SQL[_name] = f"with {E} select m from e order by {_score}, m limit 1"
    else:
        QUERIES[_name] = lambda spark, sf_dir, f=_run: f(vectors(spark, sf_dir))
        SQL[_name] = f"with {E} select m from e order by {'-' if 'max' in _name else ''}list_sum(v), m limit 1"


@query(f"with {E}, g as (select min(list_min(v)) as lo, max(list_max(v)) as hi from e) select m, n::int as n, round((v[n + 1] - lo) / (hi - lo), 6) + 0.0 as x from e, g, range(64) t(n)")
def global_minmax_scale(spark, sf_dir):
    return cells(agg.scale_to_range(vectors(spark, sf_dir), 0.0, 1.0), F.col("v"))


@query(f"with {E}, c as (select list_position(v, list_max(v)) % 7 as cluster, label, count(*) as c from e group by 1, 2) select round(sum(most) / sum(al), 6) as purity from (select max(c) as most, sum(c) as al from c group by cluster)")
def purity(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(((vec.argmax("v") + 1) % 7).alias("cluster"), "label")
    return agg.purity(rows).select(F.round("purity", 6).alias("purity"))


# Linear algebra.
@query(f"with {E}, c as (select m as i, unnest(range(64)) as j, unnest(v) as x from e), g as (select a.j as i, b.j as j, sum(a.x * b.x) as x from c a join c b using (i) group by a.j, b.j) select c.i, g.j, round(sum(c.x * g.x), 5) + 0.0 as x from c join g on c.j = g.i group by c.i, g.j")
def matmul_coo(spark, sf_dir):
    """All vectors times their own 64 by 64 product."""
    a = linalg.cells(vectors(spark, sf_dir))
    return linalg.multiply(a, linalg.multiply(a, a, transpose_a=True)).select("i", "j", F.round(F.col("x") + 0.0, 5).alias("x"))


@query(f"with {E}, c as (select m as i, unnest(range(64)) as j, unnest(v) as x from e) select a.j as i, b.j, round(sum(a.x * b.x), 5) + 0.0 as x from c a join c b using (i) group by a.j, b.j")
def matmul_gram(spark, sf_dir):
    a = linalg.cells(vectors(spark, sf_dir))
    return linalg.multiply(a, a, transpose_a=True).select("i", "j", F.round(F.col("x") + 0.0, 5).alias("x"))


@query(f"with {E} select n as i, m as j, round(v[n + 1], 6) + 0.0 as x from e, range(64) t(n)")
def transpose(spark, sf_dir):
    return linalg.transpose(linalg.cells(vectors(spark, sf_dir))).select("i", "j", F.round(F.col("x") + 0.0, 6).alias("x"))


@query(f"with {E}, c as (select m as i, unnest(range(64)) as j, unnest(v) as x from e) select i, j, round(x - x * 2 + 1, 6) + 0.0 as x from c")
def matrix_sub(spark, sf_dir):
    a = linalg.cells(vectors(spark, sf_dir))
    return linalg.combine(a, linalg.scaled(a, 2.0, -1.0), minus=True).select("i", "j", F.round(F.col("x") + 0.0, 6).alias("x"))


@query(f"with {E}, c as (select m as i, unnest(range(64)) as j, unnest(v) as x from e) select i, j, round(x * 3, 6) + 0.0 as x from c")
def matrix_add(spark, sf_dir):
    a = linalg.cells(vectors(spark, sf_dir))
    return linalg.combine(a, linalg.scaled(a, 2.0)).select("i", "j", F.round(F.col("x") + 0.0, 6).alias("x"))


@query(f"with {E} select i, j, case when i = j then round(avg(v[i + 1]), 6) + 0.0 else 0.0 end as x from e, range(64) t(i), range(64) u(j) group by i, j")
def diag(spark, sf_dir):
    """The mean of all vectors as the diagonal of a matrix."""
    mean = frame.assemble(frame.explode(vectors(spark, sf_dir)).groupBy("n").agg(F.avg("x").alias("x")).withColumn("m", F.lit(0)))
    return linalg.diagonal(mean).select("i", "j", F.round(F.col("x") + 0.0, 6).alias("x"))


@query(f"with {E} select a.m, b.m as n, round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])), 6) + 0.0 as x from e a, e b where b.m < 8")
def matvec(spark, sf_dir):
    """All vectors times the rows of a small matrix, which is made of the first eight vectors."""
    rows = vectors(spark, sf_dir).select("m", "v")
    small = np.array([r["v"] for r in rows.filter("m < 8").orderBy("m").collect()])
    out = linalg.times_matrix(rows, small)
    return out.select("m", F.posexplode("v").alias("n", "x")).select("m", F.col("n").cast("bigint").alias("n"), F.round(F.col("x") + 0.0, 6).alias("x"))


@query()
def eigen(spark, sf_dir):
    """(k, value, n, x): all eigenpairs of the covariance matrix."""
    model = linalg.principal_components(vectors(spark, sf_dir))
    return spark.createDataFrame([(k, float(v), n, float(x)) for k, (v, row) in enumerate(zip(model.values, model.vectors)) for n, x in enumerate(row)], "k int, value double, n int, x double")


@query(f"with {E}, c as (select m, unnest(range(64)) as n, unnest(v) as x from e), s as (select var_samp(x) as s from c group by n) select 64 as pairs, round(sum(s), 6) as total, 0.0 as residual, 1.0 as norm, true as falling from s")
def eigen_proof(spark, sf_dir):
    """What all eigenpairs of the covariance matrix must fulfil: C v = value * v, unit length, values that fall and add up to the trace."""
    rows = vectors(spark, sf_dir)
    model = linalg.principal_components(rows)
    pairs = [(k, float(w), n, float(x)) for k, (w, row) in enumerate(zip(model.values, model.vectors)) for n, x in enumerate(row)]
    v = spark.createDataFrame(pairs, "k int, value double, j int, x double")
    moved = agg.covariance_cells(rows).join(v, "j").groupBy("k", F.col("i").alias("j")).agg(F.sum(F.col("cov") * F.col("x")).alias("y"))
    told = moved.join(v, ["k", "j"]).groupBy("k", "value").agg(F.max(F.abs(F.col("y") - F.col("value") * F.col("x"))).alias("off"), F.sum(F.col("x") * F.col("x")).alias("norm"))
    falling = F.array_sort(F.collect_list(F.struct("k", "value")))
    told = told.agg(F.count(F.lit(1)).cast("int").alias("pairs"), F.sum("value").alias("total"), F.max("off").alias("residual"), F.max(F.abs(F.col("norm") - 1)).alias("norm"), falling.alias("f"))
    ok = F.forall(F.sequence(F.lit(1), F.size("f") - 1), lambda i: F.get("f", i)["value"] <= F.get("f", i - 1)["value"])
    return told.select("pairs", F.round("total", 6).alias("total"), F.round("residual", 6).alias("residual"), F.round(F.col("norm") + 1, 6).alias("norm"), ok.alias("falling"))


@query("select * from (values (0, 0, 3, 20.0), (0, 1, 2, 20.0), (0, 2, 1, 20.0), (0, 3, 0, 20.0), (1, 0, 2, 10.0), (1, 1, 1, 10.0), (1, 2, 0, 10.0), (1, 3, -1, 10.0)) t(problem_id, task, worker, total)")
def assignment(spark, sf_dir):
    """Two cost matrices of (task + 1) * (worker + 1): square, and with a task too many."""
    rows = [(p, t, w, float((t + 1) * (w + 1))) for p, workers in ((0, 4), (1, 3)) for t in range(4) for w in range(workers)]
    return linalg.assign_all(spark.createDataFrame(rows, "problem_id int, task int, worker int, cost double"))


# Neighbours.
def _near(distance: str, k: int) -> str:
    return f"with {E}, p as (select q.m as qid, b.m, {distance} as dist from e q, e b where q.m % 20 = 0 and b.m <> q.m), r as (select *, row_number() over (partition by qid order by round(dist, 12), m) as rank from p) select qid, rank::int as rank, m, round(dist, 6) + 0.0 as dist from r where rank <= {k}"


_D2 = "list_sum(list_transform(range(1, 65), lambda i: (b.v[i] - q.v[i]) * (b.v[i] - q.v[i])))"
_COS = "1 - list_sum(list_transform(range(1, 65), lambda i: b.v[i] * q.v[i])) / sqrt(list_sum(list_transform(b.v, lambda x: x * x))) / sqrt(list_sum(list_transform(q.v, lambda x: x * x)))"
_HIST = "1 - list_sum(list_transform(range(1, 65), lambda i: least(b.v[i], q.v[i]))) / list_sum(q.v)"


def _queries_of(rows: DataFrame) -> DataFrame:
    """Every twentieth vector is a query, against all of them."""
    return rows.filter("m % 20 = 0").select(F.col("m").alias("qid"), "v")


def _told(out: DataFrame) -> DataFrame:
    return out.select("qid", "rank", "m", F.round(F.col("dist") + 0.0, 6).alias("dist"))


@query(_near(_D2, 5))
def knn_euclid(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _told(knn.knn(rows, _queries_of(rows), 5, "euclidean2", exclude_self=True))


@query(_near(_D2, 5))
def vector_index_exact(spark, sf_dir):
    """The neighbours of `knn_euclid` by an index: lists of the nearest cells, then those that may hold a nearer row."""
    rows = vectors(spark, sf_dir)
    index = vector_index.build(rows, 16)
    return _told(vector_index.search(index, _queries_of(rows), 5, 4, exact=True, exclude_self=True))


@query(f"with {E} select count(*) filter (m % 20 = 0) as queries, 5 * count(*) filter (m % 20 = 0) as neighbours, true as enough from e")
def vector_index_recall(spark, sf_dir):
    """Whether nine in ten of the true neighbours are in the lists that other rows' neighbours needed."""
    rows = vectors(spark, sf_dir)
    index = vector_index.build(rows, 16)
    found = vector_index.search(index, _queries_of(rows), 5, vector_index.probes_for(index, 5, 0.95), exclude_self=True)
    truth = knn.knn(rows, _queries_of(rows), 5, exclude_self=True)
    hits = truth.join(found.select("qid", "m", F.lit(1).alias("hit")), ["qid", "m"], "left")
    return hits.agg(F.count_distinct("qid").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query(_near(_COS, 5))
def knn_cosine(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _told(knn.knn(rows, _queries_of(rows), 5, "cosine", exclude_self=True))


@query(_near(_HIST, 5).replace("embedding, lambda x: x::double", "embedding, lambda x: abs(x::double)"))
def knn_hist(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("m", vec.each("v", F.abs).alias("v"))
    return _told(knn.knn(rows, _queries_of(rows), 5, "histogram_intersection", exclude_self=True))


@query(_near("list_max(list_transform(range(1, 65), lambda i: abs(b.v[i] - q.v[i])))", 5).replace(" and b.m <> q.m", ""))
def knn_custom(spark, sf_dir):
    """Any distance as a function: here the largest difference of an element."""
    rows = vectors(spark, sf_dir)
    return _told(knn.knn(rows, _queries_of(rows), 5, lambda rows, q: np.abs(rows - q).max(axis=1)))


@query(f"with {E}, p as (select q.m as qid, b.m, {_D2} as dist from e q, e b where q.m % 20 = 0 and b.m <> q.m) select qid, arg_min(m, (round(dist, 12), m)) as m, round(min(dist), 6) as dist from p group by qid")
def nn(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return knn.nearest(rows, _queries_of(rows), exclude_self=True).select("qid", "m", F.round("dist", 6).alias("dist"))


_VOTE = f"with {E}, p as (select q.m as qid, q.label as actual, b.label, row_number() over (partition by q.m order by {_D2}, b.m) as rank from e q, e b where q.m % 20 = 0 and b.m <> q.m), c as (select qid, actual, label, count(*) as votes from p where rank <= 5 group by qid, actual, label) select qid, arg_min(label, (-votes, label)) as predicted, any_value(actual) as actual from c group by qid"


@query(_VOTE)
def knn_vote(spark, sf_dir):
    """The label that most of the five nearest neighbours have."""
    rows = vectors(spark, sf_dir)
    near = knn.knn(rows, _queries_of(rows), 5, exclude_self=True)
    return knn.vote(near, rows.select("m", "label")).join(rows.select(F.col("m").alias("qid"), F.col("label").alias("actual")), "qid").select("qid", "predicted", "actual")


@query(f"select round(avg((predicted = actual)::int), 6) as accuracy from ({_VOTE})")
def knn_accuracy(spark, sf_dir):
    return knn_vote(spark, sf_dir).agg(F.round(F.avg((F.col("predicted") == F.col("actual")).cast("double")), 6).alias("accuracy"))


# Scaling.
@query(f"with {E}, s as (select n, avg(x) as u, sqrt(var_samp(x) + 0.01) as s from (select unnest(range(64)) as n, unnest(v) as x from e) group by n) select m, s.n::int as n, round((v[s.n + 1] - u) / s.s, 6) + 0.0 as x from e, s")
def standardize(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return cells(scale.standardize_all(rows, scale.standardize_train(rows, 0.01)), F.col("v"))


@query(f"with {E} select n::int as i, o::int as j, case when n = o then 1.0 else 0.0 end as cov from range(64) t(n), range(64) u(o)")
def zca_whitening(spark, sf_dir):
    """The covariance of whitened vectors: the identity."""
    rows = vectors(spark, sf_dir)
    out = scale.whiten_all(rows, scale.zca_train(rows, 0.0))
    return agg.covariance_cells(out).select("i", "j", (F.abs(F.round("cov", 4))).alias("cov"))
