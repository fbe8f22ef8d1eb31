"""Queries of the learners: languages of documents by their letters, and the embeddings table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import cluster, learn
from ..operators.gradient import descend
from ..scratch import stored
from .cluster_queries import first_rows
from .registry import query, table
from .vector_queries import E, vectors


#: What the shares of a text are taken of. Fixed values.
LETTERS = "abcdefghijklmnopqrstuvwxyzàçèéêíñóöüäß"
_LANGS = "l as (select doc_id as m, lang, dense_rank() over (order by lang) - 1 as label from documents where lang is not null and text is not null and text <> '')"


#: Where a letter is in a count of the 256 characters of Latin-1.
_CODES = np.frombuffer(LETTERS.encode("latin-1"), np.uint8)


def shares(text: str) -> np.ndarray:
    """Ten times the root of each letter's share of a text, from one count of its characters; zeros for an empty text."""
    codes = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)  # other characters count as "?", which is no letter
    return np.sqrt(100.0 * np.bincount(codes, minlength=256)[_CODES] / max(len(codes), 1))


def letters(spark, sf_dir, every: bool = False) -> DataFrame:
    """(m, v, label, lang): ten times the root of each letter's share of a document's text, and the number of its language by name.

    Documents with a language and a text; with `every` also the others, whose label and lang are null (a null text counts as empty).
    """
    docs = table(spark, sf_dir, "documents")
    taught = F.expr("lang is not null and text is not null and text <> ''")

    @F.pandas_udf("array<double>")
    def counted(text: pd.Series) -> pd.Series:
        return pd.Series([shares(t) for t in text], dtype=object)

    rows = (docs if every else docs.filter(taught)).select(F.col("doc_id").alias("m"), F.when(taught, F.col("lang")).alias("lang"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    rows = stored(rows.select("m", counted("t").alias("v"), "lang"), "letters")
    langs = [r["lang"] for r in rows.filter("lang is not null").select("lang").distinct().orderBy("lang").collect()]  # a row for each language
    label = F.when(F.col("lang").isNotNull(), F.array_position(F.array(*(F.lit(x) for x in langs)), F.col("lang")) - 1) if langs else F.lit(None)
    return rows.select("m", "v", label.cast("int").alias("label"), "lang")


def _held_out(rows: DataFrame, train) -> DataFrame:
    """(lang, rows, told): the documents of every fifth id, which no training saw, and whether seven in ten of all of them are told right."""
    model = train(rows.filter("m % 5 <> 0"))
    out = learn.predict(rows.filter("m % 5 = 0"), model)
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumn("told", F.lit(learn.accuracy(out) >= 0.7))


#: A learner that reaches the floor of seven in ten.
_TOLD = f"with {_LANGS} select lang, count(*) as rows, true as told from l where m % 5 = 0 group by lang"
_K = 4


@query(f"with {E} select label, count(*) as rows, round(ln(count(*) / sum(count(*)) over ()), 6) as log_prior from e group by label")
def nb_priors(spark, sf_dir):
    models = cluster.gaussians(vectors(spark, sf_dir), "label", 10)
    total = sum(g.count for g in models if g)
    return spark.createDataFrame([(i, g.count, round(float(np.log(g.count / total)), 6)) for i, g in enumerate(models) if g], "label int, rows bigint, log_prior double")


@query(f"with {E} select label, n::int as n, round(avg(v[n + 1]), 6) + 0.0 as mean, round(var_samp(v[n + 1]), 6) as variance from e, range(64) t(n) group by label, n")
def nb_class_stats(spark, sf_dir):
    """Means and variances of each label, from one pass."""
    models = cluster.gaussians(vectors(spark, sf_dir), "label", 10)
    rows = [(i, n, float(u), float(s)) for i, g in enumerate(models) if g for n, (u, s) in enumerate(zip(g.mean, (g.vectors**2 * g.values[:, None]).sum(axis=0)))]
    return spark.createDataFrame(rows, "label int, n int, mean double, variance double").select("label", "n", F.round(F.col("mean") + 0.0, 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query(_TOLD)
def nb(spark, sf_dir):
    return _held_out(letters(spark, sf_dir), lambda rows: learn.naive_bayes(rows, _K, npca=24))


@query(f"with {E} select label, count(*) as rows, round(((count(*) - 1) * least(count(*) - 1, 64))::double, 4) as total from e group by label having count(*) > 1")
def gaussian_density(spark, sf_dir):
    """Each label's own density: squared distances in units of its variance, which over its rows add up to (rows - 1) * rank."""
    rows = vectors(spark, sf_dir)
    models = cluster.gaussians(rows, "label", 10)
    far = lambda data: np.stack([-2 * (g.log_density(data) - g.log_density(g.mean[None])) if g else np.zeros(len(data)) for g in models], axis=1)
    told = learn.transform(rows, far, "far").groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.get("far", F.col("label").cast("int"))).alias("total"))
    return told.filter("rows > 1").select("label", "rows", F.round("total", 4).alias("total"))


@query(_TOLD)
def lr(spark, sf_dir):
    return _held_out(letters(spark, sf_dir), lambda rows: learn.softmax_regression(rows, _K))


def _probability_sql(epochs: int) -> str:
    """The regression itself: passes over all documents of a language from zero weights, then the likeliest class of every document."""
    out = f"""with {_LANGS}, d as (select doc_id as m, lower(coalesce(text, '')) as t from documents),
x as materialized (select m, c.n, case when length(t) = 0 then 0 else sqrt(100.0 * (length(t) - length(replace(t, c.x, ''))) / length(t)) end as x
  from d, (select unnest(range({len(LETTERS)})) as n, unnest(string_split('{LETTERS}', '')) as x) c),
f as materialized (select count(distinct m) as m, sum(x * x) as s from x join l using (m)), b as materialized (
  select label, pow(ln(3 + max(n) over ()) / ln(3 + n), 2) as bal from (select label, count(*) as n from l group by label)),
w0 as (select c, n, 0.0::double as w, 0.0::double as u from range({_K}) t(c), range({len(LETTERS)}) s(n)), r0 as (select 'inf'::double as error, 1 as slow, false as worse)"""
    for i in range(epochs):
        out += f""",
p{i} as materialized (select m, c, exp(s) / sum(exp(s)) over (partition by m) as p from (select m, c, sum(x * w) as s from x join w{i} using (n) group by m, c)),
o{i} as materialized (select m, label, p as own from p{i} join l using (m) where c = label),
r{i + 1} as materialized (select error, slow + (error > old)::int as slow, error > old as worse from (select sum(-ln(greatest(own, 1e-12))) / count(*) as error from o{i}), (select error as old, slow from r{i})),
g{i} as (select c, n, sum((p - (c = label)::int) * bal * x) as g from p{i} join o{i} using (m) join b using (label) join x using (m) where own < 0.99 group by c, n),
w{i + 1} as materialized (select c, n, (w + v) * (1 - 0.5 * 1e-4) as w, v as u from (
  select c, n, w, 0.9 * case when worse then 0 else u end - 0.5 / (f.s / f.m) / slow * coalesce(g, 0) / f.m as v from w{i} left join g{i} using (c, n), f, r{i + 1}))"""
    return out + f""", p as (select m, c, exp(s) / sum(exp(s)) over (partition by m) as p from (select m, c, sum(x * w) as s from x join w{epochs} using (n) group by m, c))
select m, arg_min(c, (-p, c))::int as label, round(max(p), 6) as p, max(p) > 0.5 as sure, round(sum(p), 6) as total, max(p) >= 1.0 / {_K} as likeliest from p group by m"""


@query(_probability_sql(10))
def lr_probability(spark, sf_dir):
    """Of every document the likeliest class, its probability, and whether that is more than a half; probabilities add up to one, and the likeliest class has at least an equal share."""
    rows = letters(spark, sf_dir, every=True)
    model = learn.softmax_regression(rows.filter("label is not null"), _K, learn.SoftmaxParams(10, penalty="l2", strength=1e-4))
    told = learn.transform(rows, model.probabilities, "p").select("m", "p", vec.maximum("p").alias("most"))
    return told.select("m", vec.argmax("p").alias("label"), F.round("most", 6).alias("p"), (F.col("most") > 0.5).alias("sure"), F.round(vec.total("p"), 6).alias("total"), (F.col("most") >= 1 / _K).alias("likeliest"))


def _softmax_sql(epochs: int) -> str:
    """Weights after whole passes from zeros: momentum 0.9, rate by the mean squared length, labels balanced."""
    out = f"""with {E}, f as (select count(*) as m, sum(list_dot_product(v, v)) as s from e), n as (select label, count(*) as n from e group by label),
b as (select label, pow(ln(3 + (select max(n) from n)) / ln(3 + n), 2) as bal from n), r as (select 0.5 / (s / m) as rate from f),
x as (select m, label, n, v[n + 1] as x from e, range(64) t(n)), w0 as (select c, n, 0.0::double as w, 0.0::double as v from range(10) t(c), range(64) u(n))"""
    for i in range(epochs):
        out += f""", s{i} as (select m, c, sum(x * w) as s from x join w{i} using (n) group by m, c), p{i} as (select m, c, exp(s) / sum(exp(s)) over (partition by m) as p from s{i}),
d{i} as (select e.m, c, (p - (c = e.label)::int) * bal as d from p{i} p join e on e.m = p.m join b on b.label = e.label), g{i} as (select c, n, sum(d * x) / (select m from f) as g from d{i} join x using (m) group by c, n),
w{i + 1} as (select c, n, w + 0.9 * v - rate * g as w, 0.9 * v - rate * g as v from w{i} join g{i} using (c, n), r)"""
    return out + f" select c::int as c, n::int as n, round(w, 6) + 0.0 as w from w{epochs}"


@query(_softmax_sql(2))
def softmax_epochs(spark, sf_dir):
    """The weights of a softmax regression of the labels after two epochs over all vectors."""
    got = learn.softmax_regression(vectors(spark, sf_dir), 10, learn.SoftmaxParams(2))
    cells = [(c, n, float(w)) for c, row in enumerate(got.weights) for n, w in enumerate(row)]
    return spark.createDataFrame(cells, "c int, n int, w double").select("c", "n", F.round(F.col("w") + 0.0, 6).alias("w"))


def _gradients(spark, rows: DataFrame, start: list[np.ndarray], names: str, gradient) -> DataFrame:
    """(part, i, j, g): the mean gradients at stated weights, by the job that an epoch of training is."""
    got = descend(rows, start, gradient, 1, lambda weights, g: g).weights
    cells = [(name, i, j, float(x)) for name, a in zip(names.split(), got) for (i, j), x in np.ndenumerate(np.atleast_2d(a))]
    return spark.createDataFrame(cells, "part string, i int, j int, g double").withColumn("g", F.round(F.col("g") + 0.0, 6))


@query(f"""with {E}, w as (select m as j, v from e where m < 6), u as (select j, c, ((j * 3 + c) % 5 - 2)::double as u from range(6) t(j), range(3) s(c)),
h as (select a.m, j, 1 / (1 + exp(-(list_dot_product(a.v, w.v) + 0.1 * j))) as h from e a, w), o as (select m, c, sum(h * u) + c / 10.0 as o from h join u using (j) group by m, c),
d as (select o.m, c, exp(o) / sum(exp(o)) over (partition by o.m) - (c = label % 3)::int as d from o join e on e.m = o.m), b as (select d.m, j, sum(d * u) * any_value(h) * (1 - any_value(h)) as b from d join u using (c) join h using (m, j) group by d.m, j),
n as (select count(*) as n from e)
select part, i::int as i, j::int as j, round(g / n, 6) + 0.0 as g from n, (
  select 'w1' as part, n as i, j, sum(v[n + 1] * b) as g from b join e using (m), range(64) t(n) group by n, j union all select 'b1', 0, j, sum(b) / 32 from b group by j
  union all select 'w2', j, c, sum(h * d) from h join d using (m) group by j, c union all select 'b2', 0, c, sum(d) from d group by c)""")
def mlp_gradients(spark, sf_dir):
    """The gradients of a perceptron at stated weights, of the labels modulo three."""
    rows = vectors(spark, sf_dir).withColumn("t", learn._one_hot(F.col("label") % 3, 3))
    j, c = np.mgrid[0:6, 0:3]
    start = [first_rows(rows, 6).T, np.arange(6) * 0.1 * learn.BATCH, ((j * 3 + c) % 5 - 2).astype(float), np.arange(3) / 10]

    def gradient(weights, batch, epoch):
        error, parts = learn.mlp_gradient(weights, learn.matrix_of(batch["v"]), learn.matrix_of(batch["t"]))
        return error, len(batch), parts

    return _gradients(spark, rows.select("v", "t"), start, "w1 b1 w2 b2", gradient)


@query(f"""with {E}, w as (select m as j, v from e where m < 5), h as (select a.m, j, 1 / (1 + exp(-(list_dot_product(a.v, w.v) + 0.2 * j))) as h from e a, w),
o as (select h.m, n, sum(h * w.v[n + 1]) + n / 100.0 - any_value(e.v)[n + 1] as o from h join w using (j) join e on e.m = h.m, range(64) t(n) group by h.m, n),
b as (select o.m, j, sum(o * w.v[n + 1]) * any_value(h) * (1 - any_value(h)) as b from o join h using (m) join w using (j) group by o.m, j), k as (select count(*) as k from e)
select part, i::int as i, j::int as j, round(g / k, 6) + 0.0 as g from k, (
  select 'w' as part, n as i, j, sum(e.v[n + 1] * b + o * h) as g from o join h using (m) join b using (m, j) join e using (m) group by n, j
  union all select 'b', 0, j, sum(b) from b group by j union all select 'c', 0, n, sum(o) from o group by n)""")
def dae_gradients(spark, sf_dir):
    """The gradients of an autoencoder with linear outputs at stated tied weights."""
    rows = vectors(spark, sf_dir)
    start = [first_rows(rows, 5).T, np.arange(5) * 0.2, np.arange(64) / 100]

    def gradient(weights, batch, epoch):
        error, parts = learn.dae_gradient(learn.Dae(*weights, True), learn.matrix_of(batch["v"]))
        return error, len(batch), parts[:3]

    return _gradients(spark, rows.select("v"), start, "w b c", gradient)


@query(f"with {E}, w as (select m as c, v from e where m < 4), s as (select a.m, c, list_dot_product(a.v, w.v) as s from e a, w) select m, c::int as c, round(exp(s) / sum(exp(s)) over (partition by m), 6) as p from s")
def softmax_scores(spark, sf_dir):
    """Probabilities under stated weights: the first four vectors."""
    rows = vectors(spark, sf_dir)
    model = learn.Softmax(first_rows(rows, 4))
    return learn.transform(rows, model.probabilities, "p").select("m", F.posexplode("p").alias("c", "p")).select("m", "c", F.round("p", 6).alias("p"))


@query(f"with {E}, w as (select m as j, v from e where m < 6), h as (select a.m, j, 1 / (1 + exp(-(0.9 * list_dot_product(a.v, w.v) + 0.1 * j))) as h from e a, w), o as (select m, c, 0.8 * sum(h * ((j * 3 + c) % 5 - 2)) + c / 10.0 as o from h, range(3) t(c) group by m, c) select m, c::int as c, round(exp(o) / sum(exp(o)) over (partition by m), 6) as p from o")
def mlp_forward(spark, sf_dir):
    """A perceptron of stated weights, with the shares that dropout and noise leave."""
    rows = vectors(spark, sf_dir)
    j, c = np.mgrid[0:6, 0:3]
    net = learn.Mlp(first_rows(rows, 6).T, np.arange(6) * 0.1 * learn.BATCH, ((j * 3 + c) % 5 - 2).astype(float), np.arange(3) / 10, 0.2, 0.1)
    return learn.transform(rows, net.probabilities, "p").select("m", F.posexplode("p").alias("c", "p")).select("m", "c", F.round("p", 6).alias("p"))


@query(f"with {E}, w as (select m as j, v from e where m < 5), h as (select a.m, j, 1 / (1 + exp(-(list_dot_product(a.v, w.v) + 0.2 * j))) as h from e a, w) select h.m, n::int as n, round(sum(h * w.v[n + 1]) + n / 100.0, 6) + 0.0 as x from h join w using (j), range(64) t(n) group by h.m, n")
def dae_reconstruct(spark, sf_dir):
    """Codes and reconstructions under stated tied weights."""
    rows = vectors(spark, sf_dir)
    net = learn.Dae(first_rows(rows, 5).T, np.arange(5) * 0.2, np.arange(64) / 100, linear=True)
    made = learn.transform(rows, lambda data: net.decode(net.encode(data)), "y")
    return made.select("m", F.posexplode("y").alias("n", "x")).select("m", "n", F.round(F.col("x") + 0.0, 6).alias("x"))


@query(_TOLD)
def arow(spark, sf_dir):
    return _held_out(letters(spark, sf_dir), lambda rows: learn.arow(rows, _K))


@query(_TOLD)
def mlp(spark, sf_dir):
    return _held_out(letters(spark, sf_dir), lambda rows: learn.mlp(rows, _K, hidden=16, epochs=25, dropout=0.1, noise=0.1))


@query(_TOLD)
def mlp_bagging(spark, sf_dir):
    return _held_out(letters(spark, sf_dir), lambda rows: learn.Bagging([learn.mlp(rows, _K, hidden=8, epochs=20, seed=s) for s in (1, 2)]))


@query(_TOLD)
def mlp_targets(spark, sf_dir):
    """A perceptron of the caller's own targets: nine tenths for the language, the rest for all."""

    def train(rows):
        net = learn.new_mlp(len(LETTERS), 10.0, 16, _K, np.random.default_rng(2))
        soft = rows.withColumn("t", F.transform(learn._one_hot(F.col("label"), _K), lambda x: x * 0.9 + 0.1 / _K))
        net, _ = learn.mlp_targets(soft, net, 0.05, 0.05, 0, 10)
        return learn.mlp_targets(soft, net, 0.02, 0.02, 10, 20)[0]

    return _held_out(letters(spark, sf_dir), train)


@query()
def mlp_hidden(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return learn.transform(rows, learn.mlp(rows, 10, hidden=8, epochs=5).hidden, "h").select("m", F.size("h").alias("n"), F.round(vec.total("h"), 6).alias("total"))


@query(f"with {E} select count(*) as rows, true as learned from e")
def mlp_regression(spark, sf_dir):
    """A perceptron of three times the first two elements; whether it leaves less than a half of the targets' variance."""
    rows = vectors(spark, sf_dir).withColumn("t", F.array(vec.element("v", 0) * 3, vec.element("v", 1) * 3))
    model = learn.mlp_regression(rows, "t", hidden=16, epochs=60)
    off = learn.transform(rows, model.regression, "y").select(F.pow(vec.euclidean("t", "y"), 2).alias("e"), F.col("t")[0].alias("a"), F.col("t")[1].alias("b"))
    return off.agg(F.count(F.lit(1)).alias("rows"), (F.avg("e") < 0.5 * (F.var_pop("a") + F.var_pop("b"))).alias("learned"))


@query()
def dae(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    model = learn.dae(rows, 6, epochs=20)
    return learn.transform(rows, lambda data: model.decode(model.encode(data)), "y").select("m", F.round(vec.euclidean("v", "y"), 6).alias("off"))


@query(_TOLD)
def dae_mlp(spark, sf_dir):
    """A perceptron whose input layer begins as an autoencoder's."""
    return _held_out(letters(spark, sf_dir), lambda rows: learn.mlp(rows, _K, epochs=20, encoder=learn.dae(rows, 12, epochs=10, sparsity=0.1)))


@query()
def lmca(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    model = learn.lmca(rows, 3, rounds=2)
    return learn.transform(rows, model.project).select("m", F.size("v").alias("n"), F.round(vec.norm("v"), 6).alias("norm"))
