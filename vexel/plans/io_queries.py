"""Queries of the file formats: everything is written to the shared scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import cluster, learn, tree
from ..scratch import scratch_dir
from ..sources import matrix
from .registry import query
from .vector_queries import E, vectors

_SUMS = f"with {E} select m, 64 as n, round(list_sum(v), 4) as total from e"


def _place(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _sums(df):
    return df.select("m", F.size("v").alias("n"), F.round(vec.total("v") + 0.0, 4).alias("total"))


@query(f"with {E} select m, round(printf('%e', v[1])::double, 5) + 0.0 as first, round(printf('%e', v[64])::double, 5) + 0.0 as last from e")
def matrix_text(spark, sf_dir):
    path = _place(spark, "text")
    matrix.write_text(vectors(spark, sf_dir), path)
    return matrix.read_text(spark, path).select("m", F.round(vec.element("v", 0) + 0.0, 5).alias("first"), F.round(vec.element("v", 63) + 0.0, 5).alias("last"))


@query(f"with {E} select (m // 100)::int as array_index, m % 100 // 10 as list, m % 10 as m, printf('%e', v[3])::double + 0.0 as x from e where m < (select max(m) // 100 * 100 from e)")
def matrix_arrays(spark, sf_dir):
    """Arrays of ten matrices of ten vectors in one text, and back; the last vectors, which fill no array, are left out."""
    path, rows = _place(spark, "arrays"), vectors(spark, sf_dir)
    last = rows.agg(F.max("m")).first()[0] // 100 * 100
    lists = rows.filter(F.col("m") < last).select((F.col("m") / 100).cast("int").alias("array_index"), F.expr("m % 100 div 10").alias("list"), (F.col("m") % 10).alias("m"), "v")
    matrix.write_text_arrays(lists, path)
    return matrix.read_text_arrays(spark, path).select("array_index", "list", "m", (vec.element("v", 2) + 0.0).alias("x"))


@query(f"with {E} select count(*) as rows, 0::bigint as other from e")
def tree_round_trip(spark, sf_dir):
    """A tree saved, loaded and asked again: how many rows get another leaf or distance."""
    rows, path = vectors(spark, sf_dir), _place(spark, "tree")
    own = tree.kmeans_tree(rows, [3, 2], 2, seeding="first")
    matrix.save_model(spark, own, path)
    again = tree.label(rows, matrix.load_model(spark, tree.Tree, path)).select("m", F.col("leaf").alias("l"), F.col("dist").alias("d"))
    both = tree.label(rows, own).join(again, "m")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.sum(((F.col("leaf") != F.col("l")) | (F.col("dist") != F.col("d"))).cast("int")).alias("other"))


@query("select 1::bigint as list, count(*) as m, 64::bigint as n, 1::bigint as rows, count(*) as cols from embeddings")
def matrix_header(spark, sf_dir):
    path = _place(spark, "header")
    matrix.write_text(vectors(spark, sf_dir), path)
    return matrix.read_header(spark, path)


@query(f"with {E} select (m // 11)::int as array_index, m % 11 as m, n::int as n, printf('%e', v[n + 1])::double + 0.0 as x from e, range(64) t(n)")
def matrix_string(spark, sf_dir):
    """All vectors, eleven to a string, and back."""
    rows = vectors(spark, sf_dir).select((F.col("m") / 11).cast("int").alias("array_index"), "m", "v")
    back = matrix.deserialize(matrix.serialize(rows, "array_index"), keys=("array_index",))
    return back.select("array_index", "m", F.posexplode("v").alias("n", "x")).select("array_index", "m", "n", (F.col("x") + 0.0).alias("x"))


@query(f"with {E} select (m // 100)::int as array_index, m % 100 as m, round(v[3], 5) + 0.0 as x from e")
def matrix_binary(spark, sf_dir):
    """Arrays of a hundred vectors as bytes and back."""
    rows = vectors(spark, sf_dir).select((F.col("m") / 100).cast("int").alias("array_index"), "m", "v")
    made = matrix.binary_of(rows).select(F.col("array_index").cast("string").alias("path"), "content")
    return matrix.parse_binary(made).select(F.col("path").cast("int").alias("array_index"), "m", F.round(vec.element("v", 2) + 0.0, 5).alias("x"))


@query(f"with {E} select label, count(*) as rows, round(sum(v[1]), 3) + 0.0 as first from e group by label")
def libsvm(spark, sf_dir):
    path = _place(spark, "libsvm")
    matrix.write_libsvm(vectors(spark, sf_dir), path)
    return matrix.read_libsvm(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(vec.element("v", 0)) + 0.0, 3).alias("first"))


@query(f"with {E} select count(*) as rows, 0::bigint as other from e")
def model_round_trip(spark, sf_dir):
    """A trained model saved, loaded and asked again: how many rows get another answer."""
    rows, path = vectors(spark, sf_dir), _place(spark, "model")
    model = learn.softmax_regression(rows, 10, learn.SoftmaxParams(5))
    matrix.save_model(spark, model, path)
    again = matrix.load_model(spark, learn.Softmax, path)
    both = learn.predict(learn.predict(rows, model, "a"), again, "b")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("other"))


@query()
def model_parts(spark, sf_dir):
    """The rows that a mixture of Gaussians is saved as."""
    path = _place(spark, "gaussians")
    matrix.save_model(spark, learn.Bayes(cluster.gaussians(vectors(spark, sf_dir), "label", 10)), path)
    return spark.read.parquet(path)


@query(f"with {E} select count(*) as lines, count(*) filter (m >= 0) as vectors from (select m from e union all select -1)")
def stream_lines(spark, sf_dir):
    return matrix.stream_lines(vectors(spark, sf_dir)).agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("line_no") >= 0).cast("bigint")).alias("vectors"))
