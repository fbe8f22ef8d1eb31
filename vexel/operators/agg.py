"""Aggregates down the rows of a vector table: statistics for each element, the covariance matrix, purity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec


def column_mean(df: DataFrame) -> DataFrame:
    """(n, mean); each task adds up its rows before the shuffle."""
    return df.select(F.posexplode("v").alias("n", "x")).groupBy("n").agg(F.avg("x").alias("mean"))


def column_variance(df: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """(n, variance) with m - 1, of one row 0; `about` has (n, mean) to use instead of the rows' own mean."""
    cells = df.select(F.posexplode("v").alias("n", "x"))
    if about is None:
        return cells.groupBy("n").agg(F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"))
    joined = cells.join(F.broadcast(about.select("n", "mean")), "n")  # as many rows as a vector has elements
    return joined.groupBy("n").agg((F.sum((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))) / F.greatest(F.count("x") - 1, F.lit(1))).alias("variance"))


def moments(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, count, sums, products): the sums and the Gram matrix (row by row) of all vectors, or of each key's.

    Every task makes one matrix for each key it sees (keys are labels or clusters, so few), and Spark adds up the tasks' matrices
    cell by cell: a key of any number of tasks is spread over n * n cells.
    """
    rows = df.select(*([F.col(key).cast("bigint").alias("key")] if key else [F.lit(0).cast("bigint").alias("key")]), "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            data, keys = np.stack(batch["v"].to_numpy()), batch["key"].to_numpy()
            for k in np.unique(keys):
                own = data[keys == k]
                if int(k) not in held:
                    held[int(k)] = [0, np.zeros(own.shape[1]), np.zeros((own.shape[1], own.shape[1]))]
                slot = held[int(k)]
                slot[0] += len(own)
                slot[1] += own.sum(axis=0)
                slot[2] += own.T @ own
        yield pd.DataFrame([(k, c, s.tolist(), g.ravel().tolist()) for k, (c, s, g) in held.items()], columns=["key", "count", "sums", "products"])

    parts = rows.mapInPandas(run, "key bigint, count bigint, sums array<double>, products array<double>")
    cells = parts.select("key", F.posexplode(F.concat(F.array(F.col("count").cast("double")), "sums", "products")).alias("i", "x"), F.size("sums").alias("n"))
    cells = cells.groupBy("key", "n", "i").agg(F.sum("x").alias("x"))
    whole = cells.groupBy("key", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("x"))  # 1 + n + n * n numbers
    return whole.select("key", F.col("x")[0].cast("bigint").alias("count"), F.slice("x", F.lit(2), F.col("n")).alias("sums"), F.slice("x", F.col("n") + 2, F.col("n") * F.col("n")).alias("products"))


def covariance_of(count: int, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance); of one row all zero."""
    n = len(sums)
    mean = sums / max(count, 1)
    return mean, (products.reshape(n, n) - count * np.outer(mean, mean)) / max(count - 1, 1)


def covariance(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the whole table on the driver: n + n * n numbers, whatever the number of rows."""
    row = moments(df).first()
    if row is None:
        return np.zeros(0), np.zeros((0, 0))
    return covariance_of(row["count"], np.array(row["sums"]), np.array(row["products"]))


def covariance_cells(df: DataFrame) -> DataFrame:
    """(i, j, cov) as a table."""
    _, cov = covariance(df)
    n = len(cov)
    spark = df.sparkSession
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(n) for j in range(n)], "i int, j int, cov double")


def first_row_by(df: DataFrame, score, largest: bool = True) -> DataFrame:
    """One row (m): the row of the largest (smallest) score, the smallest m in a tie. No global sort."""
    value = -score if largest else score
    return df.agg(F.min_by("m", F.struct(value, F.col("m"))).alias("m")).select(F.coalesce("m", F.lit(-1).cast("bigint")).alias("m"))


def max_norm_row(df: DataFrame) -> DataFrame:
    return first_row_by(df, vec.norm("v"))


def min_norm_row(df: DataFrame) -> DataFrame:
    return first_row_by(df, vec.norm("v"), largest=False)


def max_sum_row(df: DataFrame) -> DataFrame:
    return first_row_by(df, vec.total("v"))


def min_sum_row(df: DataFrame) -> DataFrame:
    return first_row_by(df, vec.total("v"), largest=False)


def scale_to_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """All elements of the table moved and stretched together to [low, high]; IEEE results if they are all equal."""
    ends = df.agg(F.min(vec.minimum("v")).alias("_lo"), F.max(vec.maximum("v")).alias("_hi"))
    scaled = F.transform("v", lambda x: vec.ieee_div((x - F.col("_lo")) * float(high - low), F.col("_hi") - F.col("_lo")) + float(low))
    return df.crossJoin(F.broadcast(ends)).withColumn("v", scaled).drop("_lo", "_hi")  # one row


def purity(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """(purity): the share of rows that have the most frequent label of their cluster."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(cluster).agg(F.max("c").alias("most"), F.sum("c").alias("all")).agg((F.sum("most") / F.sum("all")).alias("purity"))
