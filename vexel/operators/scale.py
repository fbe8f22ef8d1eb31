"""Standardisation and whitening."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .agg import covariance
from .linalg import eigen_symmetric, times_matrix


@dataclass(frozen=True)
class Scaler:
    mean: np.ndarray
    sd: np.ndarray


def standardize_train(df: DataFrame, epsilon: float = 0.0) -> Scaler:
    """Mean and sqrt(variance + epsilon) of each element: 2 n numbers on the driver."""
    stats = df.select(F.posexplode("v").alias("n", "x")).groupBy("n").agg(F.avg("x").alias("u"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("s")).orderBy("n").collect()
    return Scaler(np.array([r["u"] for r in stats]), np.sqrt(np.array([r["s"] for r in stats]) + epsilon))


def _literal(values: np.ndarray):
    return F.array(*(F.lit(float(x)) for x in values))


def standardize_all(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumn("v", vec.standardize("v", _literal(scaler.mean), _literal(scaler.sd)))


def standardize_local_all(df: DataFrame, epsilon: float = 0.0) -> DataFrame:
    return df.withColumn("v", vec.standardize_local("v", epsilon))


@dataclass(frozen=True)
class Whitener:
    mean: np.ndarray
    matrix: np.ndarray  # rows: what the centred vector is multiplied by


def zca_train(df: DataFrame, epsilon: float, components: int | None = None, keep_space: bool = True) -> Whitener:
    """V diag(1 / sqrt(D + epsilon)) V', or without the rotation back (`keep_space` False: PCA whitening)."""
    mean, cov = covariance(df)
    values, rows = eigen_symmetric(cov)
    top = len(values) if not components else min(components, len(values))
    shrunk = rows[:top] / np.sqrt(np.maximum(values[:top], 0) + epsilon)[:, None]
    return Whitener(mean, rows[:top].T @ shrunk if keep_space else shrunk)


def whiten_all(df: DataFrame, whitener: Whitener) -> DataFrame:
    return times_matrix(df.withColumn("v", vec.sub("v", _literal(whitener.mean))), whitener.matrix)
