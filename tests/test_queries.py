"""Every registered vector query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.harness import compare
from vexel.plans import catalog

SF = "/root/testdata/sf0.001"
#: Long loops of many small jobs, covered by the tests of their operators or the last test here.
SLOW = {"xmeans", "lbgu", "klr_tree", "klr", "knb", "pca_kmeans_tree", "kmeans_tree", "kmeans_tree_beam", "keypoints_rectangle", "som", "lmca"}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, name):
    rows, bad = compare(spark, name, catalog.QUERIES[name], catalog.SQL[name], SF)
    assert rows and not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - SLOW))
def test_other_queries_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name, column", [("dae", None), ("lmca", None), ("xmeans", "count"), ("knb", "rows"), ("klr", "rows"), ("klr_tree", "rows")])
def test_learners_answer_for_every_row_of_the_table(spark, name, column):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert (got[column].sum() if column else len(got)) == want
