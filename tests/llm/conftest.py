from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark: SparkSession, rows: list[tuple], extra: str = "") -> DataFrame:
    """Documents of (id, text[, lang]); `extra` adds clashing columns."""
    full = [(i, t, *(r or [None]), "src", None if t is None else len(t)) for i, t, *r in rows]
    out = spark.createDataFrame(full, SCHEMA)
    return out.selectExpr("*", *[f"'x' as {c}" for c in extra.split()])


@pytest.fixture(scope="session")
def words():
    """Texts of invented words with exact and near copies, from 0 to some hundred words."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 5, 6, 30, 120, 300]))) for _ in range(150)]
    for text in out[:60]:
        own = text.split()
        if len(own) > 20:
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
        else:
            out.append(text.upper())
    return out + ["", " \t\n", None, None]
