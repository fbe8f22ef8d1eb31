"""A training corpus in four stages: languages, exact copies, near copies, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of `documents`;
`run` writes what each returns as Parquet to the folder that the cluster shares and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vexel.llm.common import discard, stored
from vexel.llm.exact_dedup import drop_exact_copies
from vexel.llm.language_id import drop_unidentified
from vexel.llm.minhash_dedup import drop_near_copies
from vexel.llm.packing import pack_documents


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not found (`und`: null texts and texts without letters) go; all others stay."""
    return drop_unidentified(docs)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the longest, then the smallest doc_id, then the first."""
    return drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more over 5-word shingles the smallest doc_id stays: one row."""
    return drop_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", identify_languages),
    ("exact dedup", remove_exact_copies),
    ("near dedup", remove_near_copies),
    ("packing", pack_sequences),
]

#: Cross-parsing, MinHash candidates and packing are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table: one row per piece of the kept documents.

    Null and empty texts and such without letters go with the first stage. Repeated and null ids are told apart row by row;
    one row of equal ones stays. Extra columns run through to the last stage. An empty table gives an empty one. What a
    stage has written is deleted once the next one is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        kept = stored(out, name.replace(" ", "-"))
        discard(docs, *getattr(out, "scratch", ()))
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
