"""Exact duplicates by a 128-bit content hash, with bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, WHITE, numbered, pick, text_of, without_rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda c: F.unhex(F.md5(c))) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of space and U+0009 to U+000D. Rows are grouped by the
    128-bit `digest` of that form and, inside a digest, by the bytes themselves, so a collision of the digest makes two
    groups. The row with the most code points in its original text stays, then the one of the smallest id. Copies fold
    into one row in each task before the shuffle, so a group of any size is a few rows there; rows get their group
    back by digest and SHA-256, a join that adaptive execution splits where one text has most rows.

    A null text is empty, so all null, empty and blank texts are one group. Rows that repeat an id with equal texts
    are all `kept` or all not: they are one document. A null id comes last in a tie. An empty table gives an empty one.
    """
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text")).withColumn("text", text_of(F.col("text")))
    rows = rows.select("doc_id", F.length("text").alias("n"), F.translate("text", WHITE, "").alias("form"))
    rows = rows.select("doc_id", "n", "form", digest(F.col("form").cast("binary")).alias("digest"), F.sha2(F.col("form").cast("binary"), 256).alias("text_sha256"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best")
    groups = rows.groupBy("digest", "form").agg(best, F.count(F.lit(1)).alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    groups = groups.select("digest", "text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    out = rows.select("doc_id", "digest", "text_sha256").join(groups, ["digest", "text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of `docs` of which one stays for each text, all columns as they are.

    Of equal texts the longest stays, then the one of the smallest id (null last), then the first row: rows are told
    apart by their number, so repeated ids, null ids and rows that are equal in all columns leave one row too, and no
    other text of the same id goes. Null, empty and blank texts are one text. An empty table gives an empty one.
    """
    rows = numbered(docs, "numbered")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(ROW).alias("row"))
    told = exact_dedup(rows.select(order.alias("order"), F.col(text_col).alias("text")), "order", "text")
    return without_rows(rows, told.filter(~F.col("kept")).select(F.col("doc_id.row").alias(ROW)), "copies", max_broadcast_rows)
