"""Document fingerprints of a threshold-scaled sketch: mergeable, with containment for very unequal documents."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from . import text_hash
from .common import pick, text_of

WIDTH = 5  #: words in a shingle
SCALE = 4  #: one shingle hash in so many is retained


@dataclass(frozen=True)
class Sketch:
    """What is kept of a text's distinct shingle hashes: those below 2**64 / scale, to 48 bits, sorted; and the least of all
    (0 for none), which stands for a text that retains nothing. Both are the same for a text and for the merge of
    sketches that its shingles come from."""

    values: np.ndarray
    least: int
    scale: int = SCALE

    def __str__(self) -> str:
        """scale:least:values, the least hash in hexadecimal, the values in base64, 8 characters each."""
        kept = self.values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        return f"{self.scale}:{self.least:016x}:{base64.b64encode(kept.tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Sketch:
        """The sketch that a string of `__str__` holds."""
        scale, least, kept = text.split(":")
        raw = np.frombuffer(base64.b64decode(kept), np.uint8).reshape(-1, 6)
        whole = np.zeros((len(raw), 8), np.uint8)
        whole[:, 2:] = raw
        return cls(whole.view(">u8").ravel().astype(np.uint64), int(least, 16), int(scale))

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both documents' shingles together."""
        if self.scale != other.scale:
            raise ValueError("sketches of different scales")
        least = min((x for x in (self.least, other.least) if x), default=0)
        return Sketch(np.union1d(self.values, other.values), least, self.scale)

    def containment(self, other: Sketch) -> float:
        """The share of this document's shingles that the other has, as estimated; without values, 1 for equal least hashes."""
        if not len(self.values):
            return float(self.least == other.least)
        return len(np.intersect1d(self.values, other.values, assume_unique=True)) / len(self.values)

    def resemblance(self, other: Sketch) -> float:
        """The Jaccard similarity as estimated."""
        if not len(self.values) and not len(other.values):
            return float(self.least == other.least)
        common = len(np.intersect1d(self.values, other.values, assume_unique=True))
        return common / (len(self.values) + len(other.values) - common)


def sketches(texts: list[str], width: int = WIDTH, scale: int = SCALE) -> list[Sketch]:
    """A sketch of each text: 5-word shingles, A-Z lowered; a shorter text is one shingle, one without words has none."""
    raw = [t.encode() for t in texts]
    limit, out = np.uint64((1 << 64) // scale - 1), []
    cut = np.uint64(-(-(1 << 16) // scale))  # leaves 48 bits of those that vary below the limit
    for first, last in text_hash.chunks(raw):
        hashes, firsts, _, _ = text_hash.words(raw[first:last])
        found, bounds = text_hash.shingles(hashes, firsts, width)
        for i in range(last - first):
            own = found[bounds[i] : bounds[i + 1]]
            kept = np.unique(own[own <= limit] // cut)
            out.append(Sketch(kept, int(own.min()) if len(own) else 0, scale))
    return out


def containment(col: Column, other: Column) -> Column:
    """The estimated share of one stored fingerprint's shingles that another has; null where one is null."""

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else Sketch.parse(x).containment(Sketch.parse(y)) for x, y in zip(a, b)], dtype="float64")

    return estimate(col, other)


def merge(stored_prints: DataFrame, by: str, print_col: str = "fingerprint") -> DataFrame:
    """(by, fingerprint): one fingerprint of all documents of each group, from stored ones of one scale.

    Their values are rows that meet in a distinct count and are put together in Spark: each task folds its own before
    the shuffle, so a group of any number of documents costs a task no more than its distinct values. Null fingerprints add nothing.
    """
    rows = pick(stored_prints, (by, "by"), (print_col, "print")).filter("print is not null")

    @F.pandas_udf("array<bigint>")
    def values(prints: pd.Series) -> pd.Series:
        return pd.Series([Sketch.parse(p).values.astype(np.int64) for p in prints])

    @F.pandas_udf("string")
    def written(head: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([str(Sketch(np.array([] if v is None else v, np.uint64), int(h.split(":")[1], 16), int(h.split(":")[0]))) for h, v in zip(head, kept)])

    part = F.split("print", ":")
    rows = rows.select("by", part[0].alias("scale"), part[1].alias("least"), F.explode_outer(values("print")).alias("value")).distinct()
    none = "0" * 16
    least = F.coalesce(F.min(F.when(F.col("least") != none, F.col("least"))), F.lit(none))
    heads = rows.groupBy("by").agg(F.concat_ws(":", F.min("scale"), least).alias("head"), F.array_sort(F.collect_set("value")).alias("kept"), F.count_distinct("scale").alias("scales"))
    heads = heads.withColumn("head", F.when(F.col("scales") == 1, F.col("head")).otherwise(F.raise_error(F.lit("sketches of different scales"))))
    return heads.select(F.col("by").alias(by), written("head", "kept").alias("fingerprint"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """One row per input row: doc_id, fingerprint. Null counts as empty; equal texts have equal fingerprints; nothing is shuffled."""
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fingerprint": [str(s) for s in sketches(texts, width, scale)]})

    return rows.mapInPandas(run, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame, compare: Callable[[list, list[str], list[str]], pd.DataFrame], schema: str, rows_per_range: int = 4096, max_ranges: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`compare` over each row and the next one in descending doc_id, after the last the first.

    Ids are cut into ranges of about equal numbers of rows. Each range also gets the row that follows its last one, a
    guest that is only ever "next", so ranges are independent and the texts are shuffled once. The cuts and
    the first row of each range are as many as the ranges, `max_ranges` at most; a range is sorted and read as a stream,
    so it may be larger than memory. Ids are integers or strings. Rows of equal ids follow by text; a null id comes last.
    """
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text")).select(F.col("doc_id").alias("key"), "doc_id", text_of(F.col("text")).alias("text"))
    kind = rows.schema["key"].dataType
    if isinstance(kind, IntegralType):
        rows = rows.withColumn("key", F.coalesce(F.col("key").cast("long"), F.lit(-(1 << 63))))
    elif isinstance(kind, StringType):
        rows = rows.withColumn("key", F.coalesce("key", F.lit("")))
    else:
        raise TypeError(f"ids of type {kind.simpleString()} have no order here: use integers or strings")
    number = rows.count()
    ranges = max(1, min(number // rows_per_range, max_ranges))
    cuts: list = []
    if ranges > 1 and isinstance(kind, IntegralType):
        cuts = sorted({int(c) for c in rows.approxQuantile("key", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))})
    elif ranges > 1:  # about 64 keys for each range
        seen = sorted(r["key"] for r in rows.select("key").sample(min(1.0, 64 * ranges / number), 7).collect())
        cuts = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []
    # Range 0 has the largest ids, as rows go down.
    place = _place(F.col("key"), cuts)
    tops = {r["range"]: r["top"] for r in rows.groupBy(place.alias("range")).agg(F.max("key").alias("top")).collect()}
    order = sorted(tops)
    before = {tops[b]: a for a, b in zip(order, order[1:])}  # the range that the top of the next one visits
    spark = docs.sparkSession
    visits = [(k, r, False) for k, r in before.items()] + ([(tops[order[0]], order[-1], True)] if order else [])
    guests = F.broadcast(spark.createDataFrame(visits, f"top {rows.schema['key'].dataType.simpleString()}, range int, last boolean"))  # one row for each range
    own = rows.select(place.alias("range"), F.lit(0).alias("guest"), "key", "doc_id", "text")
    visiting = rows.join(guests, rows["key"] == guests["top"]).select("range", F.when(F.col("last"), 2).otherwise(1).alias("guest"), "key", "doc_id", "text")
    dealt = own.unionByName(visiting).repartition(max(1, len(order)), "range").sortWithinPartitions("range", "guest", F.col("key").desc(), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that still waits for its next one
        for batch in batches:
            pairs = []
            for row in zip(batch["range"].tolist(), batch["guest"].tolist(), batch["doc_id"], batch["text"]):
                if held is not None and held[0] == row[0] and not held[1]:
                    pairs.append((held, row))
                held = row
            if pairs:
                yield compare([a[2] for a, _ in pairs], [a[3] for a, _ in pairs], [b[3] for _, b in pairs])

    return dealt.mapInPandas(run, schema)


def _place(key, cuts: list):
    """The range of a key by halving: an expression as deep as the logarithm of the number of cuts."""

    def below(lo: int, hi: int):
        if lo == hi:
            return F.lit(len(cuts) - lo)
        mid = (lo + hi) // 2
        return F.when(key >= cuts[mid], below(mid + 1, hi)).otherwise(below(lo, mid))

    return below(0, len(cuts))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many of the first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_stability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text and the next document are as `edited` and `with_next` say. near_* is the estimated containment of
    the document's shingles in the other's, from what the strings hold. Null is empty; a single document is its own next one; repeated rows follow
    one another; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def compare(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
        changed = [edited(t, n) for t, n in zip(texts, following)]
        own, new = sketches(texts, width, scale), sketches(changed, width, scale)
        # The next document is mostly the next row, whose sketch is there.
        after = [own[i + 1] if i + 1 < len(own) and n is texts[i + 1] else sketches([n], width, scale)[0] for i, n in enumerate(following)]
        return pd.DataFrame({
            "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": [str(s) for s in own], "edited_fingerprint": [str(s) for s in new],
            "near_edited": [a.containment(b) for a, b in zip(own, new)], "near_next": [a.containment(b) for a, b in zip(own, after)],
        })

    return with_next(docs, compare, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", id_col=id_col, text_col=text_col)
