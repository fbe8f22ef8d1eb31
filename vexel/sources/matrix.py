"""Text and binary files of vector arrays, strings, LIBSVM lines, models.

Text: a header `list m n rows cols`, then one line for each vector in scientific notation. String: `< list m n rows
cols: v v ... >`. Binary: five 32-bit numbers `list n m rows cols`, then 32-bit floats, where vectors of more than four
elements are padded to a multiple of eight. A stream has the header `1 -1 n -1 -1` and vectors up to its end.
Parsing is by Spark expressions wherever lines allow, and by one pass over each binary file else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



# Text.
def numbers(line: Column) -> Column:
    """The numbers of a line of text."""
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def lines_of(df: DataFrame, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """(line_no, line) of a table (m, v): the header is line -1."""
    shape = df.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n"))
    head = shape.select(F.lit(-1).cast("bigint").alias("line_no"), F.format_string("1 %d %d %d %d", F.col("m"), F.col("n"), F.lit(rows) if rows else F.lit(1), F.lit(cols).cast("bigint") if cols else F.col("m")).alias("line"))
    body = df.select(F.col("m").alias("line_no"), F.array_join(F.transform("v", lambda x: F.format_string("%E", x)), " ").alias("line"))
    return head.unionByName(body)


def write_text(df: DataFrame, path: str, rows: int | None = None, cols: int | None = None) -> None:
    """A matrix as text: part files that, one after another by name, are the file. Ranges of rows are written by a task each."""
    lines_of(df, rows, cols).orderBy("line_no").select("line").write.mode("overwrite").text(path)


def write_text_arrays(df: DataFrame, path: str) -> None:
    """(array_index[, list], m, v): one matrix, or list of matrices, after another. Each list of an array has the same number of rows."""
    rows = df if "list" in df.columns else df.withColumn("list", F.lit(0))
    key = lambda l, m: [F.col("array_index").cast("bigint").alias("a"), F.coalesce(l, F.lit(-1)).cast("bigint").alias("l"), F.coalesce(m, F.lit(-1)).cast("bigint").alias("i")]
    shape = rows.groupBy("array_index").agg((F.max("list") + 1).alias("l"), (F.max("m") + 1).alias("m"), F.max(F.size("v")).alias("n"))
    none = F.lit(None).cast("bigint")
    head = shape.select(*key(none, none), F.format_string("%d %d %d 1 %d", F.col("l"), F.col("m"), F.col("n"), F.col("m")).alias("line"))
    body = rows.select(*key(F.col("list"), F.col("m")), F.array_join(F.transform("v", lambda x: F.format_string("%E", x)), " ").alias("line"))
    head.unionByName(body).orderBy("a", "l", "i").select("line").write.mode("overwrite").text(path)


#: Lines that are looked at together when each is given the header above it.
_STRETCH = 65_536
_HEADER = r"^\s*-?\d+(\s+-?\d+){4}\s*$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): the lines of a text, or of the part files of one by name, that are not blank, numbered from 0.

    Files are read in splits, each by a task of its own. A line's number is that of its split's first line, a running sum over the
    counts of the splits before, and its place in the split.
    """
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    held = raw.filter(F.trim("line") != "").withColumn("id", F.monotonically_increasing_id())
    splits = held.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return held.join(F.broadcast(splits), ["file", "block"]).select((F.col("before") + F.col("id") - F.col("first")).alias("pos"), "line")  # a row for each split of 128 MB


def _headers(lines: DataFrame) -> DataFrame:
    """(pos, list, m, n, rows, cols): where matrices begin. A header says where the next one stands, so the lines of five whole
    numbers, few beside the rows, are followed in their order, one at a time and none held."""
    some = lines.filter(F.col("line").rlike(_HEADER)).select("pos", numbers(F.col("line")).alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = 0
        for batch in batches:
            out = []
            for pos, h in zip(batch["pos"], batch["h"]):
                if pos == due:
                    out.append((pos, *map(int, h)))
                    due = pos + 1 + int(h[0]) * int(h[1])
            yield pd.DataFrame(out, columns=["pos", "list", "m", "n", "rows", "cols"])

    return some.repartition(1).sortWithinPartitions("pos").mapInPandas(run, "pos bigint, list bigint, m bigint, n bigint, rows bigint, cols bigint")


def read_text_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(array_index, list, m, v): every row of every matrix of a text; array_index counts the matrices.

    Each stretch of lines takes the header above a line from the lines themselves, and the one that a stretch begins under from the
    headers whose rows reach into it: no stretch is more than 65,536 lines and no matrix is gathered. Rows beyond what the
    headers announce are left out.
    """
    lines = numbered_lines(spark, path)
    place = Window.orderBy("pos")  # a row for each matrix
    heads = _headers(lines).withColumn("array_index", (F.row_number().over(place) - 1).cast("int"))
    heads = heads.select("pos", F.struct(F.col("pos").alias("at"), "array_index", "m", (F.col("pos") + F.col("list") * F.col("m")).alias("last")).alias("head"))
    stretch = lambda x: F.expr(f"{x} div {_STRETCH}")
    over = heads.filter(stretch("head.last") > stretch("pos")).select(F.explode(F.sequence(stretch("pos") + 1, stretch("head.last"))).alias("stretch"), F.col("head").alias("over"))
    marked = lines.join(heads, "pos", "left").withColumn("stretch", stretch("pos"))
    above = Window.partitionBy("stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = marked.withColumn("own", F.last("head", ignorenulls=True).over(above)).join(over, "stretch", "left").withColumn("of", F.coalesce("own", "over"))
    rows = known.filter((F.col("pos") > F.col("of.at")) & (F.col("pos") <= F.col("of.last")))
    place = F.col("pos") - F.col("of.at") - 1
    return rows.select("of.array_index", F.floor(place / F.col("of.m")).cast("bigint").alias("list"), (place % F.col("of.m")).alias("m"), numbers(F.col("line")).alias("v"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(m, v) of a text of one matrix: rows are numbered as they stand, those of a list one after the other. The file is read in splits."""
    return numbered_lines(spark, path).filter("pos > 0").select((F.col("pos") - 1).alias("m"), numbers(F.col("line")).alias("v"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(list, m, n, rows, cols) of each matrix of a text."""
    return _headers(numbered_lines(spark, path)).select("list", "m", "n", "rows", "cols")


# Strings.
def serialize(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, s): the rows of each key as one string, in the order of m; without keys the whole table, which must be small."""
    whole = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("m", "v"))).alias("p"))
    size = F.size("p")
    text = F.array_join(F.transform(F.flatten(F.transform("p", lambda p: p["v"])), lambda x: F.format_string("%E", x)), " ")
    return whole.select(*keys, F.concat(F.format_string("< 1 %d %d 1 %d: ", size, F.coalesce(F.size(F.get("p", F.lit(0))["v"]), F.lit(0)), size), text, F.lit(" >")).alias("s"))


def deserialize(df: DataFrame, s: str = "s", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, m, v) of each such string, m from 0; of a malformed one no row."""
    pattern = r"^\s*<\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*:\s*(.*?)\s*>\s*$"
    parsed = df.select(*keys, F.col(s).alias("s")).filter(F.col("s").rlike(pattern)).select(*keys, *(F.regexp_extract("s", pattern, i).try_cast("int").alias(name) for i, name in ((2, "m_"), (3, "n_"))), F.split(F.regexp_extract("s", pattern, 6), r"\s+").alias("x"))
    parsed = parsed.withColumn("x", F.transform("x", lambda x: x.try_cast("double"))).filter((F.size("x") == F.col("m_") * F.col("n_")) & ~F.exists("x", lambda x: x.isNull()))
    return parsed.filter("m_ > 0").select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m_") - 1), lambda i: F.slice("x", i * F.col("n_") + 1, F.col("n_")))).alias("m", "v")).select(*keys, F.col("m").cast("bigint").alias("m"), "v")


# Binary.
def stride(n: int) -> int:
    """Floats that a vector of n elements takes: padded to a multiple of eight beyond four."""
    return n if n <= 4 else -(-n // 8) * 8


def to_bytes(data: np.ndarray, rows: int = 1, cols: int | None = None, lists: int = 1) -> bytes:
    """`data` has the rows of all `lists` matrices, one after the other."""
    m, n = len(data) // lists, data.shape[1]
    padded = np.zeros((len(data), stride(n)), "<f4")
    padded[:, :n] = data
    return struct.pack("<5i", lists, n, m, rows, m if cols is None else cols) + padded.tobytes()


def from_bytes(raw: bytes) -> Iterator[np.ndarray]:
    """The matrices that stand one behind another in a file; of a list all rows."""
    for data, _ in lists_from_bytes(raw):
        yield data


def lists_from_bytes(raw: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(rows, number of lists) of what stands one behind another in a file."""
    at = 0
    while at + 20 <= len(raw):
        count, n, m, _, _ = struct.unpack_from("<5i", raw, at)
        size = 4 * count * m * stride(n)
        data = np.frombuffer(raw, "<f4", size // 4, at + 20).reshape(count * m, stride(n))
        yield data[:, :n].astype(float), count
        at += 20 + size


def binary_of(df: DataFrame) -> DataFrame:
    """(array_index, content): each array (array_index[, list], m, v) as bytes; an array must fit in memory."""
    df = df if "list" in df.columns else df.withColumn("list", F.lit(0))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(frame.sort_values(["list", "m"])["v"].to_numpy())
        return pd.DataFrame({"array_index": [frame["array_index"].iloc[0]], "content": [to_bytes(data, lists=int(frame["list"].max()) + 1)]})

    return df.groupBy("array_index").applyInPandas(run, "array_index int, content binary")


def parse_binary(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, array_index, list, m, v) of files (path, content), as `spark.read.format('binaryFile')` gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                for k, (data, lists) in enumerate(lists_from_bytes(bytes(raw))):
                    own, m = np.divmod(np.arange(len(data)), max(1, len(data) // lists))
                    yield pd.DataFrame({"path": path, "array_index": k, "list": own, "m": m, "v": list(data)})

    return files.select("path", F.col(content).alias("content")).mapInPandas(run, "path string, array_index int, list bigint, m bigint, v array<double>")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return parse_binary(spark.read.format("binaryFile").load(path))


# LIBSVM.
def libsvm_lines(df: DataFrame) -> DataFrame:
    """(m, line): `label + 1` and all elements as `place:value`, places from 1."""
    cells = F.transform("v", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), F.format_string("%f", x)))
    return df.select("m", F.concat((F.col("label") + 1).cast("string"), F.lit(" "), F.array_join(cells, " ")).alias("line"))


def write_libsvm(df: DataFrame, path: str) -> None:
    libsvm_lines(df).select("line").write.mode("overwrite").text(path)


def read_libsvm(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(label, v): labels from 0 again; places that are not there are 0 up to `n` elements."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    pairs = F.transform(F.slice("p", 2, F.size("p")), lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("i"), F.substring_index(x, ":", -1).cast("double").alias("x")))
    size = F.lit(n) if n else F.coalesce(F.array_max(F.transform("q", lambda q: q["i"])), F.lit(0))
    found = rows.select((F.col("p")[0].cast("int") - 1).alias("label"), F.map_from_entries(pairs).alias("c"), pairs.alias("q"))
    return found.select("label", F.transform(F.sequence(F.lit(1), size), lambda i: F.coalesce(F.try_element_at("c", i), F.lit(0.0))).alias("v"))


# Models: (part, kind, m, v) rows, a part for each value that a model is made of, named by its way from the top.
def save_model(spark: SparkSession, model: object, path: str) -> None:
    """A model as Parquet: dataclasses, lists, dicts, arrays and numbers, nested in any way. Kinds of dataclasses are kept by name."""
    rows: list[tuple[str, str, int, list[float]]] = []

    def put(name: str, value: object) -> None:
        if value is None or isinstance(value, (bool, int, float, str, np.number)):
            kind = "none" if value is None else f"text:{value}" if isinstance(value, str) else "bool" if isinstance(value, bool) else "int" if isinstance(value, (int, np.integer)) else "float"
            rows.append((name, kind, -1, [] if kind == "none" or isinstance(value, str) else [float(value)]))
        elif isinstance(value, np.ndarray):
            rows.append((name, "array:" + ",".join(map(str, value.shape)), -1, []))
            rows.extend((name, "row", i, np.atleast_1d(r).astype(float).ravel().tolist()) for i, r in enumerate(value.reshape(len(value), -1) if value.ndim and value.size else [value] if value.size else []))
        elif isinstance(value, (list, tuple)):
            rows.append((name, type(value).__name__, -1, [float(len(value))]))
            for i, x in enumerate(value):
                put(f"{name}.{i}", x)
        elif isinstance(value, dict):
            rows.append((name, "dict", -1, [float(k) for k in value]))
            for k, x in value.items():
                put(f"{name}.{k}", x)
        elif hasattr(value, "__dataclass_fields__"):
            rows.append((name, f"model:{type(value).__name__}", -1, []))
            for k in value.__dataclass_fields__:
                put(f"{name}.{k}", getattr(value, k))
        else:
            raise TypeError(f"{name}: no part of a model can be a {type(value).__name__}")

    put("", model)
    spark.createDataFrame(rows, "part string, kind string, m int, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def model_kinds() -> dict[str, type]:
    """The dataclasses that a saved model may name."""
    from ..operators import cluster, learn, tree

    kinds = (cluster.Clusters, cluster.Gaussian, learn.Softmax, learn.Arow, learn.Bayes, learn.Mlp, learn.Bagging, learn.Dae, learn.Metric, tree.Node, tree.Tree)
    return {k.__name__: k for k in kinds}


def load_model(spark: SparkSession, kind: type, path: str):
    """A saved model of that kind read back, with all models inside it."""
    heads, held, known = {}, {}, model_kinds() | {kind.__name__: kind}
    for r in spark.read.parquet(path).orderBy("part", "m").collect():
        if r["kind"] == "row":
            held.setdefault(r["part"], []).append(r["v"])
        else:
            heads[r["part"]] = (r["kind"], r["v"])

    def take(name: str):
        what, _, more = heads[name][0].partition(":")
        values = heads[name][1]
        if what in ("none", "text"):
            return None if what == "none" else more
        if what in ("bool", "int", "float"):
            return {"bool": bool, "int": int, "float": float}[what](values[0])
        if what == "array":
            return np.array(held.get(name, []), float).reshape([int(x) for x in more.split(",") if x])
        if what in ("list", "tuple"):
            return {"list": list, "tuple": tuple}[what](take(f"{name}.{i}") for i in range(int(values[0])))
        if what == "dict":
            return {int(k): take(f"{name}.{int(k)}") for k in values}
        return known[more](**{k: take(f"{name}.{k}") for k in known[more].__dataclass_fields__})

    model = take("")
    if not isinstance(model, kind):
        raise TypeError(f"a {type(model).__name__} was saved there, not a {kind.__name__}")
    return model


# Images and frames.
def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, rows, cols, n, data) of image files, by Spark's image source: BGR rows, bad files left out.

    The id is a hash of the file's name.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [np.frombuffer(bytes(d), np.uint8).astype(float) for d in batch["data"]]
            yield pd.DataFrame({"image_id": batch["image_id"], "rows": batch["height"], "cols": batch["width"], "n": batch["nChannels"], "data": data})

    return rows.select(F.xxhash64("origin").alias("image_id"), "height", "width", "nChannels", "data").mapInPandas(run, "image_id bigint, rows int, cols int, n int, data array<double>")


def frames_of(images: DataFrame, camera: Column, number: Column) -> DataFrame:
    """(camera_id, frame_no, v) of a table of images, for the background model."""
    return images.select(camera.alias("camera_id"), number.alias("frame_no"), F.col("data").alias("v"))


def stream_lines(df: DataFrame) -> DataFrame:
    """(line_no, line) of a row stream: the header says how long vectors are, but not how many there are."""
    size = df.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).select(F.lit(-1).cast("bigint").alias("line_no"), F.format_string("1 -1 %d -1 -1", F.col("n")).alias("line"))
    return size.unionByName(lines_of(df).filter("line_no >= 0"))


