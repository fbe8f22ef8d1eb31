"""Tables of vectors (m BIGINT, v ARRAY<DOUBLE>): building, slicing, sorting, reshaping, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..scratch import stored


def create(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """A small table from literal rows."""
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "m bigint, v array<double>")


def constant(spark: SparkSession, m: int, n: int, value: float = 0.0) -> DataFrame:
    return spark.range(m).select(F.col("id").alias("m"), F.array_repeat(F.lit(float(value)), n).alias("v"))


def constant_lists(spark: SparkSession, lists: int, m: int, n: int, value: float = 0.0) -> DataFrame:
    """(list, m, v): `lists` matrices of m rows each, one after the other."""
    return spark.range(lists * m).select(F.expr(f"id div {m}").alias("list"), (F.col("id") % m).alias("m"), F.array_repeat(F.lit(float(value)), n).alias("v"))


def list_of(df: DataFrame, number: int) -> DataFrame:
    """(m, v) of one matrix of a list: a filter that reaches the scan, so a table partitioned by `list` reads no other."""
    return df.filter(F.col("list") == number).select("m", "v")


def list_value(number: Column, row: Column, element: Column, m: int, n: int) -> Column:
    """The place of an element among all of a list of m x n matrices."""
    return (number * m + row) * n + element


def vectors(df: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """(m, v, others) of any table with an id and a numeric array; only these columns are read."""
    return df.select(F.col(id_col).alias("m"), vec.as_vector(vector_col).alias("v"), *others)


def checked(df: DataFrame, n: int) -> DataFrame:
    """Fails where a vector has not `n` elements; meant for once after loading."""
    return df.withColumn("v", F.when(F.size("v") == n, F.col("v")).otherwise(F.raise_error(F.format_string("vector of %d elements instead of %d", F.size("v"), F.lit(n))).cast("array<double>")))


def block(df: DataFrame, first_row: int, rows: int, first_element: int, n: int) -> DataFrame:
    """Rows first_row .. and elements first_element .. of each, keys as they are."""
    return df.filter(F.col("m").between(first_row, first_row + rows - 1)).withColumn("v", F.slice("v", first_element + 1, n))


def head(df: DataFrame, k: int) -> DataFrame:
    return df.filter(F.col("m") < k)


def copy_rows(dest: DataFrame, dest_row: int, src: DataFrame, src_row: int, count: int) -> DataFrame:
    """`dest` with `count` rows of `src` in place of its own from `dest_row` on."""
    moved = src.filter(F.col("m").between(src_row, src_row + count - 1)).select((F.col("m") - src_row + dest_row).alias("m"), "v")
    return dest.filter(~F.col("m").between(dest_row, dest_row + count - 1)).select("m", "v").unionByName(moved)


def copy_column(dest: DataFrame, dest_element: int, src: DataFrame, src_element: int) -> DataFrame:
    """`dest` with one element of each vector taken from the same row of `src`."""
    taken = src.select("m", vec.element("v", src_element).alias("_x"))
    put = F.transform(F.col("v"), lambda x, i: F.when(i == dest_element, F.col("_x")).otherwise(x))
    return dest.join(taken, "m").withColumn("v", put).drop("_x")


def set_row(df: DataFrame, m: int, values: Column) -> DataFrame:
    return df.withColumn("v", F.when(F.col("m") == m, values).otherwise(F.col("v")))


def sort_rows(df: DataFrame, element: int, ascending: bool = True) -> DataFrame:
    """Rows by one element, then by m."""
    key = vec.element("v", element)
    return df.orderBy(key.asc() if ascending else key.desc(), F.col("m"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Every row with `rank`, its place from 1 in this order over the whole table.

    The table is sorted by ranges and written once, which fixes them. Ranges are numbered side by side, each from where the
    counts of those before it end: one number for each range, so no task sees more than its own rows.
    """
    placed = stored(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_start")
    return placed.join(F.broadcast(starts), "_range").withColumn("rank", place.cast("bigint")).drop("_range", "_start")


def transpose_grid(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """The vectors of a rows x cols grid, numbered row by row, as those of the cols x rows grid: keys change, vectors stay where they are."""
    return df.withColumn("m", F.col("m") % cols * rows + F.expr(f"m div {cols}"))


def explode(df: DataFrame) -> DataFrame:
    """(m, n, x): one row for each element."""
    return df.select("m", F.posexplode("v").alias("n", "x"))


def assemble(cells: DataFrame) -> DataFrame:
    """(m, v) from (m, n, x); a vector must fit in memory."""
    return cells.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("v"))


def unfold(df: DataFrame, width: int) -> DataFrame:
    """(m, part, v): each vector as rows of `width` elements."""
    return df.select("m", F.posexplode(vec.reshape("v", width)).alias("part", "v"))


def flatten(df: DataFrame) -> DataFrame:
    """The whole table as one vector in the order of m; for small tables."""
    return df.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("m", "v"))), lambda s: s["v"])).alias("v")).select(F.lit(0).cast("bigint").alias("m"), "v")


# Random numbers: always seeded; orders by md5 are the same in every engine.
def shuffle_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"-{seed}")).cast("binary"))


def split(df: DataFrame, id_col: str, seed: int, test_parts: int = 1, parts: int = 4) -> DataFrame:
    """`df` with `split`: 'test' for about test_parts / parts of the rows by a hash of the id, else 'train'. No shuffle."""
    nibble = F.conv(F.substring(shuffle_key(F.col(id_col), seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("split", F.when(nibble % parts < test_parts, "test").otherwise("train"))


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows in an order that looks random and is fixed by the seed, whatever the partitions are."""
    return df.orderBy(shuffle_key(F.col(id_col), seed), id_col)


def random_vectors(spark: SparkSession, m: int, n: int, seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Uniform elements that depend on (seed, m, n) alone, so partitioning does not change them."""
    unit = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return spark.range(m).select(F.col("id").alias("m"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: unit(i) * (high - low) + low).alias("v"))


def normal_vectors(spark: SparkSession, m: int, n: int, seed: int, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """Normal elements by Box and Muller from two uniform ones."""
    unit = lambda i, k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id"), i), F.lit(1 << 52)).cast("double") + 1.0) / float((1 << 52) + 1)
    draw = lambda i: F.sqrt(F.lit(-2.0) * F.ln(unit(i, 1))) * F.cos(unit(i, 2) * 6.283185307179586)
    return spark.range(m).select(F.col("id").alias("m"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: draw(i) * sd + mean).alias("v"))
