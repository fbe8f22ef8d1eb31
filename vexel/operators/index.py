"""Maps, point indexes, hashes and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Keyed tables: as maps they would have to fit in memory.
def insert_if_absent(entries: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): of entries with the same key the first one stays. Tasks keep their own first ones before the shuffle."""
    return entries.groupBy(key).agg(F.min_by(value, order).alias(value))


def find(entries: DataFrame, key: str, wanted) -> DataFrame:
    return entries.filter(F.col(key) == wanted)


def remove(entries: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """`entries` without the keys in `gone` (same column name)."""
    return entries.join(gone.select(key), key, "left_anti")


def keys(entries: DataFrame, key: str) -> DataFrame:
    """The distinct keys in order."""
    return entries.select(key).distinct().orderBy(key)


# Maps in a column.
def map_insert(m: Column, key: Column, value: Column) -> Column:
    """The map with the key, unless it has it already."""
    return F.when(F.map_contains_key(m, key), m).otherwise(F.map_concat(m, F.create_map(key, value)))


def map_find(m: Column, key: Column, kind: str = "string") -> Column:
    """The value as `kind`; null if the key is not there or the value is no such thing."""
    return F.try_element_at(m, key).try_cast(kind)


def map_remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


# Points (y, x, data).
def scan(points: DataFrame) -> DataFrame:
    return points.orderBy("y", "x", "data")


def in_rectangle(points: DataFrame, y: int, x: int, height: int, width: int) -> DataFrame:
    """Points with y and x in [start, start + size - 1]; the bounds reach the file scan."""
    return points.filter(F.col("y").between(y, y + height - 1) & F.col("x").between(x, x + width - 1))


def in_circle(points: DataFrame, y: int, x: int, r: int) -> DataFrame:
    """Points nearer than `r`, of the square from -r to r - 1."""
    near = F.sqrt(((F.col("y") - y) * (F.col("y") - y) + (F.col("x") - x) * (F.col("x") - x)).cast("double")) < r
    return in_rectangle(points, y - r, x - r, 2 * r, 2 * r).filter(near)


def circle_join(centres: DataFrame, points: DataFrame, r: int) -> DataFrame:
    """(id, y, x, data) of all points in each circle (id, cy, cx): an equi-join on grid cells of side `r`, then the distance."""
    spread = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cells = centres.select("id", "cy", "cx", F.floor(F.col("cy") / r).alias("gy0"), F.floor(F.col("cx") / r).alias("gx0"))
    cells = cells.select("*", spread.alias("dy")).select("*", spread.alias("dx")).select("id", "cy", "cx", (F.col("gy0") + F.col("dy")).alias("gy"), (F.col("gx0") + F.col("dx")).alias("gx"))
    placed = points.select("y", "x", "data", F.floor(F.col("y") / r).alias("gy"), F.floor(F.col("x") / r).alias("gx"))
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    return cells.join(placed, ["gy", "gx"]).filter(dy.between(-r, r - 1) & dx.between(-r, r - 1) & (F.sqrt((dy * dy + dx * dx).cast("double")) < r)).select("id", "y", "x", "data")


# Hashes.
def sha1_hex(col: Column) -> Column:
    return F.sha1(col.cast("binary"))


def sha1_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha1) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("sha1"))


# Time.
def to_parts(epoch: Column) -> Column:
    """Seconds since 1970 as parts of UTC time; the session's zone must be UTC."""
    t = F.timestamp_seconds(epoch)
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second"), (F.dayofweek(t) - 1).alias("weekday"), (F.dayofyear(t) - 1).alias("yearday"))


def to_epoch(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.unix_seconds(F.make_timestamp(year, month, day, hour, minute, second.cast("decimal(8,6)")))


def clock_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


# Primes.
def primes(spark: SparkSession, count: int = 16_384) -> DataFrame:
    """(i, prime): the first primes, by a sieve on the driver as far as the prime number theorem bounds the last one."""
    import numpy as np

    top = 15 if count < 6 else int(count * (np.log(count) + np.log(np.log(count)))) + 1
    sieve = np.ones(top + 1, bool)
    sieve[:2] = False
    for p in range(2, int(top**0.5) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    found = np.flatnonzero(sieve)[:count]
    return spark.createDataFrame([(i, int(p)) for i, p in enumerate(found)], "i int, prime int")
