"""Queries of maps, point indexes, hashes, bits and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import index
from .registry import query, table


def points(spark, sf_dir) -> DataFrame:
    """Line items as points: part by supplier."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("data"))


@query("select user_id, arg_min(event_type, event_id) as event_type from events group by user_id")
def map_insert_if_absent(spark, sf_dir):
    """The first event of each user."""
    return index.insert_if_absent(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("select event_id, user_id from events where event_type = 'click'")
def map_find(spark, sf_dir):
    return index.find(table(spark, sf_dir, "events"), "event_type", "click").select("event_id", "user_id")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0)")
def map_remove(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return index.remove(table(spark, sf_dir, "orders"), "o_custkey", gone).select("o_orderkey")


@query("select distinct event_type from events")
def map_keys(spark, sf_dir):
    return index.keys(table(spark, sf_dir, "events"), "event_type")


@query("select p_partkey, p_brand as kept, p_type as added, 2 as size, p_size as number, 'a,b' as keys, 1 as after from part")
def map_column(spark, sf_dir):
    """A map in a column: inserting a key twice keeps the first value."""
    m = F.create_map(F.lit("b"), F.col("p_brand"))
    m = index.map_insert(index.map_insert(m, F.lit("a"), F.col("p_type")), F.lit("b"), F.lit("no"))
    sized = F.create_map(F.lit("s"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", index.map_find(m, F.lit("b")).alias("kept"), index.map_find(m, F.lit("a")).alias("added"), F.size(m).alias("size"), index.map_find(sized, F.lit("s"), "int").alias("number"), F.array_join(index.map_keys(m), ",").alias("keys"), F.size(index.map_remove(m, F.lit("a"))).alias("after"))


@query("select l_partkey as y, l_suppkey as x, concat_ws('-', l_orderkey, l_linenumber) as data from lineitem where l_partkey between 100 and 299 and l_suppkey between 1 and 50")
def index_rect(spark, sf_dir):
    return index.in_rectangle(points(spark, sf_dir), 100, 1, 200, 50)


@query("select l_partkey as y, l_suppkey as x, concat_ws('-', l_orderkey, l_linenumber) as data from lineitem where l_partkey between 70 and 129 and l_suppkey between -25 and 34 and sqrt((l_partkey - 100) * (l_partkey - 100) + (l_suppkey - 5) * (l_suppkey - 5)) < 30")
def index_circle(spark, sf_dir):
    return index.in_circle(points(spark, sf_dir), 100, 5, 30)


@query("select c as id, count(*) as points from lineitem, range(20) t(c) where l_partkey - c * 90 between -25 and 24 and l_suppkey - 5 between -25 and 24 and sqrt((l_partkey - c * 90) * (l_partkey - c * 90) + (l_suppkey - 5) * (l_suppkey - 5)) < 25 group by c")
def index_circle_join(spark, sf_dir):
    centres = spark.range(20).select("id", (F.col("id") * 90).alias("cy"), F.lit(5).cast("bigint").alias("cx"))
    return index.circle_join(centres, points(spark, sf_dir), 25).groupBy("id").agg(F.count(F.lit(1)).alias("points"))


@query("select doc_id, sha1(text) as sha1 from documents")
def sha1_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", index.sha1_hex(F.col("text")).alias("sha1"))


@query("select p_partkey, bit_count(p_partkey)::int as ones, bit_count(p_partkey * 2654435761 % 4294967296)::int as mixed from part")
def popcnt(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", vec.popcount(F.col("p_partkey")).alias("ones"), vec.popcount(F.col("p_partkey") * 2654435761 % 4294967296).alias("mixed"))


@query("select o_orderkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month, day(o_orderdate)::int as day, dayofweek(o_orderdate)::int as weekday, (dayofyear(o_orderdate) - 1)::int as yearday, epoch(o_orderdate)::bigint as epoch from orders")
def time_parts(spark, sf_dir):
    """To parts of UTC time and back."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("e")).withColumn("t", index.to_parts(F.col("e")))
    back = index.to_epoch(*(F.col(f"t.{c}") for c in ("year", "month", "day", "hour", "minute", "second")))
    return rows.select("o_orderkey", "t.year", "t.month", "t.day", "t.weekday", "t.yearday", back.alias("epoch"))


@query("with recursive n as (select unnest(range(2, 20000)) as x) select (row_number() over (order by x) - 1)::int as i, x::int as prime from n where not exists (select 1 from range(2, 142) t(d) where d * d <= x and x % d = 0) qualify i < 2000")
def primes(spark, sf_dir):
    return index.primes(spark, 2000)
