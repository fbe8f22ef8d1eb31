"""Tables of an iteration, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: Arrow batches of a stored step end at so many rows or bytes: texts differ in length by thousands of times.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on one machine else a folder of the warehouse, on a cluster none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The settings of BATCH while a step is planned and run; then what was set before."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """`df` written once as Parquet and read again: lineage is cut, lost executors cost nothing. `by` has a folder for each of its values."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/vexel-{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes scratch tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        if table is not None:
            entry = (table.sparkSession, getattr(table, "scratch_path", None))
            if entry in _made:
                _made.remove(entry)
                _remove(*entry)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; scratch files are then left to the folder's owner
        pass


@atexit.register
def _clean() -> None:
    while _made:
        _remove(*_made.pop())
