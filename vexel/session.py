"""The Spark session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "vexel", **conf: str) -> SparkSession:
    """A session in UTC with Arrow and adaptive execution. `master` None leaves it to spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
