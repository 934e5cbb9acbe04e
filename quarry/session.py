"""Session factory: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quarry", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (time zone) and those that plans profit from."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**own, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
