"""A local or cluster session with the settings this library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quernel", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
