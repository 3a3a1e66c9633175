"""Fitted operators on streams. An extra: the batch operators that keep no state apply as stream-static joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators.encoders import CategoricalEncoder


def encoded_stream(stream: DataFrame, encoder: CategoricalEncoder, keep: list[str]) -> DataFrame:
    """A stream with the encoder's columns; mappings are static tables."""
    return encoder.transform(stream, keep)


def bucket_stream(stream: DataFrame, ts: str, value: str, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Tumbling buckets with a watermark: bucket, mean, std, n."""
    w = F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return out.select(F.col("w.start").alias("bucket"), "mean", "std", "n")
