"""Status counts over a stream of offer events, by windows of 30 days; late rows beyond the watermark are left out.

There is no streaming in batch reports; these counts agree with the batch counts of the
same rows.  Quantiles don't stream exactly and are not offered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.operators.metrics import core_rates, status_counts


def live_counts(stream: DataFrame, time: str = "ts", window: str = "30 days", watermark: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, keys, counts, rates) as windows close."""
    grouped = stream.withWatermark(time, watermark).groupBy(F.window(time, window).alias("w"), *keys).agg(*status_counts())
    return grouped.select(F.col("w.start").alias("window_start"), *keys, *[c for c in grouped.columns if c not in ("w", *keys)], *core_rates())


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Write records of a stream once each, for batch reports over them."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
