"""Structured Streaming around the plan (an extension: reports are stateless)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.config import Settings
from probatio.plans.verify import verify


def verify_stream(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Reports of a stream of samples: the batch plan as it is."""
    return verify(samples, settings)


def once_within(samples: DataFrame, ttl: str = "1 hour", time: str = "ts") -> DataFrame:
    """Each text once within the time to live: the streaming form of the result cache."""
    keyed = samples.withColumn("key", F.sha2("code", 256))
    return keyed.withWatermark(time, ttl).dropDuplicatesWithinWatermark(["key"])


def verdict_counts(reports: DataFrame, window: str = "5 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Verdicts by tumbling window; rows later than ``late`` are left out."""
    return reports.withWatermark(time, late).groupBy(F.window(time, window), "verdict").agg(F.count(F.lit(1)).alias("n"))
