"""Aggregating the log of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("compression_rate", "compression_speed", "decompression_speed")


def by_dataset(results: DataFrame) -> DataFrame:
    """Means of each compressor and dataset; the latency's mean is truncated."""
    return results.groupBy("compressor_name", "dataset_name").agg(*(F.avg(c).alias(c) for c in METRICS), F.floor(F.avg("average_random_access_time")).cast("long").alias("average_random_access_time"))


def overall(per_dataset: DataFrame) -> DataFrame:
    """Means of the dataset means, each dataset counting once; the latency is truncated again."""
    means = per_dataset.groupBy("compressor_name").agg(*(F.avg(c).alias(c) for c in METRICS), F.floor(F.avg("average_random_access_time")).cast("long").alias("average_random_access_time"))
    return means.select("compressor_name", F.lit("AVERAGE").alias("dataset_name"), *METRICS, "average_random_access_time")


def full(results: DataFrame) -> DataFrame:
    """Both, by compressor and dataset, each compressor's AVERAGE last."""
    a = by_dataset(results)
    both = a.withColumn("is_avg", F.lit(False)).unionByName(overall(a).withColumn("is_avg", F.lit(True)))
    return both.orderBy("compressor_name", "is_avg", "dataset_name")


def printed(report: DataFrame) -> DataFrame:
    """(compressor_name, dataset_name, line) as a console would show it: rates to 3 decimals, speeds to 2, latency to 0."""
    line = F.format_string("%-30s rate %.3f  compression %.2f MiB/s  decompression %.2f MiB/s  access %d ns", "dataset_name", *METRICS, "average_random_access_time")
    return report.select("compressor_name", "dataset_name", line.alias("line"))
