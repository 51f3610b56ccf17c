"""Measuring codecs over datasets."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.codecs.registry import CODECS, find
from lexiweave.operators import engine, report
from lexiweave.operators.layout import with_offsets
from lexiweave.sources.json_array import list_datasets, read_json_array
from lexiweave.sources.results import SCHEMA, append_results, read_results

SUITE = ("raw", "onpair", "fsst")
ITERATIONS = 3


def plan(spark: SparkSession, datasets: DataFrame, codecs: tuple[str, ...] = SUITE, iterations: int = ITERATIONS) -> DataFrame:
    """(dataset_name, codec, iteration): every run of a suite. The two other factors are literals of a few rows."""
    runs = F.array(*(F.struct(F.lit(c).alias("codec"), F.lit(i).alias("iteration")) for c in codecs for i in range(iterations)))
    return datasets.select(F.col("name").alias("dataset_name"), F.inline(runs))


def measure(collection: DataFrame, dataset_name: str, codec: str, queries: int = 1_000) -> tuple:
    """Encode, decode and look up once, verifying both; a result row as of results.SCHEMA.

    Speeds are MiB of raw data a second of wall time; the access time is nanoseconds a query of a whole lookup job. Runs
    on a stored encoding, so decoding doesn't encode again. An empty collection has null metrics.
    """
    name = find(codec).name
    offsets = with_offsets(collection).cache()
    raw = offsets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    mib = raw / (1024.0 * 1024.0)
    try:
        began = time.perf_counter()
        encoded = engine.compress(offsets, codec)
        encoded.segments = encoded.segments.cache()
        rate = engine.space(encoded).first()["rate"]
        coded = time.perf_counter()
        decoded = engine.decompress(encoded)
        decoded.write.format("noop").mode("overwrite").save()
        done = time.perf_counter()
        if engine.verify(offsets, decoded).first()["mismatches"]:
            raise ValueError(f"{name} doesn't give back {dataset_name}")
        asked = engine.query_workload(offsets, queries)
        start = time.perf_counter_ns()
        found = engine.lookup(encoded, asked)
        wrong = found.join(offsets.select(F.col("pos").alias("idx"), F.col("value").cast("binary").alias("want")), "idx").where("value <> want").count()
        took = time.perf_counter_ns() - start
        if wrong:
            raise ValueError(f"{name} looks up wrong strings in {dataset_name}")
        speed = lambda s: mib / s if raw else None
        return (dataset_name, name, rate, speed(coded - began), speed(done - coded), took // queries if raw else None)
    finally:
        offsets.unpersist()


def run(spark: SparkSession, collections: dict[str, DataFrame], codecs: tuple[str, ...] = SUITE, iterations: int = ITERATIONS, queries: int = 1_000) -> DataFrame:
    """All runs of a suite, one after the other; the first that fails ends it."""
    rows = [measure(df, name, codec, queries) for name, df in collections.items() for codec in codecs for _ in range(iterations)]
    return spark.createDataFrame(rows, SCHEMA)


def run_folder(spark: SparkSession, folder: str, log: str, codecs: tuple[str, ...] = SUITE, iterations: int = ITERATIONS, queries: int = 1_000) -> tuple[DataFrame, list[tuple]]:
    """Run a suite over a folder's *.json datasets by path, appending each result to `log` at once.

    A run that fails doesn't end the suite and leaves no result. Returns the full report on all of the log, earlier
    results included, and the failed runs as (dataset_name, codec, iteration, message).
    """
    failed = []
    for dataset in list_datasets(spark, folder).collect():  # file names, not contents
        for codec in codecs:
            for k in range(iterations):
                try:
                    row = measure(read_json_array(spark, dataset["path"]), dataset["name"], codec, queries)
                    append_results(spark.createDataFrame([row], SCHEMA), log)
                except (PySparkException, ValueError) as e:
                    failed.append((dataset["name"], codec, k, str(e)))
    return report.full(read_results(spark, log)), failed


__all__ = ["CODECS", "measure", "plan", "run", "run_folder"]
