"""The log of measurements: a folder of files that are each a JSON array of result objects, one for each append."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "dataset_name string, compressor_name string, compression_rate double, compression_speed double, decompression_speed double, average_random_access_time long"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results of a log, or of one file with a JSON array; no rows when the path doesn't exist; malformed JSON is an error."""
    try:
        return spark.read.schema(SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def six_digits(v):
    """A number as six significant digits give it; null for what isn't finite."""
    return F.when(F.abs(v) < float("inf"), F.format_string("%.5e", v).cast("double"))


def _one_array(results: DataFrame, path: str, mode: str) -> None:
    """Small by nature: a row a run."""
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    results.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("value")).coalesce(1).write.mode(mode).text(path)


def append_results(results: DataFrame, path: str) -> None:
    """Append to a log that read_results reads, with speeds and rates to six significant digits."""
    rates = {c: six_digits(F.col(c)) for c in ("compression_rate", "compression_speed", "decompression_speed")}
    _one_array(results.withColumns(rates), path, "append")


def export_results(results: DataFrame, path: str) -> None:
    """The log as one JSON array in one file, replacing what is there."""
    _one_array(results, path, "overwrite")
