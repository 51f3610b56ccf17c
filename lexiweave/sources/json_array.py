"""Datasets that are one JSON array of strings a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions.strings import file_name
from lexiweave.sources.one_file import write_lines


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length) of a folder's own *.json files, by path. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select("path", file_name(F.col("path")).alias("name"), "length").orderBy("path")


def read_json_array(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """(file, id, value): every string with its place in its file's array.

    A file that isn't an array of strings is an error, or without rows with on_error="skip". Empty strings stay; an
    empty array has no rows. One file is one row while it is parsed, so files must stay below 2 GB.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be raise or skip")
    whole = spark.read.text(path, wholetext=True).select(file_name(F.input_file_name()).alias("file"), "value")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    # The element type of mixed arrays is widened; only a look at each element tells.
    typed = F.from_json("value", "array<variant>")
    strings = F.forall(typed, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    good = F.coalesce((kind == "ARRAY<VOID>") & (F.size(typed) == 0) | kind.startswith("ARRAY<") & strings, F.lit(False))
    checked = whole.withColumn("good", good)
    if on_error == "raise":
        checked = checked.withColumn("good", F.when(F.col("good"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an array of strings: "), "file")).cast("boolean")))
    return checked.where("good").select("file", F.posexplode(F.from_json("value", "array<string>")).alias("id", "value")).withColumn("id", F.col("id").cast("long"))


def array_lines(df: DataFrame, id_column: str = "id", value: str = "value") -> DataFrame:
    """(value) lines that make up one JSON array of all values by id. One task sorts and writes them, but no row holds more than one string."""
    quoted = F.to_json(F.array(F.col(value)))
    items = df.select(F.lit(1).alias("k"), F.col(id_column).alias("id"), F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("v"))
    ends = df.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(None).cast(df.schema[id_column].dataType).alias("id"), F.lit(v).alias("v")) for k, v in ((0, "["), (2, "]"))))))
    ordered = items.union(ends).repartition(1).sortWithinPartitions("k", "id").withColumn("n", F.monotonically_increasing_id())
    return ordered.select(F.concat(F.when((F.col("k") == 1) & (F.col("n") > 1), F.lit(",")).otherwise(F.lit("")), "v").alias("value"))


def write_json_array(df: DataFrame, path: str, id_column: str = "id", value: str = "value", mode: str = "errorifexists") -> None:
    """All values, by id, as one JSON array in a folder with one file."""
    array_lines(df, id_column, value).write.mode(mode).text(path)


def write_dataset(df: DataFrame, folder: str, name: str, id_column: str = "id", value: str = "value", mode: str = "errorifexists") -> bool:
    """All values, by id, as the dataset `folder/name` that list_datasets and read_json_array find; whether it was written.

    With mode="ignore" a dataset that is there stays, with "overwrite" it is replaced.
    """
    return write_lines(array_lines(df, id_column, value), f"{folder}/{name}", mode)
