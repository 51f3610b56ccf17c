"""Single files with a name of their own, on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MODES = ("errorifexists", "ignore", "overwrite")


def _at(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def may_write(spark: SparkSession, path: str, mode: str) -> bool:
    """Whether `path` is to be written: False for a file that exists with mode="ignore", an error with "errorifexists"."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    fs, target = _at(spark, path)
    if mode == "overwrite" or not fs.exists(target):
        return True
    if mode == "errorifexists":
        raise FileExistsError(path)
    return False


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """The only column of a table of one partition as the text file `path`, whole or not at all; whether it was written."""
    spark = lines.sparkSession
    if not may_write(spark, path, mode):
        return False
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/_{name}-{uuid.uuid4().hex}"  # readers pass over names that begin with _
    lines.coalesce(1).write.text(aside)
    fs, target = _at(spark, path)
    (part,) = fs.globStatus(_at(spark, f"{aside}/part-*")[1])
    fs.delete(target, False)
    if not fs.rename(part.getPath(), target):
        raise OSError(f"could not name {path}")
    fs.delete(_at(spark, aside)[1], True)
    return True


def write_bytes(spark: SparkSession, data: bytes, path: str, mode: str = "errorifexists") -> bool:
    """Bytes that the driver holds as the file `path`; whether it was written."""
    if not may_write(spark, path, mode):
        return False
    fs, target = _at(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(data))
    out.close()
    return True
