"""Line sources: plain, gzip, bzip2 text and the members of tar.gz archives."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) lines of text files; .gz and .bz2 are unpacked, and bzip2 is split over tasks."""
    return spark.read.text(path)


def read_tar_lines(spark: SparkSession, path: str, suffix: str = ".tsv") -> DataFrame:
    """(member, line, value): lines of every archive member whose name ends with `suffix`, in archive order. An archive is one task's."""

    def unpack(batches):
        for batch in batches:
            for data in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(data.as_py()), mode="r:*") as tar:
                    for member in tar:
                        file = tar.extractfile(member) if member.isfile() and member.name.endswith(suffix) else None
                        if file is None:
                            continue
                        lines, at = [], 0
                        for line in io.TextIOWrapper(file, encoding="utf-8"):
                            lines.append(line.rstrip("\n"))
                            if len(lines) == 20_000:
                                yield pa.record_batch([pa.array([member.name] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines)], names=["member", "line", "value"])
                                at, lines = at + len(lines), []
                        if lines:
                            yield pa.record_batch([pa.array([member.name] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines)], names=["member", "line", "value"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(unpack, "member string, line long, value string").select("member", "line", F.col("value"))
