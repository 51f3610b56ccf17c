"""Intermediate tables in the folder that all machines share, and small helpers around them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path under spark.checkpoint.dir. Unset on a local master (tests): a temporary folder is set as it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lexiweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read from there: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark 4.1's setting by which a query's shuffle files go when it ends; without it they stay until the driver's JVM happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """Of each query run in the block, the shuffle files go when it ends. Not for toLocalIterator(), which reads them later."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


@contextlib.contextmanager
def passing(df: DataFrame, tag: str):
    """stored(), for a block that reads the table with actions of its own: at its end the table's folder is deleted."""
    table = stored(df, tag)
    try:
        yield table
    finally:
        for file in table.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores before it until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remainder(id_column, divisor: int):
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % divisor


def shards_for(df: DataFrame) -> int:
    """How many key shards to deal a table's fingerprints to: grows with its partitions, so that a shard's share doesn't."""
    return 1 << max(6, (4 * df.rdd.getNumPartitions() - 1).bit_length())
