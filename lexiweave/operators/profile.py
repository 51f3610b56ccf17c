"""Statistics of a string collection, on bytes of UTF-8."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basics(df: DataFrame, value: str = "value") -> DataFrame:
    """One row: n, unique_pct (exact), avg_bytes; nulls for an empty collection's averages."""
    n = F.count("*")
    return df.agg(n.alias("n"), F.when(n > 0, 100.0 * F.countDistinct(value) / n).alias("unique_pct"), F.avg(F.octet_length(value)).alias("avg_bytes"))


def alphabet(df: DataFrame, value: str = "value") -> DataFrame:
    """One row: how many byte values occur. Each batch sends the values it has, 256 at most."""

    def seen(batches):
        for batch in batches:
            data = b"".join(x.as_buffer().to_pybytes() for x in batch.column(0) if x.is_valid)
            yield pa.record_batch([pa.array(np.unique(np.frombuffer(data, np.uint8)).astype(np.int32))], names=["byte"])

    return df.select(F.col(value).cast("binary")).mapInArrow(seen, "byte int").agg(F.countDistinct("byte").alias("alphabet"))


def _prefix_sums(batches):
    """Of a sorted partition: sum of neighbours' common prefixes, pairs, first and last value."""
    total, n, first, last = 0, 0, None, None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            if last is None:
                first = x
            else:
                total += lcp(last, x)
                n += 1
            last = x
    if last is not None:
        yield pa.record_batch([pa.array([total], pa.int64()), pa.array([n], pa.int64()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["total", "pairs", "first", "last"])


def lcp(a: bytes, b: bytes) -> int:
    """Bytes that a and b begin with in common: doubling, then halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    step, at = 16, 0
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def adjacent_prefixes(df: DataFrame, value: str = "value") -> DataFrame:
    """One row: lcp_sum, pairs and avg_lcp (0 without pairs) over neighbours in byte order, duplicates included.

    The collection is sorted by ranges. Each partition sends its sum and its outer values; only their few rows meet.
    """
    ordered = df.select(F.col(value).cast("binary").alias("v")).where("v is not null").repartitionByRange("v").sortWithinPartitions("v")
    parts = ordered.mapInArrow(_prefix_sums, "total long, pairs long, first binary, last binary")

    def stitch(group):
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("first", "last", "total", "pairs")), strict=True))
        seams = [lcp(a[1], b[0]) for a, b in zip(rows, rows[1:], strict=False)]
        total, pairs = sum(r[2] for r in rows) + sum(seams), sum(r[3] for r in rows) + len(seams)
        return pa.table({"lcp_sum": [total], "pairs": [pairs], "avg_lcp": [total / pairs if pairs else 0.0]})

    return parts.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(stitch, "lcp_sum long, pairs long, avg_lcp double")


def printed(df: DataFrame, file: str, value: str = "value") -> DataFrame:
    """One row with the whole profile as text: file, count with separators of thousands, and the rest to two decimals."""
    one = basics(df, value).crossJoin(alphabet(df, value)).crossJoin(adjacent_prefixes(df, value))  # of one row each
    two = lambda c: F.format_string("%.2f", F.coalesce(c, F.lit(0.0)))
    return one.select(
        F.lit(file).alias("file"), F.format_number("n", 0).alias("count_n"), F.concat(two(F.col("unique_pct")), F.lit("%")).alias("unique"), F.concat(two(F.col("avg_bytes")), F.lit(" bytes")).alias("avg_length"),
        F.col("alphabet").cast("string").alias("alphabet_size"), F.concat(two(F.col("avg_lcp")), F.lit(" bytes")).alias("avg_lcp"),
    )
