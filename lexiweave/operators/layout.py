"""Positions, byte offsets and size-bounded blocks of an ordered collection.

Ids are dealt to buckets of consecutive ids: of equal ranges where they are dense, else between quantiles. Running sums inside a bucket are a window; the buckets' totals are a
small table with a running sum of its own. So no task orders the whole collection.

Greedy packing is a running sum with resets. A bucket's effect on it depends on one number, the offset where the
block that is open at its start began. Every bucket tabulates, for the items at which a block may first
begin in it, where the last block in it begins and how many begin; one task reads these tables in order, one after the
other, and each bucket then knows its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16  # rows at most
BUCKETS = 8192  # at most, where ids are sparse
BLOCK = 64 * 1024  # bytes
BATCH = 4 * 1024 * 1024


def with_offsets(df: DataFrame, id_column: str = "id", value: str = "value", bucket: int | None = None) -> DataFrame:
    """df with pos (0-based), start and end (byte offsets) in the order of its unique ids, and bucket.

    bucket: rows a bucket should have; by default about a thousandth of them, 1,024 at least and 65,536 at most. A null id is an error; a null value takes no bytes.
    """
    refused = F.raise_error(F.lit(f"null in {id_column}, which orders the collection")).cast("long")
    df = _bucketed(df, id_column, bucket).withColumn("bucket", F.when(F.col(id_column).isNull(), refused).otherwise(F.col("bucket")))
    df = df.withColumn("size", F.coalesce(F.octet_length(value).cast("long"), F.lit(0)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("items"))
    bases = totals.select("bucket", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"), F.coalesce(F.sum("items").over(before), F.lit(0)).alias("item_base"))
    inside = Window.partitionBy("bucket").orderBy(id_column)
    run = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = df.withColumn("upto", run).withColumn("number", F.row_number().over(inside) - 1)
    out = placed.join(bases, "bucket")
    return out.withColumns({"pos": F.col("item_base") + F.col("number"), "end": F.col("byte_base") + F.col("upto")}).withColumn("start", F.col("end") - F.col("size")).drop("upto", "number", "item_base", "byte_base")


def _bucketed(df: DataFrame, id_column: str, rows: int | None) -> DataFrame:
    """df with bucket, which never falls as ids grow. One pass over the ids where they are dense, a second where they aren't."""
    about = df.agg(F.count(id_column).alias("n"), F.min(id_column).alias("low"), F.max(id_column).alias("high")).first()
    number, n = F.col(id_column), about["n"]
    rows = rows or min(BUCKET, max(1024, n // 1024))
    if not n or about["high"] - about["low"] < 4 * n:
        return df.withColumn("bucket", F.floor(number / rows).cast("long"))
    count = min(BUCKETS, -(-n // rows))
    # Doubles join neighbours beyond 2**53 but never swap them.
    borders = sorted(set(df.approxQuantile(id_column, [k / count for k in range(1, count)], 0.25 / count))) if count > 1 else []
    if not borders:
        return df.withColumn("bucket", F.lit(0).cast("long"))
    inf = float("inf")
    cut = Bucketizer(splits=[-inf, *borders, inf], inputCol=id_column, outputCol="bucket", handleInvalid="keep")
    return cut.transform(df.drop("bucket")).withColumn("bucket", F.col("bucket").cast("long"))


def _chains(start: np.ndarray, end: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item as the beginning of a block: the item at which the last block of the bucket begins, and how many begin from here on."""
    n = len(start)
    jump = np.maximum(np.searchsorted(end, start + limit, side="right"), np.arange(1, n + 1))
    last, count = np.arange(n), np.ones(n, np.int64)
    jump = np.append(jump, n)
    while True:
        live = np.flatnonzero(jump[:n] < n)
        if not len(live):
            return last, count
        to = jump[live]
        add = count[to]
        last[live] = last[to]
        count[live] += add
        jump[live] = jump[to]


def _tabulate(limit):
    def run(key, group):
        order = np.argsort(group.column("pos").to_numpy())
        start, end = group.column("start").to_numpy()[order], group.column("end").to_numpy()[order]
        last, count = _chains(start, end, limit)
        # A block open at the bucket's start began at most `limit` bytes before it, unless it is one larger item.
        n = min(len(start), int(np.searchsorted(end, start[0] + limit, side="right")) + 1)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "ends": pa.array([end[:n].tobytes()], pa.binary()), "lasts": pa.array([start[last[:n]].tobytes()], pa.binary()), "counts": pa.array([count[:n].tobytes()], pa.binary())})

    return run


def _walk(limit):
    def run(batches):
        """Tables of all buckets in order; only a batch of them is held."""
        opened, blocks = None, 0
        for batch in batches:
            out = []
            for bucket, *table in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends, lasts, counts = (np.frombuffer(x, np.int64) for x in table)
                out.append((bucket, opened, blocks))
                at = 0 if opened is None else int(np.searchsorted(ends, opened + limit, side="right"))
                if at < len(ends):
                    opened, blocks = int(lasts[at]), blocks + int(counts[at])
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["bucket", "opened", "blocks"])

    return run


def _assign(limit):
    def run(items, state):
        order = np.argsort(items.column("pos").to_numpy())
        start, end = items.column("start").to_numpy()[order], items.column("end").to_numpy()[order]
        opened, block = state.column("opened")[0].as_py(), state.column("blocks")[0].as_py() - 1
        ids = np.full(len(start), block, np.int64)
        at = 0 if opened is None else int(np.searchsorted(end, opened + limit, side="right"))
        while at < len(start):
            block += 1
            to = max(at + 1, int(np.searchsorted(end, start[at] + limit, side="right")))
            ids[at:to] = block
            at = to
        return pa.table({"pos": items.column("pos").to_numpy()[order], "block_id": ids})

    return run


def block_ids(offsets: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(pos, block_id): greedy packing by position; a block is closed before the item that would take it above `limit` bytes.

    Items aren't split, a larger one has a block of its own, and blocks are never empty.
    """
    items = offsets.select("bucket", "pos", "start", "end")
    tables = items.groupBy("bucket").applyInArrow(_tabulate(limit), "bucket long, ends binary, lasts binary, counts binary")
    states = tables.repartition(1).sortWithinPartitions("bucket").mapInArrow(_walk(limit), "bucket long, opened long, blocks long")
    return items.groupBy("bucket").cogroup(states.groupBy("bucket")).applyInArrow(_assign(limit), "pos long, block_id long")


def with_blocks(offsets: DataFrame, limit: int = BLOCK) -> DataFrame:
    return offsets.join(block_ids(offsets, limit), "pos")


def block_metadata(blocks: DataFrame) -> DataFrame:
    """(block_id, first_pos, n_items, items_psum, start, raw_bytes) of each block. items_psum is first_pos + n_items: positions are dense."""
    g = blocks.groupBy("block_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_items"), F.min("start").alias("start"), F.sum("size").alias("raw_bytes"))
    return g.select("block_id", "first_pos", "n_items", (F.col("first_pos") + F.col("n_items")).alias("items_psum"), "start", "raw_bytes")


def in_block_delimiters(blocks: DataFrame, metadata: DataFrame) -> DataFrame:
    """(pos, block_id, item_start, item_end): offsets from the item's block's start."""
    joined = blocks.join(metadata.select("block_id", F.col("start").alias("origin")), "block_id")
    return joined.select("pos", "block_id", (F.col("start") - F.col("origin")).alias("item_start"), (F.col("end") - F.col("origin")).alias("item_end"))


def find_block(queries: DataFrame, metadata: DataFrame, idx: str = "idx", step: int = 4096) -> DataFrame:
    """queries with block_id: the block with first_pos <= idx < items_psum. An equi-join on spans of `step` positions; an idx outside has no row."""
    spans = metadata.select("block_id", "first_pos", "items_psum", F.explode(F.sequence(F.floor(F.col("first_pos") / step), F.floor((F.col("items_psum") - 1) / step))).alias("span"))
    keyed = queries.withColumn("span", F.floor(F.col(idx) / step))
    return keyed.join(spans, "span").where((F.col(idx) >= F.col("first_pos")) & (F.col(idx) < F.col("items_psum"))).drop("span", "items_psum")
