"""Connected components of links held in a DataFrame, without gathering them anywhere.

Links are contracted inside every partition with a union-find. While more are left than one task may
hold, a round runs a large-star and a small-star step. Minima are taken by partial aggregation and brought
back by an equi-join, so a node with very many links is never gathered into one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the links but the smallest themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches):
    seen_a, seen_b, held = [], [], 0
    for batch in batches:
        seen_a.append(batch.column(0).to_numpy())
        seen_b.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held > 2_000_000:
            a, b = forest(np.concatenate(seen_a), np.concatenate(seen_b))
            seen_a, seen_b, held = [a], [b], len(a)
            if held > 1_000_000:
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["u", "v"])
                seen_a, seen_b, held = [], [], 0
    if held:
        a, b = forest(np.concatenate(seen_a), np.concatenate(seen_b))
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["u", "v"])


FINISH = 1 << 21  # contracted links (32 MB) that one task joins at once


def _finish(batches):
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        node, low = forest(*(np.concatenate(x) for x in zip(*got, strict=True)))
        top = np.unique(low)
        yield pa.record_batch([pa.array(np.concatenate((node, top))), pa.array(np.concatenate((low, top)))], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (two bigint columns without nulls): the smallest node it reaches.

    Nodes without links don't appear; an empty table gives an empty one. The result is stored in the shared folder.
    Rounds go on until at most FINISH links are left, which one task joins, or until nothing changes.
    """
    edges = links.toDF("u", "v").where("u <> v").mapInArrow(_contract, "u long, v long")
    edges, before = stored(edges, "links"), None
    while True:
        count = edges.count()
        if count <= FINISH:
            return stored(edges.coalesce(1).mapInArrow(_finish, "node long, component long"), "components")
        state = count, edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct().mapInArrow(_contract, "u long, v long").distinct(), "links")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops), "components")
