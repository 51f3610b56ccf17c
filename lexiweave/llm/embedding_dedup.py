"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors whose cosine is at least c are at most eps = sqrt(2 - 2c) apart, and a projection brings nothing farther
apart. Equal vectors of a label are collapsed first. The others are projected on leading principal directions and sorted by grid
cells of side eps, label by label; the sorted sequence is cut into blocks. Two blocks are joined when their
intervals of the leading coordinate are within eps (an equi-join on its cells) and their boxes are. A
task joins two sequences recursively, skipping halves whose boxes are provably distant, and multiplies what remains
in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import stored

COSINE = 0.98
DIRECTIONS = 6
SAMPLE = 4_096  # vectors that the principal directions are fitted on, by a hash order
BLOCK = 1_024
LEAF = 256


def fit_directions(vectors: np.ndarray, k: int = DIRECTIONS) -> np.ndarray:
    """[dim, k] leading eigenvectors of the vectors' second moments."""
    _, v = np.linalg.eigh(vectors.T @ vectors)
    return np.ascontiguousarray(v[:, ::-1][:, :k])


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _grid(batches, basis: np.ndarray, eps: float):
    names = ["label", "dim", "c", "copies", "cells", "coords", "unit"]
    for batch in batches:
        for dim in np.unique(batch.column(1).to_numpy()):
            rows = batch.filter(pa.compute.equal(batch.column(1), int(dim)))
            v = _unit(rows.column(4).flatten().to_numpy(zero_copy_only=False), int(dim))
            d = min(int(dim), len(basis))
            x = v[:, :d] @ basis[:d]
            cells = np.floor(x / eps).astype(np.int32)
            put = lambda a, t: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a).ravel(), t), a.shape[1]).cast(pa.list_(t))
            yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), rows.column(3), put(cells, pa.int32()), put(x, pa.float64()), pa.array([r.tobytes() for r in v], pa.binary())], names=names)


BLOCKS = "label string, dim int, block long, n int, low array<double>, high array<double>, ids binary, copies binary, coords binary, units binary"


def _pack(batches):
    """Consecutive rows of a sorted partition as blocks of one label and dimension."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    held: list = []

    def put(rows):
        x = np.array([r[5] for r in rows])
        return pa.record_batch([pa.array([v], t) for v, t in ((rows[0][0], pa.string()), (rows[0][1], pa.int32()), (rows[0][2], pa.int64()), (len(rows), pa.int32()), (x.min(axis=0).tolist(), pa.list_(pa.float64())), (x.max(axis=0).tolist(), pa.list_(pa.float64())), (np.array([r[2] for r in rows], np.int64).tobytes(), pa.binary()), (np.array([r[3] for r in rows], np.int64).tobytes(), pa.binary()), (x.tobytes(), pa.binary()), (b"".join(r[6] for r in rows), pa.binary()))], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or row[1] != held[0][1] or len(held) >= BLOCK):
                yield put(held)
                held = []
            held.append(row)
    if held:
        yield put(held)


def sequence_join(a, b, same: bool, eps: float, cosine: float, found) -> None:
    """Recursive join of two grid-ordered sequences (coords, units, offset); found(i, j) gets arrays of linked places."""
    (xa, ua, i), (xb, ub, j) = a, b
    gap = np.maximum(0, np.maximum(xa.min(axis=0) - xb.max(axis=0), xb.min(axis=0) - xa.max(axis=0)))
    if math.sqrt(float((gap * gap).sum())) > eps:
        return
    if len(xa) <= LEAF and len(xb) <= LEAF:
        p, q = np.nonzero(ua @ ub.T >= cosine)
        p, q = p + i, q + j
        if same:
            p, q = p[p < q], q[p < q]
        if len(p):
            found(p, q)
        return
    halves = lambda s: [s] if len(s[0]) <= LEAF else [(s[0][: (m := len(s[0]) // 2)], s[1][:m], s[2]), (s[0][m:], s[1][m:], s[2] + m)]
    for k, s in enumerate(halves(a)):
        for m, t in enumerate(halves(b)):
            if not same or i != j or k <= m:
                sequence_join(s, t, same, eps, cosine, found)


def _join(batches, eps, cosine):
    """For pairs of blocks: links (id, other, 0), a forest of each leaf's; and counts (id, null, linked copies)."""
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for dim, ka, ida, na, xa, ua, kb, idb, nb, xb, ub in zip(*cols, strict=True):
            ids_a, ids_b = np.frombuffer(ida, np.int64), np.frombuffer(idb, np.int64)
            copies_a, copies_b = np.frombuffer(na, np.int64), np.frombuffer(nb, np.int64)
            seq = lambda x, u, n: (np.frombuffer(x).reshape(n, -1), np.frombuffer(u).reshape(n, dim), 0)
            count_a, count_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
            u, v = [], []

            def found(p, q):
                np.add.at(count_a, p, copies_b[q])  # noqa: B023
                np.add.at(count_b, q, copies_a[p])  # noqa: B023
                x, y = forest(ids_a[p], ids_b[q])  # noqa: B023
                u.append(x)  # noqa: B023
                v.append(y)  # noqa: B023

            sequence_join(seq(xa, ua, len(ids_a)), seq(xb, ub, len(ids_b)), ka == kb, eps, cosine, found)
            if u:
                on_a, on_b = np.flatnonzero(count_a), np.flatnonzero(count_b)
                ids = np.concatenate([*u, ids_a[on_a], ids_b[on_b]])
                links = sum(map(len, u))
                other = pa.array(np.concatenate([*v, np.zeros(len(on_a) + len(on_b), np.int64)]), mask=np.arange(len(ids)) >= links)
                yield pa.record_batch([pa.array(ids), other, pa.array(np.concatenate((np.zeros(links, np.int64), count_a[on_a], count_b[on_b])))], names=["id", "other", "linked"])


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows are compared when their labels are equal and not null and their vectors equally long. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing and are their own component. component_id is the smallest id
    that links reach, null where no row of it has an id; kept says that it is the row's own (false without an id).
    Repeated rows are linked with each other. Ids are 64-bit integers.
    """
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64("label", "v"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64("v", "label", F.lit(1))))
    classes = rows.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "vectors")
    sample = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if sample:
        width = max(len(r["v"]) for r in sample)
        m = np.zeros((len(sample), width))
        for k, r in enumerate(sample):
            m[k, : len(r["v"])] = _unit(np.array(r["v"]), len(r["v"]))[0]
        basis = spark.sparkContext.broadcast(fit_directions(m))
        k = basis.value.shape[1]
        placed = classes.select("label", F.size("v").alias("dim"), "c", "copies", "v").mapInArrow(lambda b: _grid(b, basis.value, eps), "label string, dim int, c long, copies long, cells array<int>, coords array<double>, unit binary")
        order = ["label", "dim", *(F.col("cells")[i] for i in range(k)), "c"]
        n = max(1, -(-classes.count() // (4 * BLOCK)))
        blocks = stored(placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_pack, BLOCKS), "blocks")
        meta = blocks.select("label", "dim", "block", "low", "high")
        cell = lambda x: F.floor(x / eps).cast("int")
        left = meta.select("label", "dim", F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(cell(F.col("low")[0] - eps), cell(F.col("high")[0] + eps))).alias("cell"))
        right = meta.select("label", "dim", F.col("block").alias("b"), "low", "high", F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("cell"))
        gap = F.zip_with(F.zip_with("low_a", "high", lambda x, y: x - y), F.zip_with("low", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
        near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= eps * eps
        pairs = left.join(right, ["label", "dim", "cell"]).where((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()
        side = lambda s: blocks.select(F.col("block").alias(s), "dim", *(F.col(c).alias(c + s) for c in ("ids", "copies", "coords", "units")))
        pairs = pairs.join(side("a"), "a").join(side("b").drop("dim"), "b")
        joined = stored(pairs.select("dim", "a", "idsa", "copiesa", "coordsa", "unitsa", "b", "idsb", "copiesb", "coordsb", "unitsb").mapInArrow(lambda b: _join(b, eps, cosine), "id long, other long, linked long"), "links")
        linked = joined.where("other is null").groupBy(F.col("id").alias("c")).agg(F.sum("linked").alias("linked"))
        labels = components(joined.where("other is not null").select("id", "other"))
        lowest = labels.join(classes.select("c", "low"), F.col("node") == F.col("c")).groupBy("component").agg(F.min("low").alias("lowest"))
        reached = labels.join(lowest, "component").select("node", "lowest")
        named = classes.select("k1", "k2", "c", "copies", "low").join(linked, "c", "left").join(reached, F.col("c") == F.col("node"), "left")
        component = F.when(F.col("node").isNull(), F.col("low")).otherwise(F.col("lowest"))
        named = named.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), component.alias("component_id"))
        alone = rows.where("ok").select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n_links", "component_id").union(alone)
    return alone.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


__all__ = ["fit_directions", "near_duplicates", "sequence_join"]
