"""Bounded Bloom filters over 64-bit keys, built by key shard on the workers.

Mappers emit, for each shard of the key space, one blob of their distinct keys. A reducer sees
all blobs of a shard, so it knows which keys repeat; each shard owns a segment of the filter.
The filter's size follows the number of keys up to MAX_BITS. It only ever answers `maybe`
for more keys than it holds: all users stay exact whatever it says beyond its keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import U64, mix, release, unique_counts
from .shared import stored

PROBES = 4
BITS_PER_KEY = 16
MAX_BITS = 1 << 28  # 32 MB
_STEP = U64(0x9E3779B97F4A7C15)


class KeyFilter:
    """Bits of all shards' segments, one after the other; shards and segment bits are powers of two."""

    def __init__(self, shards: int, segment_bits: int, bits: np.ndarray):
        self.shards, self.segment_bits, self.bits = shards, segment_bits, bits

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], U64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        base = (keys >> U64(64 - (self.shards.bit_length() - 1))) * U64(self.segment_bits) if self.shards > 1 else np.zeros_like(keys)
        found = np.ones(len(keys), bool)
        at = np.arange(len(keys))
        for j in range(PROBES):
            p = probe(keys[at], j, self.segment_bits) + base[at]
            ok = (self.bits[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8)) & 1
            found[at[ok == 0]] = False
            at = at[ok == 1]
        return found


def probe(keys: np.ndarray, j: int, segment_bits: int) -> np.ndarray:
    return mix(keys + U64(((j + 1) * int(_STEP)) & ((1 << 64) - 1))) & U64(segment_bits - 1)


def segment(keys: np.ndarray, segment_bits: int) -> bytes:
    flat = np.zeros(segment_bits, bool)
    for j in range(PROBES):
        flat[probe(keys, j, segment_bits).astype(np.int64)] = True
    return np.packbits(flat, bitorder="little").tobytes()


def build_filter(keys: DataFrame, shards: int, max_bits: int = MAX_BITS) -> KeyFilter:
    """The filter of a table (shard int, keys binary of uint64, n long) that has one row a shard at most."""
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(max_bits, max(64 * shards, 1 << int(total * BITS_PER_KEY).bit_length()))
    segment_bits = max(64, bits // shards)

    def build(batches):
        for b in batches:
            own = [segment(np.frombuffer(k, U64), segment_bits) for k in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(own, pa.binary())], names=["shard", "bits"])

    out = np.zeros(shards * segment_bits // 8, np.uint8)
    size = segment_bits // 8
    for row in keys.where("n > 0").select("shard", "keys").mapInArrow(build, "shard int, bits binary").toLocalIterator():
        out[row["shard"] * size : (row["shard"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return KeyFilter(shards, segment_bits, out)


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys by byte plane: sorted keys share their high bytes, which shuffle compression then takes out."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(U64).ravel()


def frequent_keys(blobs: DataFrame, least: tuple[int, ...], tag: str) -> list[DataFrame]:
    """For blobs (shard int, keys binary of distinct sorted uint64, counts binary of int32) and each bound, the stored table (shard, keys, n) of keys whose counts sum to it at least."""

    def reduce(key, group):
        keys = np.concatenate([unpack_keys(x) for x in group.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in group.column("counts").to_pylist()])
        keys, counts = unique_counts(keys, counts.astype(np.int64))
        kept = [keys[counts >= m] for m in least]
        release()
        return pa.table({"shard": pa.array([key[0].as_py()] * len(least), pa.int32()), "level": pa.array(range(len(least)), pa.int32()), "keys": pa.array([k.tobytes() for k in kept], pa.binary()), "n": pa.array([len(k) for k in kept], pa.int64())})

    table = stored(blobs.groupBy("shard").applyInArrow(reduce, "shard int, level int, keys binary, n long"), tag)
    return [table.where(F.col("level") == i).drop("level") for i in range(len(least))]


BLOB_SCHEMA = "shard int, keys binary, counts binary"


def count_blobs(pieces, shards: int, hold: int = 1 << 19):
    """Record batches of BLOB_SCHEMA for the key arrays that `pieces` yields; counts are pre-summed over up to `hold` distinct keys."""
    from .bytekit import blobs

    keys, counts, held = [], [], 0

    def flush():
        k, c = unique_counts(np.concatenate(keys), np.concatenate(counts))
        rows = list(blobs(k, shards, np.minimum(c, 1 << 30).astype(np.int32)))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([pack_keys(np.frombuffer(r[1], U64)) for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "counts"])

    for piece in pieces:
        k, c = piece if isinstance(piece, tuple) else unique_counts(piece)
        if len(k):
            keys.append(k)
            counts.append(c)
            held += len(k)
        if held > hold:
            yield flush()
            keys, counts, held = [], [], 0
    if held:
        yield flush()
    release()
