"""Encoding collections, decoding them, and point lookups.

An encoded collection is a table of segments: (segment_id, first_pos, n_items, raw_bytes, payload, item_ends). For a
codec of blocks a segment is a block; else it is a string with n_items 1. Dictionaries are a table of their own
(dict_id, entries), with one row, or one for each batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.codecs.dictionary import TRAIN_BYTES, PairConfig, PairTokens, SymbolTable, parts
from lexiweave.codecs.registry import BLOCK_METADATA, Codec, find
from lexiweave.operators.layout import BATCH, block_ids, find_block, with_blocks, with_offsets

SEGMENTS = "segment_id long, first_pos long, n_items long, raw_bytes long, payload binary, item_ends array<long>, dict_id long"
SAMPLE_ROWS = 20_000


@dataclass
class Encoded:
    codec: Codec
    segments: DataFrame
    tables: object = None  # broadcast dictionary of a trained codec; batches carry theirs in `dicts`
    dicts: DataFrame | None = None
    dict_bytes: int = 0
    width: int | None = None  # of a stored encoding: positions a folder `span` holds


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _encode_blocks(codec: Codec):
    def run(batches):
        """Rows (block_id, pos, value) of a partition sorted so."""
        block, first, parts, out, held = None, None, [], [], 0

        def put():
            data = b"".join(parts)
            return (block, first, len(parts), len(data), codec.encode(data), np.cumsum([len(p) for p in parts]).tolist(), None)

        for batch in batches:
            for b, pos, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    if parts:
                        out.append(put())
                        held += out[-1][3]
                        if held > 4 << 20:
                            yield _segment_batch(out)
                            out, held = [], 0
                    block, first, parts = b, pos, []
                parts.append(v)
        if parts:
            out.append(put())
        if out:
            yield _segment_batch(out)

    return run


def _encode_strings(encode):
    def run(batches):
        for batch in batches:
            out = []
            for pos, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append((pos, pos, 1, len(v), encode(v), [len(v)], None))
            if out:
                yield _segment_batch(out)

    return run


def _encode_trained(table):
    def run(batches):
        for batch in batches:
            pos, values = batch.column(0), batch.column(1)
            for k, n in slices(values):
                own = values.slice(k, n)
                yield _trained_batch(pos.slice(k, n), own, table.encode_all(own), pa.nulls(n, pa.int64()))

    return run


def slices(values: pa.Array, limit: int = 16 << 20):
    """(first, count) of runs of values of about `limit` bytes, so that codes stay far below what an array can hold."""
    _, ends = parts(values)
    k = 0
    while k < len(values):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + limit, side="right")) - 1)
        yield k, to - k
        k = to


def _trained_batch(pos: pa.Array, values: pa.Array, payload: pa.Array, dict_id: pa.Array) -> pa.RecordBatch:
    sizes, n = pa.array(np.diff(parts(values)[1])), len(values)
    ends = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), sizes)
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    return pa.record_batch([pos, pos, pa.array(np.ones(n, np.int64)), sizes, payload, ends, dict_id], names=names)


def training_sample(offsets: DataFrame, rows: int = SAMPLE_ROWS, budget: int = TRAIN_BYTES) -> list[bytes]:
    """About `budget` bytes in pieces of at most `rows` values, at least 256 bytes each where they have them.

    Values and the places of their pieces are chosen by hashes of the position: the same for the same collection.
    """
    n = offsets.count()
    piece = max(256, -(-budget // max(1, min(n, rows))))
    few = offsets.orderBy(F.xxhash64("pos")).limit(min(rows, -(-budget // piece) * 4))
    place = F.pmod(F.xxhash64("pos", F.lit(1)), F.greatest(F.col("size") - piece + 1, F.lit(1))) + 1
    got, size = [], 0
    for r in few.select(F.substring(F.col("value").cast("binary"), place.cast("int"), F.lit(piece)).alias("v")).toLocalIterator():
        got.append(bytes(r["v"]))
        size += len(got[-1])
        if size >= budget:
            break
    return got


def compress(offsets: DataFrame, key: str, train=None, config: PairConfig | None = None) -> Encoded:
    """Encode a collection with offsets (pos, value, bucket, start, end, size).

    train: an already trained dictionary, for codecs that have one. config: how onpair finds its tokens.
    """
    codec = find(key)
    if config is not None and key != "onpair":
        raise ValueError(f"{key} takes no configuration")
    if codec.unit == "block":
        blocks = with_blocks(offsets).select("block_id", "pos", F.col("value").cast("binary").alias("value"))
        placed = blocks.repartition("block_id").sortWithinPartitions("block_id", "pos")
        return Encoded(codec, placed.mapInArrow(_encode_blocks(codec), SEGMENTS))
    rows = offsets.select("pos", F.col("value").cast("binary").alias("value"))
    if codec.unit == "string":
        return Encoded(codec, rows.mapInArrow(_encode_strings(codec.encode), SEGMENTS))
    if codec.unit == "trained":
        if train is None:
            sample = training_sample(offsets)
            train = PairTokens.train(sample, config or PairConfig()) if key == "onpair" else SymbolTable.train(sample)
        table = train
        shared = offsets.sparkSession.sparkContext.broadcast(table)
        size = table.dict_bytes if key == "onpair" else SymbolTable.DICT_BYTES
        return Encoded(codec, rows.mapInArrow(lambda batches: _encode_trained(shared.value)(batches), SEGMENTS), tables=shared, dict_bytes=size)
    batched = offsets.join(block_ids(offsets, BATCH).withColumnRenamed("block_id", "dict_id"), "pos").select("dict_id", "pos", F.col("value").cast("binary").alias("value"))

    def per_batch(key_, group):
        group = group.sort_by("pos").combine_chunks()
        pos, values = (group.column(c).combine_chunks() for c in ("pos", "value"))
        table = SymbolTable.train(_pieces(values))
        symbols = b"".join(bytes([len(s)]) + s for s in table.symbols)  # the row of segment -1 has the batch's dictionary
        rows = _trained_batch(pos, values, table.encode_all(values), pa.array(np.full(len(pos), key_[0].as_py(), np.int64)))
        return pa.Table.from_batches([rows, _segment_batch([(-1, -1, 0, 0, symbols, [], key_[0].as_py())])])

    both = batched.groupBy("dict_id").applyInArrow(per_batch, SEGMENTS)
    return Encoded(codec, both.where("segment_id >= 0"), dicts=both.where("segment_id < 0").select("dict_id", F.col("payload").alias("entries")), dict_bytes=SymbolTable.DICT_BYTES)


def _pieces(values: pa.Array, count: int = 64) -> list[bytes]:
    """Pieces of 256 bytes from evenly spaced places of all values together, none over a value's end."""
    data, ends = parts(values)
    out = []
    for k in np.unique(np.linspace(0, max(len(data) - 1, 0), count).astype(np.int64)).tolist() if len(data) else ():
        out.append(data[k : min(k + 256, int(ends[np.searchsorted(ends, k, side="right")]))].tobytes())
    return out


def parse_symbols(entries: bytes) -> SymbolTable:
    out, i = [], 0
    while i < len(entries):
        out.append(entries[i + 1 : i + 1 + entries[i]])
        i += 1 + entries[i]
    return SymbolTable(out)


def _items(encoded: Encoded) -> DataFrame:
    """(first_pos, raw_bytes, payload, item_ends, entries) for decoding; entries only for a dictionary a batch."""
    s = encoded.segments
    if encoded.dicts is not None:
        s = s.join(encoded.dicts, "dict_id")
    else:
        s = s.withColumn("entries", F.lit(None).cast("binary"))
    return s


def _decoder(encoded: Encoded):
    codec, shared = encoded.codec, encoded.tables
    if codec.unit == "trained":
        return lambda payload, size, entries: shared.value.decode(payload)
    if codec.unit == "trained_batch":
        known: dict[bytes, SymbolTable] = {}

        def decode(payload, size, entries):
            if entries not in known:
                known.clear()
                known[entries] = parse_symbols(entries)
            return known[entries].decode(payload)

        return decode
    return lambda payload, size, entries: codec.decode(payload, size)


def _decode_trained(table, first: pa.Array, size: pa.Array, payload: pa.Array):
    for k, n in slices(payload, 4 << 20):
        values = table.decode_all(payload.slice(k, n), size.slice(k, n).to_numpy())
        yield pa.record_batch([first.slice(k, n), values], names=["pos", "value"])


def decompress(encoded: Encoded) -> DataFrame:
    """(pos, value) of all items, in no particular order."""
    schema, columns = "pos long, value binary", ("first_pos", "raw_bytes", "payload")
    if encoded.codec.unit == "trained":
        shared = encoded.tables

        def trained(batches):
            for batch in batches:
                yield from _decode_trained(shared.value, *batch.columns)

        return encoded.segments.select(*columns).mapInArrow(trained, schema)
    if encoded.codec.unit == "trained_batch":  # a dictionary meets its own batch's rows once

        def batch_of(rows, dicts):
            table = parse_symbols(dicts.column("entries")[0].as_py())
            got = _decode_trained(table, *(rows.column(c).combine_chunks() for c in columns))
            return pa.Table.from_batches(list(got), schema=pa.schema([("pos", pa.int64()), ("value", pa.binary())]))

        return encoded.segments.select("dict_id", *columns).groupBy("dict_id").cogroup(encoded.dicts.select(F.col("dict_id").alias("of"), "entries").groupBy("of")).applyInArrow(batch_of, schema)
    codec = encoded.codec

    def run(batches):
        for batch in batches:
            pos, values, held = [], [], 0
            for first, size, payload, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, at = codec.decode(payload, size), 0
                for k, e in enumerate(ends):
                    pos.append(first + k)
                    values.append(data[at:e])
                    at = e
                held += size
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(pos, pa.int64()), pa.array(values, pa.binary())], names=["pos", "value"])
                    pos, values, held = [], [], 0
            if pos:
                yield pa.record_batch([pa.array(pos, pa.int64()), pa.array(values, pa.binary())], names=["pos", "value"])

    return encoded.segments.select(*columns, "item_ends").mapInArrow(run, schema)


SPAN, SPANS = 1 << 16, 2_000  # positions of a stored folder at least, folders at most


def store(encoded: Encoded, path: str) -> None:
    """Write an encoding as Parquet under `path`, which must not exist: segments in folders of consecutive positions, dictionaries beside them.

    lookup() on what load() gives reads only the folders it needs.
    """
    spark = encoded.segments.sparkSession
    # A trained dictionary isn't larger than 2**16 tokens of 16 bytes; batches' dictionaries stay a table.
    tokens = [] if encoded.tables is None else getattr(encoded.tables.value, "tokens", None) or encoded.tables.value.symbols
    n = encoded.segments.agg(F.coalesce(F.max("first_pos"), F.lit(0))).first()[0] + 1
    width = max(SPAN, -(-n // SPANS))
    placed = encoded.segments.withColumn("span", F.floor(F.col("first_pos") / width)).repartition("span").sortWithinPartitions("span", "first_pos")
    placed.write.partitionBy("span").parquet(f"{path}/segments")
    if encoded.dicts is not None:
        encoded.dicts.write.parquet(f"{path}/dicts")
    about = [(encoded.codec.key, encoded.dict_bytes, width, [bytearray(t) for t in tokens])]
    spark.createDataFrame(about, "codec string, dict_bytes long, width long, tokens array<binary>").coalesce(1).write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Encoded:
    """An encoding that store() wrote, ready for decompress, lookup and space."""
    about = spark.read.parquet(f"{path}/about").first()
    codec = find(about["codec"])
    segments = spark.read.schema(f"{SEGMENTS}, span long").parquet(f"{path}/segments")
    tables = None
    if codec.unit == "trained":
        kind = PairTokens if codec.key == "onpair" else SymbolTable
        tables = spark.sparkContext.broadcast(kind([bytes(t) for t in about["tokens"]]))
    dicts = spark.read.schema("dict_id long, entries binary").parquet(f"{path}/dicts") if codec.unit == "trained_batch" else None
    return Encoded(codec, segments, tables, dicts, about["dict_bytes"], about["width"])


def lookup(encoded: Encoded, queries: DataFrame) -> DataFrame:
    """(qid, idx, value) for queries (qid, idx); an idx outside has no row. Only the segments asked for are decoded, each once for all its queries.

    A string codec's segment is found by an equi-join on its position, a block by one on spans of positions.
    """
    decode = _decoder(encoded)
    items = _items(encoded)
    if encoded.codec.unit == "block":
        meta = encoded.segments.select(F.col("segment_id").alias("block_id"), "first_pos", (F.col("first_pos") + F.col("n_items")).alias("items_psum"))
        found = find_block(queries, meta).select(F.col("block_id").alias("segment_id"), "qid", "idx")
    else:
        found = queries.select(F.col("idx").alias("segment_id"), "qid", "idx")
    on = ["segment_id"]
    if encoded.width is not None:
        on.append("span")
        if encoded.codec.unit == "block":
            found = found.join(encoded.segments.select("segment_id", "span"), "segment_id")
        else:
            found = found.withColumn("span", F.floor(F.col("idx") / encoded.width))
        found = found.where("span >= 0")  # a filter, by which Spark knows that pruning the folders pays
    asked = found.groupBy(*on).agg(F.collect_list(F.struct("qid", "idx")).alias("asked"))

    def run(batches):
        for batch in batches:
            out = []
            for first, size, payload, ends, entries, who in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = decode(payload, size, entries)
                for q in who:
                    k = q["idx"] - first
                    out.append((q["qid"], q["idx"], data[ends[k - 1] if k else 0 : ends[k]]))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["qid", "idx", "value"])

    joined = items.join(asked, on).select("first_pos", "raw_bytes", "payload", "item_ends", "entries", "asked")
    return joined.mapInArrow(run, "qid long, idx long, value binary")


def space(encoded: Encoded) -> DataFrame:
    """One row: codec, n_items, raw_bytes, payload_bytes, dict_bytes, metadata_bytes, offset_bytes, space_used (payload, dictionaries and block metadata), space_total (with 8 bytes an item for offsets), rate."""
    block = encoded.codec.unit == "block"
    own = encoded.segments.agg(
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("payload_bytes"),
        (F.count("*") * (BLOCK_METADATA if block else 0)).alias("metadata_bytes"), F.count_distinct("dict_id").alias("batches"),
    )
    dicts = F.col("batches") * encoded.dict_bytes if encoded.dicts is not None else F.lit(encoded.dict_bytes).cast("long")
    own = own.withColumn("dict_bytes", dicts).withColumn("offset_bytes", F.col("n_items") * 8)
    own = own.withColumn("space_used", F.col("payload_bytes") + F.col("dict_bytes") + F.col("metadata_bytes"))
    own = own.withColumn("space_total", F.col("space_used") + F.col("offset_bytes"))
    rate = F.when(F.col("space_used") > 0, F.col("raw_bytes").cast("double") / F.col("space_used"))
    return own.select(F.lit(encoded.codec.key).alias("codec"), "n_items", "raw_bytes", "payload_bytes", "dict_bytes", "metadata_bytes", "offset_bytes", "space_used", "space_total", rate.alias("rate"))


def verify(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """One row: n_items, mismatches. Values must agree in length and bytes, and every position must be on both sides."""
    both = original.select("pos", F.col("value").cast("binary").alias("want"), F.lit(True).alias("l")).join(decoded.select("pos", F.col("value").alias("got"), F.lit(True).alias("r")), "pos", "full_outer")
    bad = F.col("l").isNull() | F.col("r").isNull() | ~F.col("want").eqNullSafe(F.col("got"))
    return both.agg(F.count("l").alias("n_items"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("mismatches"))


def query_workload(collection: DataFrame, queries: int, seed: int | None = None) -> DataFrame:
    """(qid, idx): positions drawn with replacement; without a seed by a closed form that SQL can repeat. None for an empty collection."""
    n = collection.count()
    spark = collection.sparkSession
    if not n:
        return spark.range(0).select(F.col("id").alias("qid"), F.col("id").alias("idx"))
    idx = F.pmod(F.col("id") * 2654435761 + 13, F.lit(n)) if seed is None else F.least(F.floor(F.rand(seed) * n), F.lit(n - 1))
    return spark.range(queries).select(F.col("id").alias("qid"), idx.cast("long").alias("idx"))


__all__ = ["Encoded", "compress", "decompress", "load", "lookup", "query_workload", "space", "store", "training_sample", "verify", "with_offsets"]
