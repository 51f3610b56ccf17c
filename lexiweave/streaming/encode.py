"""Encoding and decoding a stream with a frozen dictionary. Each string is encoded alone, so no state is kept."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.operators.engine import slices


def _mapped(stream: DataFrame, table, source: str, target: str, step) -> DataFrame:
    """stream with `target`: `source` through step(table, array without nulls), null for null."""
    shared = stream.sparkSession.sparkContext.broadcast(table)
    keep = [c for c in stream.columns if c != target]

    def run(batches):
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            filled = values.fill_null(b"")
            for k, n in slices(filled):
                out = pc.if_else(values.slice(k, n).is_valid(), step(shared.value, filled.slice(k, n)), pa.scalar(None, pa.binary()))
                yield pa.record_batch([*batch.slice(k, n).columns[:-1], out], names=[*keep, target])

    schema = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in keep)
    return stream.select(*keep, F.col(source).cast("binary").alias("__bytes")).mapInArrow(run, f"{schema}, `{target}` binary")


def encode_stream(stream: DataFrame, table, value: str = "value", code: str = "code") -> DataFrame:
    """stream (batch or streaming) with `code`: value encoded by a trained table, null for null."""
    return _mapped(stream, table, value, code, lambda t, values: t.encode_all(values))


def decode_stream(stream: DataFrame, table, code: str = "code", value: str = "value") -> DataFrame:
    """stream (batch or streaming) with `value`, binary: what encode_stream made `code` of."""
    return _mapped(stream, table, code, value, lambda t, codes: pa.array([t.decode(c) for c in codes.to_pylist()], pa.binary()))
