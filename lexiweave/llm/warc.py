"""WARC archives: writing with revisit records, and reading by verified record boundaries.

Writing: digests are grouped to find equal payloads, and Spark's text writer puts out one
file a row, so the commit protocol covers lost tasks. A file holds records of FILE_BYTES together, or a single larger one.
Reading: every occurrence of the version line is a *candidate* record with a pointer to
its successor (its end by Content-Length). Pointer jumping from the start of the file keeps the
candidates that the chain reaches; a version line inside a payload is never reached.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored

VERSION = b"WARC/1.1\r\n"
TERMINATOR = "\r\n\r\n"
MIN_REVISIT = 100  # payload bytes from which equal payloads are stored once
FILE_BYTES = 16 << 20  # a record that is larger has a file of its own
BROADCAST_GROUPS = 50_000  # up to so many groups of equal payloads (digest and id, below 8 MB) are broadcast
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.I)


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row to WARC files under `path`.

    Among rows with equal payloads of at least MIN_REVISIT bytes, the one with the smallest id becomes a response
    (all of them, if rows repeat that id or no id is known), the others are revisits that refer to it. Null payloads
    are empty; null ids and URLs are left out of the record. An empty table gives an empty folder. Line ends in URLs
    are percent-encoded.
    """
    p = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.coalesce(payload_column, F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload"))
    groups = p.where(F.col("size") >= MIN_REVISIT).groupBy(F.col("digest").alias("g")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("g", "first_id")
    groups = stored(groups, "payloads")
    few = groups.count() <= BROADCAST_GROUPS
    p = p.join(F.broadcast(groups) if few else groups, (F.col("digest") == F.col("g")) & (F.col("size") >= MIN_REVISIT), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    eol = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("size").cast("string"), F.lit(eol * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"{VERSION.decode()}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.coalesce(F.concat(F.lit(f"{eol}WARC-Record-ID: <urn:page:"), F.col("id").cast("string"), F.lit(">")), F.lit("")),
        F.coalesce(F.concat(F.lit(f"{eol}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{eol}WARC-Date: {date}{eol}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{eol}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{eol}WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{eol}Content-Type: application/http; msgtype=response{eol}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(eol * 2),
    )
    records = p.select(F.concat(header, block).cast("binary").alias("value"))
    records.mapInArrow(lambda batches: _files(batches, file_bytes), "value string").write.option("lineSep", TERMINATOR).option("maxRecordsPerFile", 1).text(path)


def _files(batches, file_bytes: int):
    """One row for each file: records with the terminator between them."""
    held, size = [], 0

    def out():
        return pa.record_batch([pa.array([TERMINATOR.encode().join(held)], pa.binary()).cast(pa.string())], names=["value"])

    for batch in batches:
        for value in batch.column(0):
            record = value.as_py()
            if held and size + len(record) > file_bytes:
                yield out()
                held, size = [], 0
            held.append(record)
            size += len(record) + len(TERMINATOR)
    if held:
        yield out()


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offset, successor) of all version lines in an archive; successor -1 where no header with a length follows before the next version line."""
    at = np.array([m.start() for m in re.finditer(re.escape(VERSION), data)], np.int64)
    blank = np.array([*(m.start() for m in re.finditer(b"(?=\r\n\r\n)", data)), len(data)], np.int64)
    end = blank[np.searchsorted(blank, at)]
    to = np.full(len(at), -1, np.int64)
    for k in np.flatnonzero(end < np.append(at[1:], len(data))).tolist():
        if m := _LENGTH.search(data, at[k], end[k] + 2):
            to[k] = end[k] + 4 + int(m[1][:18]) + 4
    return at, to


def reachable(at: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping: log2(n) doublings.

    Raises ValueError when the chain ends anywhere but at the end of the file.
    """
    n = len(at)
    if n == 0 or at[0] != 0:
        if size:
            raise ValueError("no record at the start of the archive")
        return np.zeros(0, bool)
    nxt = np.searchsorted(at, to)
    ok = (to >= 0) & (nxt < n) & (at[np.minimum(nxt, n - 1)] == to)
    jump = np.append(np.where(ok, nxt, n), n)
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    while True:
        before = reached.sum()
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        if reached.sum() == before and (jump == n).all():
            break
    reached = reached[:n]
    last = np.flatnonzero(reached)[-1]
    if to[last] != size:
        raise ValueError(f"the record at byte {at[last]} doesn't end where a record or the file ends")
    return reached


def parse(record: bytes) -> dict:
    """The fields of a record: id, url, type, refers_to, digest (as written), payload."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.search(rb"<urn:page:(-?\d+)>", fields.get(name, b""))) else None
    size = _LENGTH.search(http + b"\r\n")
    return {"id": number(b"warc-record-id"), "url": fields.get(b"warc-target-uri"), "type": fields.get(b"warc-type", b"").decode(), "refers_to": number(b"warc-refers-to"), "digest": fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:"), "size": int(size[1]) if size else len(payload), "payload": payload}


RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _read(batches, with_payload: bool):
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")][: None if with_payload else -1]
    for batch in batches:
        for data in batch.column(0):
            data = data.as_py()
            at, to = candidates(data)
            keep = reachable(at, to, len(data))
            rows, held = [], 0
            for a, b in zip(at[keep].tolist(), to[keep].tolist(), strict=True):
                r = parse(data[a : b - 4])
                if r["type"] == "revisit":
                    size, digest = r["size"], r["digest"]
                else:
                    size, digest = len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()
                    if digest != r["digest"]:
                        raise ValueError(f"payload digest differs in the record at byte {a}")
                rows.append((r["id"], r["url"] and r["url"].decode(), r["type"], r["refers_to"], size, digest, r["payload"])[: len(names)])
                held += len(r["payload"]) if with_payload else 200
                if held > 4 << 20:
                    yield _batch(rows, names)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.record_batch([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def read_warc(spark, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under `path`: page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload].

    A response's size and digest are taken from the payload that was read, and the digest must equal the written
    one; a revisit's are those of the full payload that its headers state. An archive whose chain of records is
    broken is an error. A task holds one archive at a time: those of write_warc are bounded, others should be.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    schema = RECORD_SCHEMA if with_payload else RECORD_SCHEMA.rsplit(", ", 1)[0]
    return files.mapInArrow(lambda batches: _read(batches, with_payload), schema)


def archive(pages: DataFrame, **columns) -> DataFrame:
    """Write `pages` to archives in the shared folder and read them back, without payloads."""
    path = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, path, **columns)
    return read_warc(pages.sparkSession, path, with_payload=False)


__all__ = ["archive", "candidates", "parse", "reachable", "read_warc", "write_warc"]
