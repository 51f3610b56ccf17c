"""Exact removal of long repeated byte strings by a logarithmic family of suffix arrays.

A string of `length` bytes that occurs twice is found through its anchor, the smallest of the
hashes of the shorter strings inside it (leftmost on ties): equal strings have equal anchors at equal
offsets. Anchors are a few hundredths of all positions.

1. Count anchors over the whole corpus; two bounded filters hold those seen twice and those seen often.
2. Around each anchor that may repeat, send the text its windows cover to the anchor's key. A task reads
   its keys in batches. Each batch gets a suffix array of its windows - in byte order up to `length`, equal ones as one, and equal
   only by their bytes - which is merge-scanned against the arrays of earlier batches; arrays of about equal size are
   merged, so there are logarithmically many.
3. Anchors seen often would make hot keys. Their windows' fingerprints of 96 bits are dealt by fingerprint instead, after
   each chunk of documents has reduced them to distinct ones, and those that meet another are repeats.
4. Covered spans come back by row and are merged. Rows are known by 128 bits of hash of their text.

Texts are worked on in pieces of CHUNK bytes, which overlap by a window.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import U64, blobs, chunked, mix, powers, prefix_hash, release, span_hash
from .filters import BLOB_SCHEMA, build_filter, count_blobs, frequent_keys, pack_keys, unpack_keys
from .shared import fresh, passing, shards_for, stored, tidied

LENGTH = 200
HOT = 48  # occurrences from which an anchor's windows are dealt by fingerprint
CHUNK = 1_900_000
CONTEXTS = 4_096  # contexts that a batch has at least, where the anchors allow it
RID = np.dtype([("a", np.int64), ("b", np.int64)])


class Bytes:
    """Strings of `length` bytes in a buffer, compared by big-endian words of eight."""

    def __init__(self, buf: np.ndarray, length: int):
        self.buf, self.length = buf, length
        self.words = np.ndarray(len(buf) + 1, ">u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
        self.offsets = [min(k, max(0, length - 8)) for k in range(0, length, 8)]

    def word(self, at: np.ndarray, offset: int) -> np.ndarray:
        w = self.words[at + offset].astype(U64)
        return w >> U64(64 - 8 * self.length) if self.length < 8 else w

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        for k in self.offsets:
            same = self.word(a[at], k) == self.word(b[at], k)
            ok[at[~same]] = False
            at = at[same]
        return ok

    def order(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings' byte order, and for each place in it whether its string equals the one before."""
        key = self.word(at, 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        tied = np.zeros(len(at), bool)
        tied[1:] = key[1:] == key[:-1]
        for k in self.offsets[1:]:
            either = tied.copy()
            either[:-1] |= tied[1:]
            places = np.flatnonzero(either)
            if not len(places):
                break
            group = np.cumsum(~tied[places])
            key = self.word(at[order[places]], k)
            by = np.lexsort((key, group))
            order[places], key = order[places][by], key[by]
            tied[places[1:]] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        return order, tied


class SuffixFamily:
    """Suffix arrays of batches: distinct strings of `length` bytes in byte order, with an owner of each. add() marks every string that equals another one."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # buffer, places in order, owners
        self.repeated = np.zeros(1 << 16, bool)
        self.size = 0

    def add(self, buf: np.ndarray, at: np.ndarray) -> None:
        """The strings at these places of a buffer."""
        ids = np.arange(self.size, self.size + len(at))
        self.size += len(at)
        while len(self.repeated) < self.size:
            self.repeated = np.concatenate((self.repeated, np.zeros_like(self.repeated)))
        if not len(at):
            return
        text = Bytes(buf, self.length)
        prints = span_hash(prefix_hash(buf), at, at + self.length)
        order = np.argsort(prints)
        maybe = np.flatnonzero(prints[order[1:]] == prints[order[:-1]])
        same = maybe[text.equal(at[order[maybe]], at[order[maybe + 1]])]
        self.repeated[ids[order[same]]] = True
        self.repeated[ids[order[same + 1]]] = True
        first = np.ones(len(at), bool)
        first[order[same + 1]] = False
        self._push(buf, at[first], ids[first])

    def _push(self, buf: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        at, ids = self._array(buf, at, ids)
        for other, places, owners in self.levels:
            self._array(np.concatenate((other, buf)), np.concatenate((places, at + len(other))), np.concatenate((owners, ids)))
        self.levels.append((buf, at, ids))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][1]) > len(self.levels[-2][1]):
            (b, q, j), (a, p, i) = self.levels.pop(), self.levels.pop()
            both = np.concatenate((a, b))
            self.levels.append((both, *self._array(both, np.concatenate((p, q + len(a))), np.concatenate((i, j)))))

    def _array(self, buf: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, owners) of the distinct strings in byte order, from a merge-scan that marks equal neighbours."""
        order, tied = Bytes(buf, self.length).order(at)
        again = np.flatnonzero(tied)
        self.repeated[ids[order[again]]] = True
        self.repeated[ids[order[again - 1]]] = True
        return at[order[~tied]], ids[order[~tied]]


class Anchors:
    """The anchors of a chunk's windows: hash, position, and first and last window start, each in `buf`; doc of each."""

    def __init__(self, texts: list[bytes], length: int):
        k = max(1, min(64, length // 3))
        w = length - k + 1
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate(([0], np.cumsum(size)))
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.sums = prefix_hash(self.buf)
        n = len(self.buf)
        empty = np.empty(0, np.int64)
        self.hash, self.pos, self.first, self.last, self.doc = np.empty(0, U64), empty, empty, empty, empty
        if n < length or not (size >= length).any():
            return
        # Order by the high half of a multiplied hash; the smallest over each window by doubling.
        order = self.sums[k:] - self.sums[:-k]
        order *= powers(n + 1)[1][: n - k + 1]
        order *= U64(0xD1342543DE82EF95)
        h = (order >> U64(32)).astype(np.uint32)
        low, step = h, 1
        while 2 * step <= w:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < w:
            low = np.minimum(low[: n - length + 1], low[w - step : w - step + n - length + 1])
        # Runs of windows with one smallest value, inside one document each.
        cut = np.flatnonzero(low[1:] != low[:-1]) + 1
        starts = self.at[:-1][size >= length]
        begin = np.union1d(cut, starts)
        doc = np.searchsorted(self.at, begin, side="right") - 1
        end = np.minimum(np.append(begin[1:], n - length + 1) - 1, self.at[doc + 1] - length)
        ok = (end >= begin) & (doc >= 0)
        begin, end, doc = begin[ok], end[ok], doc[ok]
        entered = np.zeros(len(begin), bool)  # a value below the last window's entered with its last place
        inner = begin > self.at[doc]
        entered[inner] = low[begin[inner]] < low[begin[inner] - 1]
        pos, first, last, owner = [], [], [], []
        while len(begin):
            at = begin + w - 1
            look = np.flatnonzero(~entered)
            for i in range(0, len(look), 4096):
                some = look[i : i + 4096]
                at[some] = begin[some] + (h[begin[some][:, None] + np.arange(w)] == low[begin[some]][:, None]).argmax(axis=1)
            stop = np.minimum(end, at)  # windows from beyond `at` have the next such place as their leftmost
            pos.append(at)
            first.append(begin)
            last.append(stop)
            owner.append(doc)
            more = end > at
            begin, end, doc, entered = at[more] + 1, end[more], doc[more], np.zeros(int(more.sum()), bool)
        pos, first, last, doc = map(np.concatenate, (pos, first, last, owner))
        by = np.argsort(first, kind="stable")
        self.pos, self.first, self.last, self.doc = pos[by], first[by], last[by], doc[by]
        self.hash = span_hash(self.sums, self.pos, self.pos + k)


def _slices(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """A binary array of buf[start:stop] for each pair."""
    size = stop - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf[index]))])


def _pieces(batches, length: int):
    """(texts, rids, offsets) pieces of rows (rid, rid2, t): whole texts, or parts of a long one that overlap by length - 1 bytes."""
    for rows, texts in chunked(batches, "t", CHUNK):
        rid = np.empty(len(texts), RID)
        rid["a"], rid["b"] = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("rid", "rid2"))
        if len(texts) > 1 or len(texts[0] or b"") <= 2 * CHUNK:
            yield texts, rid, np.zeros(len(texts), np.int64)
        else:
            for lo in range(0, len(texts[0]) - length + 1, CHUNK):
                yield [texts[0][lo : lo + CHUNK + length - 1]], rid, np.array([lo])


class _Contexts:
    """Distinct texts around chosen anchors of a chunk, with the rows and positions of each."""

    def __init__(self, a: Anchors, chosen: np.ndarray, rid: np.ndarray, offset: np.ndarray, length: int):
        first, stop, pos, doc = a.first[chosen], a.last[chosen] + length, a.pos[chosen], a.doc[chosen]
        content = mix(span_hash(a.sums, first, stop) + (pos - first).astype(U64))
        _, index, where = np.unique(content, return_index=True, return_inverse=True)
        self.many = np.bincount(where, minlength=len(index)) > 1
        place = first - a.at[doc] + offset[doc]
        order = np.lexsort((place, rid["b"][doc], rid["a"][doc], where))
        row, place, owner = rid[doc[order]], place[order], where[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))  # equal rows need one span
        self.row, self.row_pos = row[new], place[new].astype(np.int32)
        self.n_rows = np.bincount(owner[new], minlength=len(index))
        self.first, self.stop, self.hash = first[index], stop[index], a.hash[chosen][index]
        self.cuts = np.concatenate(([0], np.cumsum(self.n_rows)))


def _expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of `count` members: each member's group, and its number in the group."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


def _spans(flag: np.ndarray, n_windows: np.ndarray, n_rows: np.ndarray, row: np.ndarray, row_pos: np.ndarray, length: int):
    """(row, start, stop) arrays: for every row of a context, what its marked windows cover."""
    context, j = _expand(n_windows)
    on = np.flatnonzero(flag)
    if not len(on):
        return np.empty(0, RID), np.empty(0, np.int32), np.empty(0, np.int32)
    head = np.concatenate(([True], (on[1:] != on[:-1] + 1) | (context[on[1:]] != context[on[:-1]])))
    tail = np.append(head[1:], True)
    owner, start, stop = context[on[head]], j[on[head]], j[on[tail]] + length
    run, k = _expand(n_rows[owner])
    at = (np.cumsum(n_rows) - n_rows)[owner[run]] + k
    return row[at], (row_pos[at] + start[run]).astype(np.int32), (row_pos[at] + stop[run]).astype(np.int32)


def _joined(row: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """The spans by row and start, those of one row that overlap or touch as one."""
    if not len(row):
        return row, start, stop
    by = np.lexsort((start, row["b"], row["a"]))
    row, start, stop = row[by], start[by], stop[by]
    base = np.cumsum(np.concatenate(([False], row[1:] != row[:-1])), dtype=np.int64) << 32
    reach = np.maximum.accumulate(base + stop)
    head = np.concatenate(([True], (base + start)[1:] > reach[:-1]))
    tail = np.append(head[1:], True)
    return row[head], start[head], (reach - base)[tail].astype(np.int32)


SPANS = "rid long, rid2 long, start int, stop int"


def _span_batch(row, start, stop):
    return pa.record_batch([pa.array(np.ascontiguousarray(row["a"])), pa.array(np.ascontiguousarray(row["b"])), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["rid", "rid2", "start", "stop"])


def _contexts(batches, maybe, hot, length):
    for texts, rid, offset in _pieces(batches, length):
        a = Anchors(texts, length)
        ok = maybe.has(a.hash)
        ok[ok] = ~hot.has(a.hash[ok])
        if not ok.any():
            continue
        c = _Contexts(a, np.flatnonzero(ok), rid, offset, length)
        row_bytes, place_bytes, size = c.row.view(np.uint8), c.row_pos.view(np.uint8), RID.itemsize
        yield pa.record_batch([pa.array(c.hash.view(np.int64)), _slices(a.buf, c.first, c.stop), _slices(row_bytes, c.cuts[:-1] * size, c.cuts[1:] * size), _slices(place_bytes, c.cuts[:-1] * 4, c.cuts[1:] * 4), pa.array(c.many)], names=["anchor", "text", "rows", "places", "many"])


def _match(batches, length):
    """Batches sorted by anchor; the family is emptied where an anchor ends and enough windows are held."""
    family, held, last = SuffixFamily(length), [], None

    def flush():
        flag = family.repeated[: family.size]
        out, at = [], 0
        for n_windows, n_rows, row, row_pos, many in held:
            size = n_windows.sum()
            own = flag[at : at + size] | np.repeat(many, n_windows)
            at += size
            out.append(_spans(own, n_windows, n_rows, row, row_pos, length))
        return _span_batch(*(np.concatenate(x) for x in zip(*out, strict=True)))

    for batch in batches:
        anchors = batch.column(0).to_numpy()
        cut = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        if last is not None and len(anchors) and anchors[0] != last:
            cut = np.concatenate(([0], cut))
        lo = 0
        while lo < len(anchors):
            if family.size > 1_000_000 and lo in cut:
                yield flush()
                family, held = SuffixFamily(length), []
            at = np.searchsorted(cut, lo + CONTEXTS)
            hi = min(int(cut[at]) if at < len(cut) else len(anchors), len(anchors))
            hi = min(hi, lo + 2 * CONTEXTS)
            texts = batch.column(1).slice(lo, hi - lo).to_pylist()
            rows = batch.column(2).slice(lo, hi - lo).to_pylist()
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            begin = np.cumsum(size) - size
            n_windows = size - length + 1
            n_rows = np.fromiter(map(len, rows), np.int64, len(rows)) // RID.itemsize
            context, j = _expand(n_windows)
            start = begin[context] + j
            family.add(np.frombuffer(b"".join(texts), np.uint8), start)
            held.append((n_windows, n_rows, np.frombuffer(b"".join(rows), RID), np.frombuffer(b"".join(batch.column(3).slice(lo, hi - lo).to_pylist()), np.int32), batch.column(4).slice(lo, hi - lo).to_numpy(zero_copy_only=False)))
            lo = hi
        if len(anchors):
            last = anchors[-1]
        release()
    if held:
        yield flush()
    release()


HOT_SCHEMA = "uid long, shard int, first int, prints binary, checks binary, many binary, inverse binary, n_windows binary, n_rows binary, row binary, row_pos binary"


def _hot_windows(batches, hot, length, shards):
    """For each chunk: distinct fingerprints of its hot windows by shard, and one row to read the answers with."""
    names = [x.split()[0] for x in HOT_SCHEMA.split(", ")]
    for texts, rid, offset in _pieces(batches, length):
        a = Anchors(texts, length)
        ok = hot.has(a.hash)
        if not ok.any():
            continue
        c = _Contexts(a, np.flatnonzero(ok), rid, offset, length)
        n_windows = c.stop - c.first - length + 1
        context, j = _expand(n_windows)
        start = c.first[context] + j
        prints, index, inverse, count = np.unique(span_hash(a.sums, start, start + length), return_index=True, return_inverse=True, return_counts=True)
        many = count > 1
        many[inverse[np.repeat(c.many, n_windows)]] = True
        checks = (span_hash(a.sums, start[index], start[index] + length // 2) >> U64(32)).astype(np.uint32)
        uid = int.from_bytes(os.urandom(8), "little") >> 1
        out, at = [], 0
        for k, p, x, m in blobs(prints, shards, checks, many):  # prints are sorted, so that a blob's are numbered from `at` on
            out.append((uid, k, at, pack_keys(np.frombuffer(p, U64)), x, m, None, None, None, None, None))
            at += len(m)
        out.append((uid, -1, None, None, None, None, inverse.astype(np.int32).tobytes(), n_windows.astype(np.int32).tobytes(), c.n_rows.astype(np.int32).tobytes(), c.row.tobytes(), c.row_pos.tobytes()))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 8, strict=True)], names=names)


def _hot_repeats(key, group):
    """Of each chunk the numbers of its windows that another chunk has too, or that are many in it."""
    held = [unpack_keys(x) for x in group.column("prints").to_pylist()]
    prints, checks = np.concatenate(held), np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("checks").to_pylist()])
    flag = np.concatenate([np.frombuffer(x, bool) for x in group.column("many").to_pylist()])
    order = np.lexsort((checks, prints))
    same = np.flatnonzero((prints[order[1:]] == prints[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]]))
    flag[order[same]] = flag[order[same + 1]] = True
    cuts = np.cumsum([0, *map(len, held)])
    number = [(first + np.flatnonzero(flag[cuts[i] : cuts[i + 1]])).astype(np.int32).tobytes() for i, first in enumerate(group.column("first").to_pylist())]
    release()
    return pa.table({"uid": group.column("uid"), "number": pa.array(number, pa.binary())})


def _hot_spans(length):
    def back(key, answers, own):
        inverse = np.frombuffer(own.column("inverse")[0].as_py(), np.int32)
        flag = np.zeros(int(inverse.max()) + 1, bool)
        for x in answers.column("number").to_pylist():
            flag[np.frombuffer(x, np.int32)] = True
        n_windows, n_rows, row_pos = (np.frombuffer(own.column(c)[0].as_py(), np.int32) for c in ("n_windows", "n_rows", "row_pos"))
        row, start, stop = _spans(flag[inverse], n_windows.astype(np.int64), n_rows.astype(np.int64), np.frombuffer(own.column("row")[0].as_py(), RID), row_pos, length)
        return pa.Table.from_batches([_span_batch(*_joined(row, start, stop))])

    return back


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, rid2, start, stop): bytes covered by repeated strings, of docs (rid long, rid2 long, t binary). Spans may overlap; equal rows share a rid and are told apart as occurrences."""
    shards = shards_for(docs)
    context = docs.sparkSession.sparkContext
    counts = docs.mapInArrow(lambda batches: count_blobs((Anchors(texts, length).hash for texts, *_ in _pieces(batches, length)), shards), BLOB_SCHEMA)
    with tidied(docs.sparkSession):
        tables = frequent_keys(counts, (2, HOT), "anchors")
    maybe, hot = (context.broadcast(build_filter(t, shards)) for t in tables)
    with tidied(docs.sparkSession), passing(docs.mapInArrow(lambda batches: _hot_windows(batches, hot.value, length, shards), HOT_SCHEMA), "hot") as often:
        answers = often.where("shard >= 0").select("uid", "shard", "first", "prints", "checks", "many").groupBy("shard").applyInArrow(_hot_repeats, "uid long, number binary")
        own = often.where("shard < 0").drop("shard", "first", "prints", "checks", "many")
        found = stored(answers.groupBy("uid").cogroup(own.groupBy("uid")).applyInArrow(_hot_spans(length), SPANS), "hot-spans")
    near = docs.mapInArrow(lambda batches: _contexts(batches, maybe.value, hot.value, length), "anchor long, text binary, rows binary, places binary, many boolean")
    return near.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: _match(batches, length), SPANS).union(found)


def merged(spans) -> list[tuple[int, int]]:
    """Sorted (start, stop) spans with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with `repeats`: array<struct<start, stop>> of byte spans, sorted (not merged), null where there are none.

    Bytes are those of the text in UTF-8; null texts are empty. A byte is covered when a string of `length` bytes over
    it also starts elsewhere in this or any other row; repeated rows count as occurrences of each other. Rows are known by
    two hashes of the whole text, so any ids, also null or repeated ones, will do: equal texts have equal spans.
    """
    rid, rid2 = fresh("rid", docs), fresh("rid2", docs)
    of = F.xxhash64(text), F.xxhash64(F.lit("second"), F.reverse(text))
    spans = repeated_spans(docs.where(F.octet_length(text) >= length).select(of[0].alias("rid"), of[1].alias("rid2"), F.col(text).cast("binary").alias("t")), length)
    with tidied(docs.sparkSession):
        spans = stored(spans.groupBy("rid", "rid2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("repeats")).toDF(rid, rid2, "repeats"), "spans")
    keyed = docs.withColumn(rid, of[0]).withColumn(rid2, of[1])
    return keyed.join(spans.hint("shuffle_hash"), [rid, rid2], "left").drop(rid, rid2)


def cut_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def strip_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with every repeated byte cut from the texts. A character that loses some of its bytes goes whole; null stays null."""
    found = with_spans(docs, text, length)

    def cut(batches):
        for batch in batches:
            at, sp = batch.schema.get_field_index(text), batch.schema.get_field_index("repeats")
            out = [t if not s else cut_bytes(t.encode(), merged([(x["start"], x["stop"]) for x in s])).decode("utf-8", "ignore") for t, s in zip(batch.column(at).to_pylist(), batch.column(sp).to_pylist(), strict=True)]
            keep = [k for k in range(batch.num_columns) if k != sp]
            yield pa.record_batch([pa.array(out, pa.string()) if k == at else batch.column(k) for k in keep], names=[batch.schema.names[k] for k in keep])

    return found.mapInArrow(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row under strip_repeats' rule, on bytes."""
    found = with_spans(docs.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("t")), "t", length)

    def digest(batches):
        for batch in batches:
            n, removed, n_spans, sha = [], [], [], []
            for t, s in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = merged([(x["start"], x["stop"]) for x in s or ()])
                kept = cut_bytes(t, own)
                n.append(len(t))
                removed.append(len(t) - len(kept))
                n_spans.append(len(own))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, n_spans)), pa.array(sha, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return found.select("id", "t", "repeats").mapInArrow(digest, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_column)
