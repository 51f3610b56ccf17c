"""Benchmark decontamination with an FM-index for each training shard.

A window is 10 consecutive words of a benchmark item (a shorter item is one window). A shard's
searchable text is what could hold a window at all: the maximal runs of benchmark words that are as long as
the shortest window, each followed by a separator. Over it the task builds a suffix array, its
Burrows-Wheeler transform in a wavelet tree with ranks, and sampled suffix positions. All windows are searched
backward at once; the occurrences are located by walking to sampled positions and merged into
removal spans. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import ALNUM, Tokens, chunked

WORDS = 10
SAMPLE_EVERY = 8
SHARD_BYTES = 3 << 20
ITEM_BLOCK_BYTES = 2 << 20  # benchmark text whose windows are broadcast together


class WaveletTree:
    """Ranks over a sequence of small integers, one bit plane a level, highest bit first."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        v = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (v >> level) & 1
            count = np.zeros(len(v) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(v) - int(count[-1]))
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(at), at
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = (symbol >> level) & 1
            one_lo, one_hi = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            lo = np.where(bit, self.zeros[k] + one_lo, lo - one_lo)
            hi = np.where(bit, self.zeros[k] + one_hi, hi - one_hi)
        return hi - lo


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only positions whose rank is still shared are sorted again."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    first = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))  # a rank is the first place of its group
    open_at = np.arange(n)
    while True:
        sorted_rank = rank[order[open_at]]
        same = np.zeros(len(open_at), bool)
        eq = (sorted_rank[1:] == sorted_rank[:-1])
        same[1:] |= eq
        same[:-1] |= eq
        open_at = open_at[same]
        if not len(open_at):
            return order
        pos = order[open_at]
        nxt = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)], -1)
        by = np.lexsort((nxt, rank[pos]))
        pos, nxt = pos[by], nxt[by]
        order[open_at] = pos
        head = np.ones(len(pos), bool)
        head[1:] = (rank[pos][1:] != rank[pos][:-1]) | (nxt[1:] != nxt[:-1])
        start = np.flatnonzero(head)
        rank[pos] = np.repeat(open_at[start], np.diff(np.append(start, len(pos))))
        k *= 2


class FMIndex:
    """Backward search over a sequence of symbols 1..sigma-1 with 0 as separator."""

    def __init__(self, values: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        text, sigma = np.append(values + 1, 0), sigma + 1  # 0 is the end, 1 the separator
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.tree = WaveletTree(self.bwt, sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.sampled = order % every == 0
        self.place = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of equally long patterns [n, m]."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for c in patterns.T[::-1] + 1:
            alive = np.flatnonzero(lo < hi)
            if not len(alive):
                break
            s = c[alive]
            lo[alive], hi[alive] = self.before[s] + self.tree.rank(s, lo[alive]), self.before[s] + self.tree.rank(s, hi[alive])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by stepping back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            done = self.sampled[r]
            out[todo[done]] = self.samples[self.place[r[done]]] + steps[todo[done]]
            todo, r = todo[~done], r[~done]
            s = self.bwt[r]
            rows[todo] = self.before[s] + self.tree.rank(s, r)
            steps[todo] += 1
        return out


class Windows:
    """The distinct windows of benchmark items: by length a matrix of symbols, and for window k its items owners[cuts[k]:cuts[k+1]]."""

    def __init__(self, items: list[tuple], vocabulary: np.ndarray, words: int = WORDS):
        t = Tokens([x or b"" for _, x in items], ALNUM)
        symbol = (np.searchsorted(vocabulary, t.hash) + 1).astype(np.int32)
        size = np.diff(t.bounds)
        self.ids = [None if i is None else str(i) for i, _ in items]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in np.unique(np.minimum(size[size > 0], words)).tolist():
            own = np.flatnonzero(size >= words) if m == words else np.flatnonzero(size == m)
            count = size[own] - m + 1
            item = np.repeat(own, count)
            start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + t.bounds[:-1][item]
            matrix, inverse = np.unique(symbol[start[:, None] + np.arange(m)], axis=0, return_inverse=True)
            pairs = np.unique(inverse.ravel() * len(items) + item)
            self.by_length[m] = matrix, np.searchsorted(pairs, np.arange(len(matrix) + 1) * len(items)), pairs % len(items)


class Symbols:
    """The benchmark's words as symbols 1.., and how long its shortest window is."""

    def __init__(self, vocabulary: np.ndarray, shortest: int):
        self.vocabulary, self.shortest = vocabulary, shortest
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        """Symbols of word hashes, 0 for words that no item has."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.gate[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.vocabulary, h[maybe])
            hit = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == h[maybe]
            out[maybe[hit]] = at[hit] + 1
        return out


def index_words(symbol: np.ndarray, bounds: np.ndarray, symbols: Symbols) -> tuple[FMIndex, np.ndarray] | None:
    """An FM-index of a shard's runs of benchmark words and the word at each of its places; bounds are where documents begin."""
    n = len(symbol)
    known = np.zeros(n + 2, bool)
    known[1:-1] = symbol > 0
    begins = known[1:-1] & ~known[:-2]
    begins[bounds[(bounds < n)]] |= known[1:-1][bounds[(bounds < n)]]
    start = np.flatnonzero(begins)
    gaps = np.flatnonzero(~known[1:-1])
    stop = np.append(start[1:], n)
    if len(gaps):
        at = np.searchsorted(gaps, start)
        stop = np.minimum(stop, np.where(at < len(gaps), gaps[np.minimum(at, len(gaps) - 1)], n))
    long = stop - start >= max(1, symbols.shortest)
    start, stop = start[long], stop[long]
    if not len(start):
        return None
    size = stop - start + 1
    offset = np.concatenate(([0], np.cumsum(size)))
    origin = np.repeat(start - offset[:-1], size) + np.arange(offset[-1])
    text = symbol[np.minimum(origin, n - 1)]
    text[offset[1:] - 1] = 0
    return FMIndex(text, len(symbols.vocabulary) + 1), origin


def occurrences(index: FMIndex, origin: np.ndarray, w: Windows):
    """(first words, length, items, occurrence of each item) of the windows of each length that occur."""
    for m, (patterns, cuts, owners) in w.by_length.items():
        lo, hi = index.search(patterns)
        hit = np.flatnonzero(lo < hi)
        if len(hit):
            count = (hi - lo)[hit]
            rows = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            which = np.repeat(hit, count)
            n_items = np.diff(cuts)[which]
            place = np.repeat(np.arange(len(which)), n_items)
            items = owners[cuts[which[place]] + np.arange(len(place)) - np.repeat(np.cumsum(n_items) - n_items, n_items)]
            yield origin[index.locate(rows)], m, items, place


def merge_spans(first: np.ndarray, stop: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the maximal runs of hit words; documents, which begin at bounds, aren't joined."""
    n = int(bounds[-1])
    depth = np.bincount(first, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    on = np.concatenate(([False], np.cumsum(depth)[:n] > 0, [False]))
    begins, ends = on[1:] & ~on[:-1], on[:-1] & ~on[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    both = inner[on[inner] & on[inner + 1]]
    begins[both] = ends[both] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


FOUND = "n_words long, spans array<struct<start:int,stop:int,first_word:int,last_word:int>>, items array<string>"


def _find(batches, column, keep, symbols: Symbols, blocks: list):
    """blocks: broadcast Windows, of which one is held at a time if there are several."""
    kinds = ("start", "stop", "first_word", "last_word")
    for rows, texts in chunked(batches, column, SHARD_BYTES):
        t = Tokens([x or b"" for x in texts], ALNUM)
        bounds = t.bounds - t.bounds[0]
        built = index_words(symbols.of(t.hash), bounds, symbols) if symbols.shortest and len(t.hash) else None
        first, stop, named = [], [], [set() for _ in texts]
        for block in blocks if built else ():
            w = block.value
            for at, m, items, place in occurrences(*built, w):
                first.append(at)
                stop.append(at + m)
                doc = np.searchsorted(bounds, at, side="right") - 1
                for pair in np.unique(doc[place] * len(w.ids) + items).tolist():
                    if (name := w.ids[pair % len(w.ids)]) is not None:
                        named[pair // len(w.ids)].add(name)
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)
        a, z = merge_spans(np.concatenate(first), np.concatenate(stop), bounds) if first else (np.empty(0, np.int64), np.empty(0, np.int64))
        doc = np.searchsorted(bounds, a, side="right") - 1
        fields = [t.start[a] - t.at[doc], t.end[z - 1] - t.at[doc], a - bounds[doc], z - bounds[doc]]
        spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in fields], kinds)
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)), spans)
        kept = [rows.column(rows.schema.get_field_index(c)) for c in keep]
        yield pa.record_batch([*kept, pa.array(np.diff(t.bounds), pa.int64()), spans, pa.array([sorted(x) for x in named], pa.list_(pa.string()))], names=[*keep, "n_words", "spans", "items"])


def _vocabulary(batches):
    """Distinct word hashes, and at kind 1 the lengths of windows up to 65,536 words."""
    for _, texts in chunked(batches, "t"):
        t = Tokens([x or b"" for x in texts], ALNUM)
        h, size = np.unique(t.hash).view(np.int64), np.unique(np.minimum(np.diff(t.bounds), 1 << 16))
        yield pa.record_batch([pa.array(np.repeat([0, 1], [len(h), len(size)]), pa.int32()), pa.array(np.concatenate((h, size)))], names=["kind", "x"])


def _build(vocabulary, words):
    def build(key, group):
        items = sorted(zip(group.column("i").to_pylist(), group.column("t").to_pylist(), strict=True), key=lambda x: (x[0] is None, x))
        return pa.table({"windows": pa.array([pickle.dumps(Windows(items, vocabulary.value, words))], pa.binary())})

    return build


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """docs' `keep` columns (default: all) with n_words, spans and items.

    spans: maximal runs of hit words as UTF-8 byte offsets [start, stop) of the text and word numbers [first_word,
    last_word). items: sorted ids, as strings, of the items with occurring windows (null ids name nothing, but their
    windows count). Null texts have no words; an empty benchmark hits nothing. Documents aren't shuffled: each task
    indexes shards of its own rows, and searches each index for all windows. Workers make the windows, in blocks of about
    ITEM_BLOCK_BYTES of items that are broadcast; the benchmark's distinct words (8 bytes each) are broadcast as a whole.
    Columns n_words, spans and items that docs has are replaced.
    """
    context = docs.sparkSession.sparkContext
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items")] if keep is None else keep
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"))
    found = items.mapInArrow(_vocabulary, "kind int, x long").distinct().collect()
    sizes = [min(r["x"], words) for r in found if r["kind"] == 1 and r["x"]]
    vocabulary = context.broadcast(np.sort(np.array([r["x"] for r in found if r["kind"] == 0], np.int64).view(np.uint64)))
    blocks = max(1, -(-items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] // ITEM_BLOCK_BYTES))
    built = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).groupBy("block").applyInArrow(_build(vocabulary, words), "windows binary")
    windows = [context.broadcast(pickle.loads(r["windows"])) for r in built.toLocalIterator()]
    symbols = context.broadcast(Symbols(vocabulary.value, min(sizes, default=0)))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(lambda batches: _find(batches, text, keep, symbols.value, windows), f"{schema}, {FOUND}")


def strip_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (with find_contamination's columns) with the hit words cut from the texts; spans, items and n_words are dropped.

    What remains on either side is joined by one space. Texts without spans are unchanged.
    """

    def cut(batches):
        for batch in batches:
            at, sp = batch.schema.get_field_index(text), batch.schema.get_field_index("spans")
            out = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(sp).to_pylist(), strict=True):
                if spans:
                    b, parts, last = t.encode(), [], 0
                    for s in spans:
                        parts.append(b[last : s["start"]])
                        last = s["stop"]
                    t = b" ".join(x.strip() for x in [*parts, b[last:]]).strip().decode()
                out.append(t)
            keep = [k for k, n in enumerate(batch.schema.names) if n not in ("n_words", "spans", "items")]
            yield pa.record_batch([pa.array(out, pa.string()) if k == at else batch.column(k) for k in keep], names=[batch.schema.names[k] for k in keep])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("n_words", "spans", "items"))
    return docs.mapInArrow(cut, schema)


def digest_items(ids) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


__all__ = ["FMIndex", "Symbols", "WaveletTree", "Windows", "digest_items", "find_contamination", "index_words", "merge_spans", "occurrences", "strip_spans", "suffix_array"]
