"""N-gram Jaccard join: which documents' shingle sets have a Jaccard similarity of 0.8 or more.

Equal sets are one *class*. Random documents are all at distance 1 from each other, where pivots can't tell them apart;
so the join has an outer and an inner division.

1. Which classes could be linked at all. Every class orders its shingles the same way, rarest first, and goes to the regions
   of its first n - ceil(0.8 n) + 1 shingles: two sets that close share one of these. In a region, pairs stay
   whose set sizes, places of the shingle in their orders and 256-bit parity bitmaps (Hamming distance bounds the
   symmetric difference from below) allow a link, and then those whose parities in n to 2n bits do. Where more than DENSE
   pairs a class would stay, links that connect the same classes stand for them. Regions of HOT classes and more aren't gathered: all of
   their classes are linked with the region itself. Components of what stays are the *candidate groups*.
2. Within a candidate group the sets themselves are joined by distance. Pivots create Voronoi regions: a class
   belongs to its nearest pivot p, or to the outer region if that is farther than FAR; it is replicated to every
   region where by the triangle inequality a partner within 0.2 may belong: to pivot q if d(x, q) - d(x, p) <= 0.4 and d(x, q) <= FAR + 0.2, to the outer
   region if d(x, p) >= FAR - 0.2. Regions are joined recursively, until few members are left, which are compared outright. Members that are known to be in one component need no comparison. A group above GROUP
   shingles is divided the same way by rows of a table, with pivots of each region joined to its members; a
   region that division can't shrink is compared block by block.

Components are the result. Shingles are known by 64 bits of hash, sets by 128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import SPACED, U64, Tokens, chunked, grouped, mix, ngrams, release, unique_counts
from .components import components, forest
from .filters import BLOB_SCHEMA, build_filter, count_blobs, frequent_keys
from .shared import shards_for, stored

WORDS = 5
PERCENT = 80  # similarity
COMMON = 1 << 17  # shingles (16 bytes each) that the shared order puts last
COMMON_IN_CHUNK, COMMON_AT_ALL = 3, 12
HOT = 4_096  # classes from which a region isn't gathered
PAIRS = 1 << 18  # pairs of a region that are looked at together
DENSE = 32  # pairs a class that a region gives at most, one by one
GROUP = 1 << 22  # shingles (32 MB) of a candidate group that one task joins
LEAF, PIVOTS = 12, 6  # members compared outright, and pivots of a Voronoi division
FAR = 0.5
ROUNDS = 6  # divisions of a group above GROUP before its regions are compared in blocks
SEEN = 1 << 18  # classes of a task that aren't sent twice
SIGNS = ["s0", "s1", "s2", "s3"]  # 64 bits each of a set's parities in 256 bits


class Sets:
    """Shingle sets of a chunk's texts: sorted distinct hashes values[cuts[d]:cuts[d+1]], and two hashes of each set."""

    def __init__(self, texts: list[bytes], words: int = WORDS):
        t = Tokens([x or b"" for x in texts], SPACED)
        grams = ngrams(t.hash, words)
        out = []
        for a, b in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True):
            if b - a >= words:
                g = np.sort(grams[a : b - words + 1])
                out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
            else:
                out.append(ngrams(t.hash[a:b], b - a) if b > a else np.empty(0, U64))
        self.size = np.fromiter(map(len, out), np.int64, len(out))
        self.cuts = np.concatenate(([0], np.cumsum(self.size)))
        self.values = np.concatenate(out) if out else np.empty(0, U64)
        full = self.size > 0
        self.k1, self.k2 = np.zeros(len(out), U64), np.zeros(len(out), U64)
        if full.any():
            at = self.cuts[:-1][full]
            self.k1[full] = np.add.reduceat(mix(self.values ^ U64(0x1F83D9ABFB41BD6B)), at)
            self.k2[full] = np.add.reduceat(mix(self.values + U64(0x5BE0CD19137E2179)), at)

    def distinct(self) -> np.ndarray:
        """The first document of each non-empty set."""
        _, first = np.unique(np.stack((self.k1, self.k2)), axis=1, return_index=True)
        return np.sort(first[self.size[first] > 0])


def prefixes(s: Sets, which: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, documents, places): of each chosen set the shingles that a set as similar as `percent` must share one of, with their places in the common order."""
    order = s.values >> U64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, s.values), len(common) - 1)
        order[common[at] == s.values] |= U64(1 << 63)
    out = []
    for d in which.tolist():
        a, b = int(s.cuts[d]), int(s.cuts[d + 1])
        n = b - a
        p = n - -(-percent * n // 100) + 1
        own = order[a:b]
        out.append(s.values[a:b][np.argsort(own)[:p]])
    size = [len(x) for x in out]
    place = np.concatenate([np.arange(x) for x in size]) if out else np.empty(0, np.int64)
    return (np.concatenate(out) if out else np.empty(0, U64)), np.repeat(which, size), place


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _profiles(batches, words):
    """kind 0: id, n, class and parities of each document; kind 1: shingles frequent in a chunk, with counts."""
    for rows, texts in chunked(batches, "t"):
        s = Sets(texts, words)
        n = len(texts)
        own = s.distinct()
        values = np.concatenate([s.values[s.cuts[d] : s.cuts[d + 1]] for d in own.tolist()]) if len(own) else s.values
        k, c = unique_counts(values)
        k, c = k[c >= COMMON_IN_CHUNK], c[c >= COMMON_IN_CHUNK]
        names = ["kind", "id", "n", "k1", "k2", "parity"]
        bits = [parity(s.values[a:b]) for a, b in zip(s.cuts[:-1].tolist(), s.cuts[1:].tolist(), strict=True)]
        yield pa.record_batch([pa.array(np.zeros(n, np.int32)), rows.column(rows.schema.get_field_index("id")), pa.array(s.size), _signed(s.k1), _signed(s.k2), pa.array(bits, pa.binary())], names=names)
        if len(k):
            yield pa.record_batch([pa.array(np.ones(len(k), np.int32)), pa.nulls(len(k), pa.int64()), pa.array(c.astype(np.int64)), _signed(k), pa.array(np.zeros(len(k), np.int64)), pa.nulls(len(k), pa.binary())], names=names)


def _prefix_pieces(batches, words, common, percent):
    for _, texts in chunked(batches, "t"):
        s = Sets(texts, words)
        yield prefixes(s, s.distinct(), common, percent)[0]


# candidate groups


def signatures(s: Sets, which: np.ndarray) -> np.ndarray:
    """Parities of the chosen sets in 256 bits, as rows of four integers: their Hamming distance bounds the symmetric difference from below."""
    width = 64 * len(SIGNS)
    odd = np.zeros((len(which), width), bool)
    for k, d in enumerate(which.tolist()):
        odd[k] = np.bincount((s.values[s.cuts[d] : s.cuts[d + 1]] & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def parity(values: np.ndarray) -> bytes:
    """How often each low part of a hash occurs, odd or even, in n to 2n bits (64 at least)."""
    size = max(64, 1 << len(values).bit_length())
    odd = np.bincount((values & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound on the symmetric difference of two sets, from their parities; the longer one is folded."""
    if len(x) > len(y):
        x, y = y, x
    v, bits = int.from_bytes(y, "little"), 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        v = (v >> bits) ^ (v & ((1 << bits) - 1))
    return (v ^ int.from_bytes(x, "little")).bit_count()


def _passing(batches, percent):
    """(u, v) of rows (u, v, nu, pu, nv, pv) whose parities allow a link."""
    for batch in batches:
        ok = [(100 + percent) * least_difference(x, y) <= (100 - percent) * (m + n) for m, x, n, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


REGIONS = "h long, node long, n int, at int, s0 long, s1 long, s2 long, s3 long"  # at -1: node belongs to the hot region s0


def _regions(batches, words, common, percent, maybe, hot):
    """REGIONS rows for prefix shingles that may have more than one class."""
    names = [x.split()[0] for x in REGIONS.split(", ")]
    for _, texts in chunked(batches, "t"):
        s = Sets(texts, words)
        h, doc, place = prefixes(s, s.distinct(), common, percent)
        ok = maybe.has(h)
        h, doc, place = h[ok], doc[ok], place[ok]
        if not len(h):
            continue
        many = hot.has(h)
        own, where = np.unique(doc, return_inverse=True)
        signs = signatures(s, own)[where]
        signs[many, 0] = mix(h[many] ^ U64(0x452821E638D01377)).view(np.int64)
        h = np.where(many, s.k2[doc], h)  # rows of hot regions meet nowhere
        yield pa.record_batch([_signed(h), _signed(s.k1[doc]), pa.array(s.size[doc].astype(np.int32)), pa.array(np.where(many, -1, place).astype(np.int32)), *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(len(SIGNS)))], names=names)


def allowed(n, at, signs, i, j, percent: int) -> np.ndarray:
    """Whether sizes, places of the region's shingle and parities allow rows i and j a link whose first shared shingle it is."""
    m, o = n[i], n[j]
    ok = (100 * np.minimum(m, o) >= percent * np.maximum(m, o)) & ((100 + percent) * np.minimum(m - at[i], o - at[j]) >= percent * (m + o))
    if np.ndim(i):
        i, m = i[ok], m[ok]
    j, o = j[ok], o[ok]
    differ = np.bitwise_count(signs[i] ^ signs[j]).sum(axis=1, dtype=np.int64)
    ok[ok] = (100 + percent) * differ <= (100 - percent) * (m + o)
    return ok


class _Links:
    """Pairs (u, v), each once, and contracted links that stand for denser regions."""

    def __init__(self):
        self.pairs, self.links, self.size = [], [], [0, 0]

    def add(self, sure: bool, u: np.ndarray, v: np.ndarray):
        """Takes the arrays; a record batch when enough is held."""
        held = self.links if sure else self.pairs
        held.append((u, v))
        self.size[sure] += len(u)
        if self.size[sure] > 1 << 20:
            if sure:
                self.links = [forest(*self._flat(held))]
                self.size[1] = len(self.links[0][0])
            else:
                self.pairs = [self._distinct()]
                self.size[0] = len(self.pairs[0][0])
            if self.size[sure] > 1 << 19:
                return self.flush()
        return None

    def _flat(self, held):
        return tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _distinct(self):
        u, v = self._flat(self.pairs)
        return tuple(np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)) if len(u) else (u, v)

    def flush(self) -> pa.RecordBatch:
        (u, v), (x, y) = self._distinct(), forest(*self._flat(self.links))
        sure = np.concatenate((np.zeros(len(u), bool), np.ones(len(x), bool)))
        self.pairs, self.links, self.size = [], [], [0, 0]
        return pa.record_batch([pa.array(np.concatenate((u, x))), pa.array(np.concatenate((v, y))), pa.array(sure)], names=["u", "v", "sure"])


def _sparse(node, n, at, signs, stop, percent):
    """(u, v) arrays of allowed pairs; stop: where each row's region ends."""
    count = stop - np.arange(len(node)) - 1
    ends = np.cumsum(count)
    lo = 0
    while lo < len(node):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        own = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        ok = allowed(n, at, signs, i, j, percent)
        if ok.any():
            yield False, node[i[ok]], node[j[ok]]
        lo = hi


def _dense(node, n, at, signs, percent):
    """As _sparse for one region, as long as there are at most DENSE pairs a class; else links that connect the same classes."""
    pairs, size = [], 0
    for i in range(len(node) - 1):
        j = np.arange(i + 1, len(node))
        j = j[allowed(n, at, signs, i, j, percent)]
        pairs.append((np.full(len(j), node[i]), node[j]))
        size += len(j)
        if size > DENSE * len(node):
            break
    else:
        yield False, *(np.concatenate(x) for x in zip(*pairs, strict=True))
        return
    label = np.arange(len(node))
    for i in range(len(node) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[allowed(n, at, signs, i, j, percent)]
        if len(j):
            yield True, np.full(len(j), node[i]), node[j]
            label[np.isin(label, label[j])] = label[i]


def _candidates(batches, percent):
    """(u, v, sure): pairs of classes that a region allows, and links that stand for dense ones, of REGIONS rows sorted by h and node."""
    links = _Links()

    def take(t):
        columns = [t.column(k).to_numpy() for k in range(t.num_columns)]
        h, node, n, at = columns[0], columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64)
        apart = at < 0
        if apart.any():
            yield True, node[apart], columns[4][apart]
        new = ~apart
        new[1:] &= (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, n, at = h[new], node[new], n[new], at[new]
        signs = np.stack([c[new] for c in columns[4:]], axis=1).view(U64)
        cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        width = np.diff(np.append(cut, len(h)))
        for k in np.flatnonzero(width >= 2 * DENSE).tolist():
            g = slice(cut[k], cut[k] + width[k])
            yield from _dense(node[g], n[g], at[g], signs[g], percent)
        few = np.repeat((width > 1) & (width < 2 * DENSE), width)
        if few.any():
            stop = np.searchsorted(np.flatnonzero(few), np.repeat(cut + width, width)[few])
            yield from _sparse(node[few], n[few], at[few], signs[few], stop, percent)

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        h = t.column(0).to_numpy()
        open_at = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last region may go on
        for found in take(t.slice(0, open_at)) if open_at else ():
            if out := links.add(*found):
                yield out
        rest = t.slice(open_at)
    for found in take(rest) if rest is not None and rest.num_rows else ():
        if out := links.add(*found):
            yield out
    if any(links.size):
        yield links.flush()
    release()


# distances


def _members(batches, words, wanted):
    """(k1, k2, n, members) of classes that may be in a candidate group, once a task as far as SEEN goes."""
    seen: set[tuple[int, int]] = set()
    for _, texts in chunked(batches, "t"):
        s = Sets(texts, words)
        own = s.distinct()
        own = own[wanted.has(mix(s.k1[own]))]
        new = []
        for d in own.tolist():
            k = (int(s.k1[d]), int(s.k2[d]))
            if k not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
                new.append(d)
        if new:
            yield pa.record_batch([_signed(s.k1[new]), _signed(s.k2[new]), pa.array(s.size[new]), pa.array([s.values[s.cuts[d] : s.cuts[d + 1]].tobytes() for d in new], pa.binary())], names=["k1", "k2", "n", "members"])


class Region:
    """Sets to be joined by distance: members' sorted values[cuts[k]:cuts[k+1]]; label[k] is a number that all members linked with k so far share."""

    def __init__(self, values: np.ndarray, size: np.ndarray, percent: int):
        self.values, self.size, self.percent = values, size, percent
        self.cuts = np.concatenate(([0], np.cumsum(size)))
        self.label = np.arange(len(size))

    def of(self, k: int) -> np.ndarray:
        return self.values[self.cuts[k] : self.cuts[k + 1]]

    def shared(self, own: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of `own` with other members' sets."""
        size = self.size[others]
        if len(others) == len(self.size):
            flat = self.values
        else:
            flat = np.concatenate([self.of(k) for k in others.tolist()])
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        return np.add.reduceat(own[at] == flat, np.cumsum(size) - size, dtype=np.int64)

    def link(self, k: int, others: np.ndarray, both: np.ndarray) -> None:
        either = self.size[k] + self.size[others] - both
        near = self.label[others[100 * both >= self.percent * either]]
        if len(near):
            near = np.append(near, self.label[k])
            self.label[np.isin(self.label, near)] = near.min()

    def compare(self, own: np.ndarray, region: np.ndarray) -> None:
        """Every member of `own` with all of the region that aren't linked with it yet and whose sizes allow a link."""
        for k in own.tolist():
            m, o = self.size[k], self.size[region]
            others = region[(self.label[region] != self.label[k]) & (100 * np.minimum(m, o) >= self.percent * np.maximum(m, o))]
            if len(others):
                self.link(k, others, self.shared(self.of(k), others))

    def join(self) -> None:
        """Link all members that are near enough."""
        every = np.arange(len(self.size))
        todo = [(every, every)]  # members of the first are to meet all of the second, which holds them
        while todo:
            own, region = todo.pop()
            if len(own) == 0 or (self.label[region] == self.label[region[0]]).all():
                continue
            if len(region) <= LEAF:
                self.compare(own, region)
                continue
            pivots = own[np.unique(np.linspace(0, len(own) - 1, PIVOTS).astype(int))]
            distance = np.empty((len(pivots), len(region)))
            for row, p in enumerate(pivots.tolist()):
                both = self.shared(self.of(p), region)
                distance[row] = 1 - both / (self.size[p] + self.size[region] - both)
                self.link(p, region, both)
            best, nearest = distance.min(axis=0), distance.argmin(axis=0)
            mine = np.isin(region, own) & ~np.isin(region, pivots)  # pivots have met the whole region
            cells = [(mine & (nearest == row) & (best <= FAR), near(distance[row], best, self.percent)) for row in range(len(pivots))]
            for home, cell in [*cells, (mine & (best > FAR), outer(best, self.percent))]:
                if 4 * cell.sum() > 3 * len(region):
                    self.compare(region[home], region[cell])
                else:
                    todo.append((region[home], region[cell]))


def near(distance, best, percent: int):
    """Whether a member at this distance from a pivot, and `best` from its nearest, may have a partner that belongs to the pivot."""
    radius = (100 - percent) / 100
    return (distance - best <= 2 * radius + 1e-9) & (distance <= FAR + radius + 1e-9)


def outer(best, percent: int):
    """Whether a member at distance `best` from its nearest pivot may have a partner that belongs to none."""
    return best >= FAR - (100 - percent) / 100 - 1e-9


def _joined(batches, percent):
    """(c, root) for rows (group, c, n, members) sorted by group: the smallest c that links within the group reach."""
    c_out, root_out, held = [], [], 0
    for _, t in grouped(batches):
        c = t.column(1).to_numpy()
        if len(c) > 1:
            c, first = np.unique(c, return_index=True)
            blobs = t.column(3).to_pylist()
            region = Region(np.frombuffer(b"".join(blobs[k] for k in first.tolist()), U64), t.column(2).to_numpy()[first], percent)
            region.join()
            moved = region.label != np.arange(len(c))
            c_out.append(c[moved])
            root_out.append(c[region.label[moved]])
            held += int(moved.sum())
        if held > 1 << 16:
            yield pa.record_batch([pa.array(np.concatenate(c_out)), pa.array(np.concatenate(root_out))], names=["c", "root"])
            c_out, root_out, held = [], [], 0
    if held:
        yield pa.record_batch([pa.array(np.concatenate(c_out)), pa.array(np.concatenate(root_out))], names=["c", "root"])


def _in_groups(rows: DataFrame, percent: int) -> DataFrame:
    """(c, root) links within every group of rows (group, c, n, members)."""
    return rows.select("group", "c", "n", "members").repartition("group").sortWithinPartitions("group").mapInArrow(lambda b: _joined(b, percent), "c long, root long")


DIVIDED = "kind int, group long, c long, n long, ball long, members binary"  # kind 0: c is in this region; 1: c is linked with ball


def _divide(batches, percent, round_):
    """DIVIDED rows for rows (group, c, n, ball, members, pivots: array of (c, n, members))."""
    names = [x.split()[0] for x in DIVIDED.split(", ")]
    for batch in batches:
        group, c, n, ball = (batch.column(k).to_pylist() for k in range(4))
        out, held = [], 0
        for k in range(batch.num_rows):
            own = np.frombuffer(batch.column(4)[k].as_py(), U64)
            pivots = {p["c"]: np.frombuffer(p["members"], U64) for p in batch.column(5)[k].as_py()}
            both = {p: int((own[np.minimum(np.searchsorted(own, v), len(own) - 1)] == v).sum()) for p, v in pivots.items()}
            distance = {p: 1 - m / (len(own) + len(pivots[p]) - m) for p, m in both.items()}
            linked = [p for p, m in both.items() if 100 * m >= percent * (len(own) + len(pivots[p]) - m)]
            out += [(1, None, c[k], None, p, None) for p in linked if p != c[k]]
            best = min(distance.values())
            for p in [*(p for p, d in distance.items() if near(d, best, percent)), *([-1] if outer(best, percent) else ())]:
                region = int(mix(np.array([(group[k] + p * 0x9E3779B97F4A7C15 + round_) & (1 << 64) - 1], U64)).view(np.int64)[0])
                out.append((0, region, c[k], n[k], min(linked, default=ball[k]), own.tobytes()))
                held += own.nbytes
            if held > 8 << 20:
                yield _rows(out, names)
                out, held = [], 0
        if out:
            yield _rows(out, names)


def _rows(out, names):
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary()]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _join_large(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v) links whose components are those of each group's, for groups (group, c, n, members) of any size."""
    rows, links = rows.withColumn("ball", F.lit(None).cast("long")), None
    for round_ in range(1, ROUNDS + 1):
        open_ = (F.count("ball") < F.count("*")) | (F.min("ball") < F.max("ball"))  # else all are linked with one pivot
        sizes = stored(rows.groupBy("group").agg(F.sum("n").alias("weight"), open_.alias("open")).where("open"), "sizes")
        near = _in_groups(rows.join(sizes.where(F.col("weight") <= GROUP).select("group"), "group", "left_semi"), percent).toDF("u", "v")
        links = near if links is None else links.unionByName(near)
        large = sizes.where(F.col("weight") > GROUP)
        if large.isEmpty():
            return links
        rows = rows.join(large.select("group", "weight"), "group")
        if round_ == ROUNDS:
            break
        first = lambda j: F.min_by(F.struct("c", "members"), F.struct(F.col("ball").isNotNull(), F.xxhash64("c", F.lit(round_), F.lit(j))))
        pivots = rows.groupBy("group").agg(F.array_distinct(F.array(*(first(j) for j in range(PIVOTS)))).alias("pivots"))
        rows = stored(rows.join(pivots, "group").select("group", "c", "n", "ball", "members", "pivots").mapInArrow(lambda b, r=round_: _divide(b, percent, r), DIVIDED), "divided")
        links = links.unionByName(rows.where("kind = 1").select(F.col("c").alias("u"), F.col("ball").alias("v")))
        rows = rows.where("kind = 0").drop("kind")
    blocks = F.ceil(2 * F.col("weight") / GROUP) + 1
    mine = F.pmod(F.xxhash64("c", F.lit("block")), F.col("blocks"))
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("group", F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")))
    return links.unionByName(_in_groups(rows, percent).toDF("u", "v"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words than `words` is one shingle
    as a whole; null texts and texts without words have none and are linked with nothing: their component is themselves.
    component_id is the smallest id that links reach, null where none of a component's rows has an id. Ids are
    64-bit integers; repeated rows are linked with each other. Other columns don't matter, whatever their names.
    """
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    shards = shards_for(source)
    profiles = stored(source.mapInArrow(lambda batches: _profiles(batches, words), "kind int, id long, n long, k1 long, k2 long, parity binary"), "profiles")
    rows = profiles.where("kind = 0").select("id", "n", "k1", "k2")
    frequent = profiles.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_AT_ALL).orderBy(F.desc("n"), "k1").limit(COMMON)
    common = context.broadcast(np.sort(np.array([r[0] for r in frequent.select("k1").collect()], np.int64).view(U64)))
    counts = source.mapInArrow(lambda batches: count_blobs(_prefix_pieces(batches, words, common.value, percent), shards), BLOB_SCHEMA)
    maybe, hot = (context.broadcast(build_filter(t, shards)) for t in frequent_keys(counts, (2, HOT), "prefixes"))
    found = source.mapInArrow(lambda batches: _regions(batches, words, common.value, percent, maybe.value, hot.value), REGIONS)
    pairs = stored(found.repartition("h").sortWithinPartitions("h", "node").mapInArrow(lambda b: _candidates(b, percent), "u long, v long, sure boolean"), "pairs")
    signs = profiles.where("kind = 0 and n > 0").groupBy("k1").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    side = lambda x: signs.select(F.col("k1").alias(x), F.col("n").alias("n" + x), F.col("parity").alias("p" + x))
    tested = pairs.where("not sure").select("u", "v").distinct().join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "pu", "nv", "pv")
    groups = components(tested.mapInArrow(lambda b: _passing(b, percent), "u long, v long").union(pairs.where("sure").select("u", "v")))
    for b in (common, maybe, hot):
        b.destroy()

    nodes = groups.mapInArrow(lambda b: count_blobs((mix(x.column(0).to_numpy().view(U64)) for x in b), shards), BLOB_SCHEMA)
    wanted = context.broadcast(build_filter(frequent_keys(nodes, (1,), "nodes")[0], shards))
    sets = source.mapInArrow(lambda batches: _members(batches, words, wanted.value), "k1 long, k2 long, n long, members binary")
    sets = sets.join(groups, F.col("k1") == F.col("node")).groupBy("k1", "k2", F.col("component").alias("group")).agg(F.first("n").alias("n"), F.first("members").alias("members"))
    sets = stored(sets.withColumn("c", F.monotonically_increasing_id()), "sets")
    wanted.destroy()
    large = stored(sets.groupBy("group").agg(F.sum("n").alias("weight"), F.count("*").alias("m")).where((F.col("weight") > GROUP) & (F.col("m") > 1)).select("group"), "large")
    if large.isEmpty():
        roots = _in_groups(sets, percent)
    else:
        links = _join_large(sets.join(large, "group", "left_semi").select("group", "c", "n", "members"), percent)
        roots = _in_groups(sets.join(large, "group", "left_anti"), percent).union(components(links).where("node <> component"))
    roots = stored(roots, "roots")

    numbered = sets.select("k1", "k2", "c").join(roots.select("c", "root").union(roots.select(F.col("root").alias("c"), "root").distinct()), "c")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("low")).join(numbered.select("k1", "k2", "root"), ["k1", "k2"], "left")
    classes = stored(classes, "classes")
    lowest = classes.where("root is not null").groupBy("root").agg(F.min("low").alias("lowest"))
    named = classes.where("root is not null").join(lowest, "root").select("k1", "k2", F.col("lowest").alias("component"))
    named = named.union(classes.where("root is null").select("k1", "k2", "low"))
    with_words = rows.where("n > 0").join(stored(named, "named"), ["k1", "k2"]).select("id", "n", "component")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return with_words.union(empty).toDF(id_column, "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the document with the smallest id stays, repeated rows once, and every document without words or id."""
    found = jaccard_components(docs, id_column, text)
    gone = stored(found.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("gone")).distinct(), "gone")
    kept = docs.join(gone, F.col(id_column) == F.col("gone"), "left_anti")
    return kept.dropDuplicates([id_column, text])


__all__ = ["Region", "Sets", "jaccard_components", "one_of_each", "prefixes"]
