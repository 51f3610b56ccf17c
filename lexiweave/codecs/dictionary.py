"""Dictionary codecs, from the published descriptions: static symbol tables and pair merging.

Both encode each string alone, by greedy longest match, so any string can be decoded alone. Whole Arrow arrays of
strings are encoded and decoded in numpy.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa

ESCAPE = 255
SYMBOLS, SYMBOL_BYTES, GENERATIONS, SAMPLE_BYTES = 255, 8, 5, 16 * 1024
TOKEN_BYTES, TOKEN_BITS, PAIR_COUNT, TRAIN_BYTES = 16, 16, 3, 1 << 20
WINDOW, SEGMENT = 1 << 22, 128  # bytes that are parsed at once, in segments side by side


def parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an array of binary values without nulls."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    held = array.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


class Matcher:
    """Longest known string at every place: a trie whose edges (node, byte) lie in an open hash table."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, known: list[bytes]):
        edges: dict[int, int] = {}
        codes = [-1]
        for code, s in enumerate(known):
            at = 0
            for b in s:
                key = at << 8 | b
                at = edges.get(key, -1)
                if at < 0:
                    at = edges[key] = len(codes)
                    codes.append(-1)
            codes[at] = code
        self.codes = np.array(codes, np.int32)  # code of the string that ends at a node
        self.longest = max(map(len, known), default=0)
        self.deeper = np.zeros(len(codes), bool)  # nodes that have children
        self.deeper[[k >> 8 for k in edges]] = True
        bits = max(4, (2 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        for key, node, slot in zip(keys.tolist(), edges.values(), self._slot(keys).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.nodes[slot] = key, node
        # The first two steps, from every byte and every two bytes, as plain tables.
        root = np.array([edges.get(b, 0) for b in range(256)], np.int32)
        self.single = np.where(root > 0, self.codes[root], -1).astype(np.int32)
        self.second = np.zeros(1 << 16, np.int32)
        for b in range(256):
            if root[b]:
                self.second[b << 8 : b + 1 << 8] = [edges.get(int(root[b]) << 8 | c, 0) for c in range(256)]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.MIX >> self.shift).astype(np.int64)

    def _children(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Child of each node by its byte, 0 for none."""
        keys = nodes.astype(np.int64) << 8 | data
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.nodes[slot], 0)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.nodes[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _matches(self, data: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code (-1 for none) and length (1 for none) of the longest match at each place; a match is no longer than the place's room. One byte more than the room must be there."""
        first = data[at]
        code, size = self.single[first], np.ones(len(at), np.int64)
        nodes = self.second[first.astype(np.int32) << 8 | data[at + 1]]
        live = np.flatnonzero((nodes > 0) & (room > 1))
        nodes, depth = nodes[live], 2
        while len(live):
            ends = self.codes[nodes]
            hit = ends >= 0
            code[live[hit]], size[live[hit]] = ends[hit], depth
            if depth >= self.longest:
                break
            on = (room[live] > depth) & self.deeper[nodes]
            live, nodes = live[on], nodes[on]
            nodes = self._children(nodes, data[at[live] + depth])
            live, nodes = live[nodes > 0], nodes[nodes > 0]
            depth += 1
        return code, size

    def tokens(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches of the strings that data holds between ends: places, codes (-1: an unknown byte), and how many come before each end."""
        places, codes, at = [], [], 0
        while at < len(data):
            stop = min(at + WINDOW, len(data))
            own, found, at = self._window(data, ends, at, stop)
            places.append(own)
            codes.append(found)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        places = np.concatenate(places)
        return places, np.concatenate(codes), np.searchsorted(places, ends)

    def _window(self, data: np.ndarray, ends: np.ndarray, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens that begin in [begin, stop), and where the next one does; a token begins at `begin`.

        Segments are parsed side by side, each from its start as if a token began there. From its end a segment goes on
        until it comes to a place where the parse of a later one has a token too: from there on both agree. So the parse
        is the first segment's, then from each such place the one's that owns it; what segments have before is dropped.
        """
        far = min(stop + self.longest, len(data))
        text = np.append(data[begin:far], np.uint8(0))
        n = stop - begin
        inner = ends[np.searchsorted(ends, begin, side="right") : np.searchsorted(ends, far, side="left") + 1] - begin
        starts = np.unique(np.concatenate((np.arange(0, n, SEGMENT), inner[inner < n])))
        limit = np.minimum(inner[np.searchsorted(inner, starts, side="right")], far - begin)  # the end of the string
        border = np.append(starts[1:], n)
        mark = np.zeros(len(text) + 1, bool)
        exits = starts.copy()

        def parse(who, until):
            """Steps of the segments `who` from their exits on, until(places, segments) says stop."""
            steps, at = [], exits[who]
            while len(who):
                code, size = self._matches(text, at, limit[who] - at)
                steps.append((at, code, who))
                at = at + size
                on = ~until(at, who)
                exits[who[~on]] = at[~on]
                at, who = at[on], who[on]
            return [np.concatenate(x) for x in zip(*steps, strict=True)] if steps else None

        own = parse(np.arange(len(starts)), lambda at, who: at >= border[who])
        mark[own[0]] = True
        mark[n:] = True
        over = parse(np.flatnonzero(~mark[exits]), lambda at, who: mark[at] | (at >= limit[who]))
        # A string's end is the start of the next one's first segment.
        owner = np.searchsorted(starts, exits, side="right") - 1
        since = np.full(len(starts), n + self.longest + 1)
        since[0] = 0
        leave, after, following = since.tolist(), exits.tolist(), owner.tolist()
        last = 0
        for j in range(len(leave)):
            if leave[j] <= n:
                last = after[j]
                if last < n:
                    leave[following[j]] = last
        since = np.array(leave)
        keep = own[0] >= since[own[2]]
        places, codes = own[0][keep], own[1][keep]
        if over is not None:
            keep = since[over[2]] <= n
            places, codes = np.append(places, over[0][keep]), np.append(codes, over[1][keep])
        order = np.argsort(places)
        return places[order] + begin, codes[order], begin + last


def spell(strings: list[bytes], codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings that codes stand for, joined and cut into values of the given sizes."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(length) - length
    flat = np.frombuffer(b"".join(strings), np.uint8)
    took = length[codes]
    total = int(took.sum())
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if total != ends[-1]:
        raise ValueError("a payload doesn't give the size that is stored with it")
    return binary(flat[np.repeat(begin[codes] - (np.cumsum(took) - took), took) + np.arange(total)], ends)


class SymbolTable:
    """Up to 255 symbols of 1 to 8 bytes with one-byte codes; code 255 is followed by one literal byte."""

    def __init__(self, symbols: list[bytes]):
        self.symbols = symbols

    @cached_property
    def matcher(self) -> Matcher:
        return Matcher(self.symbols)

    def __getstate__(self):
        return {"symbols": self.symbols}  # workers build the rest

    @classmethod
    def train(cls, sample: list[bytes]) -> SymbolTable:
        """A few generations: encode the sample, then keep the symbols and joined pairs of symbols that cover most bytes."""
        kept, size = [], 0
        for s in sample:
            if size >= SAMPLE_BYTES:
                break
            kept.append(s[: SAMPLE_BYTES - size])
            size += len(kept[-1])
        data, ends = parts(pa.array(kept, pa.binary()))
        text, borders = data.tobytes(), set(ends.tolist())
        table = cls([])
        for _ in range(GENERATIONS):
            gain: Counter = Counter()
            places = table.matcher.tokens(data, ends)[0].tolist()
            before = b""
            for at, to in pairwise([*places, len(text)]):
                now = text[at:to]
                gain[now] += len(now)
                if before and at not in borders and len(before) + len(now) <= SYMBOL_BYTES:
                    gain[before + now] += len(before) + len(now)
                before = now
            table = cls(sorted(gain, key=lambda x: (-gain[x], x))[:SYMBOLS])
        return table

    def encode_all(self, values: pa.Array) -> pa.Array:
        """Codes of all values; an unknown byte follows an escape."""
        data, ends = parts(values)
        places, codes, before = self.matcher.tokens(data, ends)
        literal = codes < 0
        at = np.arange(len(codes)) + np.cumsum(literal) - literal  # where each code goes
        out = np.empty(len(codes) + int(literal.sum()), np.uint8)
        out[at] = np.where(literal, ESCAPE, codes)
        out[at[literal] + 1] = data[places[literal]]
        return binary(out, np.append(at, len(out))[before])

    def decode_all(self, codes: pa.Array, sizes: np.ndarray) -> pa.Array:
        """Values of all codes, whose sizes are known. In a run of escapes every second one is a literal."""
        data, _ = parts(codes)
        marks = data == ESCAPE
        place = np.arange(len(data))
        since = place - np.maximum.accumulate(np.where(marks, -1, place)) if len(data) else place  # place in the run, from 1
        escape = marks & (since % 2 == 1)
        literal = np.append(False, escape[:-1]) if len(data) else escape
        strings = [*self.symbols, *(bytes([b]) for b in range(256))]
        ids = np.where(literal, data.astype(np.int64) + len(self.symbols), data)[~escape]
        return spell(strings, ids, sizes)

    def encode(self, data: bytes) -> bytes:
        return self.encode_all(pa.array([data], pa.binary()))[0].as_py()

    def decode(self, code: bytes) -> bytes:
        out, i, symbols = [], 0, self.symbols
        while (k := code.find(ESCAPE, i)) >= 0:
            out += [symbols[c] for c in code[i:k]]
            out.append(code[k + 1 : k + 2])
            i = k + 2
        out += [symbols[c] for c in code[i:]]
        return b"".join(out)

    #: Size of the table as the reported space counts it: a length and eight bytes for each possible symbol.
    DICT_BYTES = SYMBOLS * (1 + SYMBOL_BYTES)


@dataclass(frozen=True)
class PairConfig:
    """How tokens are found: 2**bits of them at most (9 to 16 bits), and how often a pair must be seen.

    dynamic: null for a fixed `count`. Else the share of the sample over which the tokens should be used up: the count
    needed goes up while they are taken faster than that, and down (not below 2) while slower.
    """

    bits: int = TOKEN_BITS
    count: int = PAIR_COUNT
    dynamic: float | None = None

    def __post_init__(self):
        if not 9 <= self.bits <= 16 or self.count < 1 or self.dynamic is not None and not 0 < self.dynamic <= 1:
            raise ValueError("bits must be 9 to 16, count at least 1, dynamic above 0 and at most 1")


class PairTokens:
    """Up to 2**16 tokens of 1 to 16 bytes with two-byte codes; all single bytes are tokens, so nothing needs an escape."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens

    @cached_property
    def matcher(self) -> Matcher:
        return Matcher(self.tokens)

    def __getstate__(self):
        return {"tokens": self.tokens}  # workers build the rest

    @classmethod
    def train(cls, sample: list[bytes], config: PairConfig = PairConfig()) -> PairTokens:  # noqa: B008
        """One pass over the sample: greedy longest match; a pair of neighbours seen often enough becomes a token at once."""
        tokens = [bytes([b]) for b in range(256)]
        codes = {t: i for i, t in enumerate(tokens)}
        lengths: dict[bytes, list[int]] = {}
        pairs: Counter = Counter()
        capacity, count, size = 1 << config.bits, config.count, 0
        budget = min(TRAIN_BYTES, sum(map(len, sample)))
        for s in sample:
            if len(tokens) >= capacity or size >= TRAIN_BYTES:
                break
            if config.dynamic is not None and size:
                ahead = (len(tokens) - 256) / (capacity - 256) - size / (config.dynamic * budget)
                count = max(2, count + (1 if ahead > 0 else -1))
            s = s[: TRAIN_BYTES - size]
            size += len(s)
            i, before = 0, None
            while i < len(s):
                m = next((m for m in lengths.get(s[i : i + 2], ()) if s[i : i + m] in codes and i + m <= len(s)), 1)
                now = s[i : i + m]
                i += m
                if before is not None and len(before) + m <= TOKEN_BYTES:
                    joined = before + now
                    if joined not in codes:
                        pairs[joined] += 1
                        if pairs[joined] >= count and len(tokens) < capacity:
                            del pairs[joined]
                            codes[joined] = len(tokens)
                            tokens.append(joined)
                            own = lengths.setdefault(joined[:2], [])
                            if len(joined) not in own:
                                own.append(len(joined))
                                own.sort(reverse=True)
                before = now
        return cls(tokens)

    def encode_all(self, values: pa.Array) -> pa.Array:
        data, ends = parts(values)
        _, codes, before = self.matcher.tokens(data, ends)
        return binary(codes.astype("<u2").view(np.uint8), 2 * before)

    def decode_all(self, codes: pa.Array, sizes: np.ndarray) -> pa.Array:
        """Values of all codes, whose sizes are known."""
        data, _ = parts(codes)
        return spell(self.tokens, np.frombuffer(data.tobytes(), "<u2"), sizes)

    def encode(self, data: bytes) -> bytes:
        return self.encode_all(pa.array([data], pa.binary()))[0].as_py()

    def decode(self, code: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(code, "<u2").tolist()))

    @property
    def dict_bytes(self) -> int:
        return sum(map(len, self.tokens)) + 2 * len(self.tokens)
