"""Vectorised byte-level kernels shared by the text operators.

Every kernel works on a *chunk*: a few megabytes of whole texts laid end to end in
one numpy buffer. Token and n-gram identities are 64-bit hashes, computed without
a Python object for each token. Tokens are laid out in blocks, so that a very long
text costs a few bytes a byte.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 3 << 19

#: Words are what is not ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words are ASCII letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
LONG_TOKEN = 512  # bytes from which a token is hashed by itself
TOKEN_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        size = -(-max(n, 1) // (1 << 18)) << 18
        for name, base in (("p", _BASE), ("q", _BASE_INV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] = sum of byte values times powers of the base over buf[i:j]. Some strings of 1,024 bytes and more collide."""
    s = np.empty(len(buf) + 1, U64)
    s[0] = 0
    v = _BYTE[buf]
    v *= powers(len(buf))[0]
    np.cumsum(v, out=s[1:])
    return s


PIECE = 256  # bytes: strings up to here don't collide by the algebra of prefix_hash


def _piece_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = s[end] - s[start]
    h *= powers(len(s))[1][start]
    h += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between start and end, from prefix_hash()'s sums; long strings piece by piece."""
    h = _piece_hash(s, start, np.minimum(end, start + PIECE))
    at, k = np.flatnonzero(end - start > PIECE), PIECE
    while len(at):
        h[at] = mix(h[at] * U64(0xA0761D6478BD642F) + _piece_hash(s, start[at] + k, np.minimum(end[at], start[at] + k + PIECE)))
        k += PIECE
        at = at[(end - start)[at] > k]
    return h


def token_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end]: eight bytes a step, each mixed with all before, so that no arithmetic relation between strings survives; long tokens by BLAKE2."""
    size = end - start
    words = np.ndarray(len(buf) + 1, "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    h = mix((size.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93))
    h = mix(h ^ (words[start] & _TAIL[np.minimum(size, 8)]))
    at, k = np.flatnonzero((size > 8) & (size < LONG_TOKEN)), 8
    while len(at):
        h[at] = mix(h[at] ^ (words[start[at] + k] & _TAIL[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size >= LONG_TOKEN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


class Tokens:
    """Tokens of a chunk: byte starts and ends in `buf`, hashes (A-Z as a-z), and for document d its tokens bounds[d]:bounds[d+1]."""

    def __init__(self, texts: list[bytes], word: np.ndarray, block: int = TOKEN_BLOCK):
        self.buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        n, lo, parts = len(self.buf), 0, []
        while lo < n - 1:  # a block begins and ends at a byte outside words
            hi = min(lo + block, n - 1)
            while word[self.buf[hi]]:
                ahead = np.flatnonzero(~word[self.buf[hi : hi + block]])
                hi = min(hi + (int(ahead[0]) if len(ahead) else block), n - 1)
            piece = _FOLD[self.buf[lo : hi + 1]]
            inside = word[piece]
            edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
            start, end = edges[0::2], edges[1::2]
            parts.append((start + lo, end + lo, token_hash(piece, start, end)))
            lo = hi
        self.start, self.end, self.hash = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate(([1], 1 + np.cumsum(size + 1)))  # where texts start; one past the end for the last
        self.bounds = np.searchsorted(self.start, self.at)


_ORDER = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n token hashes; shorter than h by n-1."""
    if len(h) < n:
        return np.empty(0, U64)
    g = h[: len(h) - n + 1] * _ORDER[0]
    for k in range(1, n):
        g += h[k : len(h) - n + 1 + k] * _ORDER[k]
    return mix(g + U64(n))


def release() -> None:
    """Give freed memory back to the system: workers are kept for later tasks, beside others of their executor."""
    if len(_powers.get("p", ())) > 1 << 21:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunked(batches, column: str, limit: int = CHUNK_BYTES):
    """(rows, texts) pieces of record batches: whole texts as bytes (null: None), about `limit` bytes and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(ends):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(lo, hi - lo), col.slice(lo, hi - lo).to_pylist()
            lo = hi
        release()


def blobs(keys: np.ndarray, shards: int, *columns: np.ndarray):
    """Split parallel arrays by the key's high bits, into a power of two of shards: (shard, key bytes, column bytes...) for each shard that has rows."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    lowest = np.arange(shards, dtype=U64) << U64(65 - shards.bit_length()) if shards > 1 else np.zeros(1, U64)
    cuts = np.append(np.searchsorted(keys, lowest), len(keys))
    for k in range(shards):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            yield (k, keys[a:b].tobytes(), *(c[a:b].tobytes() for c in columns))


def unique_counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs (or the sums of `counts`)."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def grouped(batches):
    """(key, table of its rows) for batches sorted by their first column; a key's rows may span batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and key[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield last, pa.Table.from_batches(held)
    release()
