"""The codecs by name. `unit` says what is encoded at once: a string, or a block of strings."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa

#: Bytes that the reported space counts for a block's metadata.
BLOCK_METADATA = 24


@dataclass(frozen=True)
class Codec:
    key: str
    name: str
    unit: str  # string, block, trained (string, one dictionary), trained_batch (string, a dictionary a batch)
    encode: Callable | None = None  # bytes -> bytes
    decode: Callable | None = None  # bytes, raw size -> bytes


def _arrow(name: str, level: int | None = None) -> tuple[Callable, Callable]:
    codec = lambda: pa.Codec(name, compression_level=level) if level is not None else pa.Codec(name)

    def encode(data: bytes) -> bytes:
        return codec().compress(data, asbytes=True)

    def decode(data: bytes, size: int) -> bytes:
        return codec().decompress(data, decompressed_size=size, asbytes=True) if size else b""

    return encode, decode


def _deflate_string(data: bytes) -> bytes:
    return zlib.compress(data, 9) if data else b""  # an empty string takes no bytes


CODECS: dict[str, Codec] = {
    c.key: c
    for c in (
        Codec("raw", "Raw", "string", bytes, lambda d, n: d),
        Codec("lz4", "LZ4", "block", *_arrow("lz4_raw")),
        Codec("snappy", "Snappy", "block", *_arrow("snappy")),
        Codec("xz", "XZ", "block", lambda d: lzma.compress(d, format=lzma.FORMAT_XZ, check=lzma.CHECK_CRC64, preset=6), lambda d, n: lzma.decompress(d)),
        Codec("zstd", "Zstd", "block", *_arrow("zstd", 3)),
        Codec("deflate", "Deflate", "block", lambda d: zlib.compress(d, 9), lambda d, n: zlib.decompress(d)),
        Codec("brotli", "Brotli", "block", *_arrow("brotli", 11)),
        Codec("fsst", "FSST", "trained"),
        Codec("fsst_block", "FSST Block", "trained_batch"),
        Codec("onpair", "OnPair", "trained"),
        Codec("deflate_individual", "DeflateIndividual", "string", _deflate_string, lambda d, n: zlib.decompress(d) if d else b""),
    )
}

BUILT_IN = frozenset(CODECS)


def find(key: str) -> Codec:
    if key not in CODECS:
        raise ValueError(f"unknown codec {key!r}; there are {', '.join(CODECS)}")
    return CODECS[key]


def register(codec: Codec) -> None:
    """Add a codec of one's own; a key that is taken is an error."""
    if codec.key in CODECS:
        raise ValueError(f"codec {codec.key!r} exists")
    CODECS[codec.key] = codec


def unregister(key: str) -> None:
    """Take out a codec that was added; encodings made with it can still be decoded."""
    find(key)
    if key in BUILT_IN:
        raise ValueError(f"codec {key!r} can't be taken out")
    del CODECS[key]
