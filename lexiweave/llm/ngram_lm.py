"""Language-model scoring with exact n-gram counts, looked up by key shard.

Counting covers every training text, all its unigrams and bigrams. N-grams are dealt to key shards, whose number grows
with the input. Documents are scored in blocks of whole texts: a block asks each shard for the counts of its distinct
n-grams, the shard's task answers in the order asked, and the block's texts meet the answers. `score_held_out` counts from
the same requests, which carry the block's own training counts; `fit` and `score` take texts of two tables.
Nothing is broadcast and no table has a size limit. A word's probability interpolates the bigram's relative frequency
with the unigram's; the base score is that of the unigrams alone. Words are known by 64-bit hashes, bigrams by 48 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import SPACED, U64, Tokens, blobs, chunked, mix, release, unique_counts
from .filters import BLOB_SCHEMA, KeyFilter, count_blobs, pack_keys, unpack_keys
from .shared import shards_for, stored

BIGRAM_WEIGHT = 0.4
BEGIN, END = mix(np.array([0xB0B0, 0xE0E0], U64))

# Scoring uses neither of these nor level_key and probe_levels; tests refer to them.
LEVELS = 2.0 ** (1 + np.arange(120) / 2)
HOT_WORDS = 400_000


def sequences(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before, document) of each text's words and its end."""
    docs = len(t.bounds) - 1
    words = np.diff(t.bounds)
    doc = np.repeat(np.arange(docs), words + 1)
    h = np.empty(len(doc), U64)
    ends = t.bounds[1:] + np.arange(docs)
    inside = np.ones(len(h), bool)
    inside[ends] = False
    h[inside], h[ends] = t.hash[t.bounds[0] : t.bounds[-1]], END
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.concatenate(([0], ends[:-1] + 1))[:docs]] = BEGIN
    return h, before, doc


def unigram_keys(h: np.ndarray) -> np.ndarray:
    """Odd keys; those of bigrams are even."""
    return mix(h + U64(0x51ED27F5)) | U64(1)


def bigram_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """48-bit keys, which a shuffle carries in fewer bytes."""
    return mix(before * U64(0x9FB21C651E98DF25) + h) & U64(0xFFFFFFFFFFFF0000)


def level_key(keys: np.ndarray, q: int) -> np.ndarray:
    """The key under which level q of an n-gram is held: the same shard bits, others below."""
    top = U64(0xFFFF000000000000)
    return (keys & top) | (mix(keys + U64(q * 0x2545F4914F6CDD1D & (1 << 64) - 1)) & ~top)


def probe_levels(f: KeyFilter, keys: np.ndarray) -> np.ndarray:
    level, at, q = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while len(at) and q <= len(LEVELS):
        at = at[f.has(level_key(keys[at], q))]
        level[at] = q
        q += 1
    return level


class Model:
    """Totals of the training texts, and the number of key shards that their counts are dealt to."""

    def __init__(self, total: int, vocabulary: int, texts: int, shards: int):
        self.total, self.vocabulary, self.texts, self.shards = total, vocabulary, texts, shards


def _ngram_pieces(batches):
    for _, texts in chunked(batches, "t"):
        h, before, _ = sequences(Tokens([x or b"" for x in texts], SPACED))
        u, n = unique_counts(h)
        yield unigram_keys(u), n
        yield unique_counts(bigram_keys(before, h))


TOTALS = "shard int, keys binary, counts binary, total long, vocabulary long, texts long"


def _totals(key, group):
    """One row for a shard: its distinct keys, sorted, and their counts, and what its unigrams add up to."""
    keys = np.concatenate([unpack_keys(x) for x in group.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in group.column("counts").to_pylist()])
    keys, counts = unique_counts(keys, counts.astype(np.int64))
    words = (keys & U64(1)) == 1
    row = [key[0].as_py(), pack_sorted(keys), _zip(pack_keys(counts.view(U64))), int(counts[words].sum()), int(words.sum()), int(counts[keys == unigram_keys(np.array([END]))[0]].sum())]
    return pa.table([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "keys", "counts", "total", "vocabulary", "texts"])


def fit(training: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """(model, exact counts of unigrams and bigrams: TOTALS) of all of training's texts; null texts are empty, each text has one end token."""
    t = training.select(F.col(text).cast("binary").alias("t"))
    shards = min(shards_for(t), 1 << 16)
    counts = stored(t.mapInArrow(lambda b: count_blobs(_ngram_pieces(b), shards), BLOB_SCHEMA).groupBy("shard").applyInArrow(_totals, TOTALS), "ngrams")
    return Model(*counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "vocabulary", "texts"))).first(), shards), counts


# scoring by blocks

BLOCKS = "block long, shard int, data binary"  # shard -1: the block's rows; else the counts that the shard answers
_ROWS = pa.ipc.IpcWriteOptions(compression="zstd")


def _blocks(batches):
    part, number = TaskContext.get().partitionId() << 40, 0
    for rows, _ in chunked(batches, "t"):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=_ROWS) as out:
            out.write_batch(rows)
        yield pa.record_batch([pa.array([part + number], pa.int64()), pa.array([-1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "shard", "data"])
        number += 1


def _read(data: bytes):
    """(rows, token, token before, document) of a block."""
    rows = pa.ipc.open_stream(data).read_all()
    return rows, *sequences(Tokens([x or b"" for x in rows.column("t").to_pylist()], SPACED))


def _distinct(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A block's distinct keys, sorted, and so in the order of their shards."""
    return np.unique(np.concatenate([unigram_keys(np.unique(h)), np.unique(bigram_keys(before, h))]))


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps, those of bigrams and of unigrams apart."""
    odd = (keys & U64(1)) == 1
    pairs, words = keys[~odd] >> U64(16), keys[odd]
    return len(pairs).to_bytes(8, "little") + _zip(pack_keys(np.diff(pairs, prepend=U64(0))) + pack_keys(np.diff(words, prepend=U64(0))))


def unpack_sorted(data: bytes) -> np.ndarray:
    cut, raw = 8 * int.from_bytes(data[:8], "little"), _unzip(data[8:])
    pairs, words = np.cumsum(unpack_keys(raw[:cut]), dtype=U64), np.cumsum(unpack_keys(raw[cut:]), dtype=U64)
    return np.sort(np.concatenate([pairs << U64(16), words]))


ASKED = "block long, shard int, keys binary, counts binary"  # block null: only counts; counts null: none


def _ask(batches, shards: int, train: bool):
    """A block's keys by shard, with their counts in its rows that aren't held out if `train`."""
    for batch in batches:
        for block, data in zip(batch.column(0), batch.column(2), strict=True):
            rows, h, before, doc = _read(data.as_py())
            keys = _distinct(h, before)
            n = np.zeros(len(keys), U64)
            if train:
                own = np.array([x is False for x in rows.column("held_out").to_pylist()])[doc]
                for k in (unigram_keys(h[own]), bigram_keys(before[own], h[own])):
                    k, c = unique_counts(k)
                    n[np.searchsorted(keys, k)] = c
            asked = list(blobs(keys, shards, n))
            counts = [_zip(pack_keys(np.frombuffer(c, U64))) if train else None for *_, c in asked]
            yield pa.record_batch([pa.array([block.as_py()] * len(asked), pa.int64()), pa.array([s for s, *_ in asked], pa.int32()), pa.array([pack_sorted(np.frombuffer(k, U64)) for _, k, _ in asked], pa.binary()), pa.array(counts, pa.binary())], names=["block", "shard", "keys", "counts"])
        release()


def _answer(key, group):
    """Of each block that asks, the summed counts of its keys; and, with block null, the shard's Model totals."""
    blocks, asked, held = group.column("block").to_pylist(), [unpack_sorted(k) for k in group.column("keys").to_pylist()], group.column("counts").to_pylist()
    own = [(k, unpack_keys(_unzip(c)).astype(np.int64)) for k, c in zip(asked, held, strict=True) if c is not None]
    keys, counts = np.empty(0, U64), np.empty(0, np.int64)
    if own:
        keys, counts = unique_counts(np.concatenate([k[c > 0] for k, c in own]), np.concatenate([c[c > 0] for _, c in own]))
    words = (keys & U64(1)) == 1
    totals = [counts[words].sum(), words.sum(), counts[keys == unigram_keys(np.array([END]))[0]].sum()]
    out = [(None, np.array(totals, np.int64).tobytes())]
    for block, wanted in zip(blocks, asked, strict=True):
        if block is not None:
            n = np.zeros(len(wanted), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                n = np.where(keys[at] == wanted, counts[at], 0)
            out.append((block, _zip(pack_keys(n.view(U64)))))
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})


def _score(group, model: Model):
    parts = dict(zip(group.column("shard").to_pylist(), group.column("data").to_pylist(), strict=True))
    rows, h, before, doc = _read(parts.pop(-1))
    n, keys = rows.num_rows, _distinct(h, before)
    counts = np.concatenate([unpack_keys(_unzip(parts[s])) for s in sorted(parts)]).astype(np.int64)
    words, where = np.unique(h, return_inverse=True)
    word = counts[np.searchsorted(keys, unigram_keys(words))][where]
    pair, at = np.unique(bigram_keys(before, h), return_inverse=True)
    pair = counts[np.searchsorted(keys, pair)][at]
    size = np.bincount(doc, minlength=n)
    scale = model.total + model.vocabulary + 1
    base = np.bincount(doc, np.log10(word + 1.0), n) - size * np.log10(scale)
    history = np.maximum(np.concatenate(([0], word[:-1])), 1)
    history[before == BEGIN] = max(1, model.texts)
    score = np.bincount(doc, np.log10(BIGRAM_WEIGHT * np.minimum(1.0, pair / history) + (1 - BIGRAM_WEIGHT) * (word + 1) / scale), n)
    return pa.table([*(rows.column(c).combine_chunks() for c in ("id", "held_out")), pa.array(size.astype(np.int64)), pa.array(np.bincount(doc, word > 0, n).astype(np.int64)), pa.array(np.full(n, model.total, np.int64)), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _cut(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return stored(docs.select(F.col(id_column).alias("id"), "held_out", F.col(text).cast("binary").alias("t")).mapInArrow(_blocks, BLOCKS), "blocks")


def _scored(docs: DataFrame, blocks: DataFrame, answers: DataFrame, model: Model, id_column: str) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()
    scored = blocks.unionByName(answers.where("block is not null")).groupBy("block").applyInArrow(lambda g: _score(g, model), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_column)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, which has held_out (boolean; carried along only). Null texts are empty; other columns are not read."""
    blocks, shards = _cut(docs, id_column, text), model.shards
    known = counts.select(F.lit(None).cast("long").alias("block"), "shard", "keys", "counts")
    asked = blocks.mapInArrow(lambda b: _ask(b, shards, False), ASKED).unionByName(known)
    return _scored(docs, blocks, asked.groupBy("shard").applyInArrow(_answer, BLOCKS), model, id_column)


def score_held_out(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """As `fit` on the rows of docs that aren't held out and `score` of all, with one pass over keys for both.

    A null held_out counts as held out. Null texts are empty; every row gives a row, repeated ones too, and columns of
    docs beside the three are not read. An empty table, or one without a row to learn from, has N = 0.
    """
    blocks, shards = _cut(docs, id_column, text), min(shards_for(docs), 1 << 16)
    answers = stored(blocks.mapInArrow(lambda b: _ask(b, shards, True), ASKED).groupBy("shard").applyInArrow(_answer, BLOCKS), "answers")
    totals = sum((np.frombuffer(r["data"], np.int64) for r in answers.where("block is null").select("data").collect()), np.zeros(3, np.int64))
    return _scored(docs, blocks, answers, Model(*map(int, totals), shards), id_column)


__all__ = ["Model", "fit", "probe_levels", "score", "score_held_out", "sequences"]
