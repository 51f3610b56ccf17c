"""Sampled SentencePiece segmentation and lossless decoding.

A text, with a space put before it, is cut into units: each is a run of spaces and the unbroken run after it, and
longer ones are cut every UNIT bytes between characters. Pieces with a space after another byte don't occur in units and are left out. A unit's lattice has an edge for every vocabulary piece (spaces stand for
the piece mark) and one for every byte. Forward filtering sums path weights once for each distinct unit of a chunk; backward
sampling draws each occurrence's path from its end. Random numbers are hashes of seed, row key, unit
number and step, so a row's segmentation is the same in any partitioning and order.

Piece weights are the model's log probabilities for a unigram model. A BPE model has merge ranks instead of probabilities; its piece of
rank r weighs 1 / (r + 2).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import U64, chunked, mix, prefix_hash, release, span_hash
from .shared import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = 48
MARK = "▁"
CHUNK = 400_000


class Pieces:
    """A model's pieces: bytes of each id, log weights, and a trie over bytes."""

    def __init__(self, path: str = MODEL, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = [b""] * n
        self.byte_ids = np.full(256, -1, np.int64)
        weight = np.full(n, -np.inf)
        scores = np.array([sp.get_score(i) for i in range(n)])
        ranked = (scores[scores < 0] % 1 == 0).all()  # a BPE model's scores are negated ranks
        lowest = -np.log(n + 2.0) if ranked else scores[scores > -1e6].min()
        usable = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[1:-1], 16)])
                weight[i] = lowest - 5
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                b = piece.replace(MARK, " ").encode()
                self.bytes[i] = b
                if b" " not in b.lstrip(b" ") and len(b) <= UNIT:
                    usable.append((b, i))
                    weight[i] = max(lowest, -np.log(2.0 - scores[i])) if ranked else scores[i]
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback, so decoding can't be lossless")
        if not 0 <= alpha <= 1.8:
            raise ValueError("alpha must be between 0 and 1.8")
        self.weight = weight * alpha
        self.factor = np.exp(self.weight)
        self.per_byte = float(np.exp(-(lowest - 5) * alpha / 2))
        self.base, self.check, self.piece = double_array(usable)


def double_array(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie as (base, check, piece): state s goes by byte x to t = base[s] + x where check[t] == s; the root is 0, piece -1 where no word ends."""
    child: dict[int, dict[int, int]] = {}
    ends, n = {}, 1
    for b, i in words:
        node = 0
        for x in b:
            down = child.setdefault(node, {})
            if x not in down:
                down[x], n = n, n + 1
            node = down[x]
        ends[node] = i
    taken = bytearray(2 * n + 1024)
    taken[0] = 1
    offset, slot = {}, [0] * n
    least, degree = 1, 0
    for node in sorted(child, key=lambda k: -len(child[k])):
        xs = sorted(child[node])
        if len(xs) != degree:  # the search of every degree starts anew, and never goes back within it
            least, degree = 1, len(xs)
        at = least = taken.index(0, least)
        while at < xs[0] or any(taken[at - xs[0] + x] for x in xs):
            at = taken.index(0, at + 1)
            if at + 512 > len(taken):
                taken.extend(bytes(len(taken)))
        if degree > 1:
            least = at
        offset[node] = at - xs[0]
        for x in xs:
            taken[offset[node] + x] = 1
            slot[child[node][x]] = offset[node] + x
    size = max(slot) + 257
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    for node, down in child.items():
        base[slot[node]] = offset[node]
        check[[slot[to] for to in down.values()]] = slot[node]
    piece[[slot[node] for node in ends]] = list(ends.values())
    return base, check, piece


_loaded: dict[tuple, Pieces] = {}


def load(path: str, alpha: float) -> Pieces:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Pieces(path, alpha)
    return _loaded[path, alpha]


def cut_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer of the texts with a space before each non-empty one, unit starts with the end of all, first unit of each text with the end)."""
    lead = [b" " + t if t else b"" for t in texts]
    buf = np.frombuffer(b"".join(lead), np.uint8)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lead), np.int64, len(lead)))))
    space = buf == 0x20
    inner = np.zeros(len(buf), bool)
    inner[1:] = space[:-1]
    inner[at[:-1][at[:-1] < len(buf)]] = False
    start = np.flatnonzero(space & ~inner)
    ends = np.append(start[1:], len(buf)) if len(start) else start
    ends = np.minimum(ends, at[np.minimum(np.searchsorted(at, start, side="right"), len(at) - 1)]) if len(start) else ends
    long = np.flatnonzero(ends - start > UNIT)
    if len(long):
        more = []
        for a, b in zip(start[long].tolist(), ends[long].tolist(), strict=True):
            while b - a > UNIT:
                a += UNIT
                while (buf[a] & 0xC0) == 0x80 and a > 0:
                    a -= 1
                more.append(a)
        start = np.sort(np.concatenate((start, more)))
    first = np.searchsorted(start, at)
    return buf, np.append(start, len(buf)), first


#: Bytes of a character by its first byte; 0 for the others.
CHAR_BYTES = np.repeat([1, 0, 2, 3, 4], [0x80, 0x40, 0x20, 0x10, 0x10])


class Lattice:
    """Incoming edges of every node of distinct units laid end to end (unit k: nodes node[k] to node[k] + its length).

    Forward sums are kept as plain products: every byte of an edge multiplies it by a constant, which puts sums of
    UNIT bytes well inside a double's range and cancels in the shares.
    """

    def __init__(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, p: Pieces):
        self.node = np.concatenate(([0], np.cumsum(size + 1)))
        n = int(self.node[-1])
        unit = np.repeat(np.arange(len(size)), size)
        rel = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
        text = buf[start[unit] + rel]
        left = size[unit] - rel  # bytes to the unit's end
        origin = self.node[unit] + rel
        chars = CHAR_BYTES[text]
        covered = np.zeros(len(text) + 4, bool)  # by a piece of one character
        runs = []  # (bytes, places, ids): of each, a node is the end of one edge at most
        at, state, step = np.arange(len(text)), np.zeros(len(text), np.int32), 0
        while len(at):
            to = p.base.take(state) + text[at + step]
            ok = np.flatnonzero(p.check.take(to) == state)
            at, state = at[ok], to[ok]
            step += 1
            piece = p.piece.take(state)
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                runs.append((step, at[hit], piece[hit].astype(np.int64)))
                single = at[hit][chars[at[hit]] == step]
                for k in range(step if step <= 4 else 0):
                    covered[single + k] = True
            go = np.flatnonzero(left[at] > step)
            at, state = at[go], state[go]
        bare = np.flatnonzero(~covered[: len(text)])
        runs.append((1, bare, p.byte_ids[text[bare]]))

        sums = np.zeros(n)
        sums[self.node[:-1]] = 1.0
        begin, edges = [], []
        for step, place, ids in runs:
            end_rel = (rel[place] + step).astype(np.uint8)
            by = np.argsort(end_rel, kind="stable")
            src = origin[place][by]
            edges.append((src, src + step, ids[by], p.factor[ids[by]] * p.per_byte**step))
            begin.append(np.searchsorted(end_rel[by], np.arange(1, UNIT + 3)).tolist())
        for depth in range(UNIT + 1):
            for (src, dst, _, w), cut in zip(edges, begin, strict=True):
                a, b = cut[depth], cut[depth + 1]
                if a < b:
                    sums[dst[a:b]] += sums[src[a:b]] * w[a:b]
        # Edges by their end: the runs fill each node's places one after the other.
        degree = np.zeros(n + 1, np.int64)
        for _, dst, _, _ in edges:
            degree[dst + 1] += 1
        self.lo = np.cumsum(degree)
        total = int(self.lo[-1])
        self.src, self.ids, self.upto = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
        free, run = self.lo[:-1].copy(), np.zeros(n)
        for src, dst, ids, w in edges:
            e = free[dst]
            free[dst] += 1
            self.src[e], self.ids[e] = src, ids
            run[dst] += sums[src] * w / sums[dst]
            self.upto[e] = run[dst]


def sample(lattice: Lattice, unit: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of pieces) of sampled paths through each occurrence's unit, drawn from its end backward with numbers hashed from its key."""
    at = lattice.node[unit] + size[unit]
    begin = lattice.node[unit]
    live, step, steps = np.arange(len(unit)), 0, []
    count = np.zeros(len(unit), np.int64)
    while len(live):
        u = (mix(key[live] + U64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(11)).astype(np.float64) * 2.0**-53
        e, last = lattice.lo[at[live]], lattice.lo[at[live] + 1] - 1
        move = np.flatnonzero((lattice.upto[e] <= u) & (e < last))
        while len(move):
            e[move] += 1
            move = move[(lattice.upto[e[move]] <= u[move]) & (e[move] < last[move])]
        steps.append((live, lattice.ids[e]))
        count[live] += 1
        at[live] = lattice.src[e]
        live = live[at[live] > begin[live]]
        step += 1
    ids = np.empty(count.sum(), np.int32)
    end = np.cumsum(count)
    for k, (who, piece) in enumerate(steps):
        ids[end[who] - 1 - k] = piece
    return ids, count


def encode_texts(texts: list[bytes], keys: np.ndarray, p: Pieces, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text's)."""
    buf, start, first = cut_units(texts)
    n = len(start) - 1
    if not n:
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    h = span_hash(prefix_hash(buf), start[:-1], start[1:])
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    number = (np.arange(n) - first[text]).astype(U64)
    key = mix(mix(keys[text] + U64(seed)) + number * U64(0xA24BAED4963EE407))
    all_ids, all_counts = [], []
    cuts = np.searchsorted(start, np.arange(0, len(buf), CHUNK)).tolist() + [n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # so that a long text takes no more at a time than short ones
        if a == b:
            continue
        _, index, unit = np.unique(h[a:b], return_index=True, return_inverse=True)
        size = start[a + 1 + index] - start[a + index]
        ids, count = sample(Lattice(buf, start[a + index], size, p), unit, size, key[a:b])
        all_ids.append(ids)
        all_counts.append(count)
    upto = np.concatenate(([0], np.cumsum(np.concatenate(all_counts))))
    return np.concatenate(all_ids), upto[first]


def encode(docs: DataFrame, key_column: str = "doc_id", text: str = "text", ids: str = "piece_ids", model: str = MODEL, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """docs with `ids`: array<int>, a segmentation sampled with weights to the power alpha.

    Rows with equal key, text and seed get equal segmentations; a null key is a key like any other. Null texts have null
    ids, empty ones none. An existing column of the name is replaced.
    """
    source, keep = _keyed(docs, key_column, ids)
    return source.mapInArrow(lambda b: _encoded(b, keep, text, ids, model, alpha, seed), f"{_schema(docs, keep)}, `{ids}` array<int>")


def _schema(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


def _keyed(docs: DataFrame, key_column: str, *new: str) -> tuple[DataFrame, list[str]]:
    """docs without the columns `new`, a hash of the key at the end; and the columns kept."""
    keep = [c for c in docs.columns if c not in new]
    return docs.select(*keep, F.xxhash64(key_column).alias(fresh("key", docs))), keep


def _encoded(batches, keep, text, ids, model, alpha, seed):
    p = load(model, alpha)
    for rows, texts in chunked(batches, text, CHUNK):
        keys = rows.column(rows.num_columns - 1).to_numpy().view(U64)
        got, offsets = encode_texts([t or b"" for t in texts], keys, p, seed)
        null = pa.array([t is None for t in texts])
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(got), mask=null)
        yield pa.record_batch([*rows.columns[:-1], lists], names=[*keep, ids])


def piece_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for; decoding needs nothing else of a model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = lambda i: bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
    return [plain(i) for i in range(sp.get_piece_size())]


def decode_ids(ids: list[int], pieces: list[bytes]) -> bytes:
    out = b"".join(map(pieces.__getitem__, ids))
    return out[1:] if out[:1] == b" " else out


def _decoded(batches, keep, ids, text, model):
    pieces = piece_bytes(model)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            lists = batch.column(batch.schema.get_field_index(ids))
            flat, cuts, known = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            # One row's ids at a time become Python integers.
            out = [decode_ids(flat[a:b].tolist(), pieces).decode() if ok else None for a, b, ok in zip(cuts[:-1].tolist(), cuts[1:].tolist(), known, strict=True)]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, pa.string())], names=[*keep, text])
        release()


def decode(docs: DataFrame, ids: str = "piece_ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """docs with `text`: the exact text that `ids` encode; null for null."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep).mapInArrow(lambda b: _decoded(b, keep, ids, text, model), f"{_schema(docs, keep)}, `{text}` string")


def round_trip(docs: DataFrame, key_column: str = "doc_id", text: str = "text", ids: str = "piece_ids", decoded: str = "decoded", model: str = MODEL, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """decode(encode(docs)) inside one worker instead of two: ids are decoded as they are made, from nothing but themselves."""
    source, keep = _keyed(docs, key_column, ids, decoded)

    def run(batches):
        return _decoded(_encoded(batches, keep, text, ids, model, alpha, seed), [*keep, ids], ids, decoded, model)

    return source.mapInArrow(run, f"{_schema(docs, keep)}, `{ids}` array<int>, `{decoded}` string")
