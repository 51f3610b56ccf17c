"""Plain restatements of what the operators compute, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def fold(b: bytes) -> bytes:
    return b.translate(bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256)))


def spaced_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", fold((text or "").encode()))


def components(n, links):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def jaccard(docs):
    """{row: (n_shingles, component_id)} in order of rows (id, text)."""
    sets = []
    for _, text in docs:
        w = spaced_words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    posting = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            posting[x].append(k)
    links = []
    for a, s in enumerate(sets):
        both = Counter(b for x in s for b in posting[x] if b < a)
        links += [(a, b) for b, m in both.items() if 100 * m >= 80 * (len(s) + len(sets[b]) - m)]
    root = components(len(docs), links)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    return [(i, len(s), low.get(root[k])) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def repeats(docs, length=200):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(docs, items, words=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold((t or "").encode()))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        m = min(words, len(w))
        for i in range(len(w) - m + 1) if m else ():
            windows[tuple(w[i : i + m])].add(k)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                own = windows.get(tuple(w[a : a + m]))
                if own:
                    hit.update(range(a, a + m))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def base_scores(docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[*spaced_words(t), None] for _, t in docs]
    c = Counter(x for (i, _), w in zip(docs, tokens, strict=True) if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for (i, _), w in zip(docs, tokens, strict=True)]


def near_vectors(rows, cosine=0.98):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    links, count = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= cosine:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    root = components(len(rows), links)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[root[k]] = min(low.get(root[k], r[0]), r[0])
    return [(r[0], count[k], low.get(root[k]), r[0] is not None and r[0] == low.get(root[k])) for k, r in enumerate(rows)]


MASK = (1 << 64) - 1


def mixed(x):
    """bytekit.mix of one number."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


class Segmenter:
    """Forward filtering and backward sampling node by node, with pieces and weights read from the model anew."""

    def __init__(self, path, unit=48):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n, self.unit, self.pieces, self.bytes = sp.get_piece_size(), unit, {}, {}
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(name[1:-1], 16)] = (i, math.exp(-5) / (n + 2))
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[name.replace("\u2581", " ").encode()] = (i, max(1 / (n + 2), 1 / (2 - sp.get_score(i))))
        self.longest = max(map(len, self.pieces))
        self.known = {}

    def units(self, text):
        for run in re.findall(rb" +[^ ]*", b" " + text):
            while len(run) > self.unit:
                k = self.unit
                while run[k] & 0xC0 == 0x80:
                    k -= 1
                yield run[:k]
                run = run[k:]
            yield run

    def edges(self, u):
        """Of each node the edges that end there, shorter ones first, bytes that no character's piece covers last: (begin, id, weight, sum before)."""
        if u not in self.known:
            bare = []
            for c in u.decode():
                b = c.encode()
                bare += [b not in self.pieces] * len(b)
            into, total = [[]], [1.0]
            for j in range(1, len(u) + 1):
                here = [(i, *self.pieces[u[i:j]]) for i in range(j - 1, max(-1, j - self.longest - 1), -1) if u[i:j] in self.pieces]
                if bare[j - 1]:
                    here.append((j - 1, *self.bytes[u[j - 1]]))
                into.append([(i, x, total[i] * w) for i, x, w in here])
                total.append(sum(w for *_, w in into[-1]))
            self.known[u] = into, total
        return self.known[u]

    def paths(self, u):
        """{ids: probability} of every path through a unit, by listing them."""
        into, total = self.edges(u)

        def back(j):
            if not j:
                return {(): 1.0}
            return {(*p, x): q * w / total[j] for i, x, w in into[j] for p, q in back(i).items()}

        return back(len(u))

    def sample(self, text, key, seed=0):
        out = []
        for number, u in enumerate(self.units(text) if text else ()):
            into, total = self.edges(u)
            own, j, step, ids = mixed((mixed((key + seed) & MASK) + number * 0xA24BAED4963EE407) & MASK), len(u), 0, []
            while j:
                draw, run = (mixed((own + (step + 1) * 0x9E3779B97F4A7C15) & MASK) >> 11) * 2.0**-53, 0.0
                for i, x, w in into[j]:
                    run += w / total[j]
                    if run > draw:
                        break
                ids.append(x)
                j, step = i, step + 1
            out += ids[::-1]
        return out


def language(model, text):
    """(label, score) of a text by the network's definition: each filter a product with every run of embedded bytes, window by window."""
    low = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in (text or "").encode())
    low = re.sub(rb"\xc3[\x80-\x96\x98-\x9e]", lambda m: bytes([0xC3, m[0][1] + 32]), low)
    if not any(c.isalpha() for c in text or ""):
        return "und", 1.0
    width, logits = 256, []
    for at in range(0, len(low), width):
        w = low[at : at + width] if at + width <= len(low) else low[-width:]
        w = w.ljust(width, b"\0")
        if not re.search(rb"[a-zA-Z\x80-\xff]", w):
            continue
        e = model.E[np.frombuffer(w, np.uint8)].astype(np.float64)
        top = [max(sum(e[i + k] @ f[k][:, c] for k in range(n)) for i in range(width - n + 1)) for n, f in sorted(model.F.items()) for c in range(f.shape[2])]
        logits.append(np.maximum(top, 0) @ model.V + model.b)
    p = np.exp(np.mean(logits, axis=0))
    p /= p.sum()
    return model.labels[int(p.argmax())], float(p.max())
