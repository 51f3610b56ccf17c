"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, filters of several widths run over them, each filter's maximum over a
fixed-length window goes to a softmax. Because the input alphabet has 256 symbols, a filter of width w
is a sum of table look-ups: tables over byte pairs make width 2 one look-up a position, widths 3 and 4
two. Training needs gradients at the maxima only, so it is sparse.

A document's windows cover its whole text; their logits are averaged over the windows with letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytekit import chunked

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBEDDING = 8
ROWS_PER_LABEL = 500  # bound on the distinct labelled texts that training uses, per label
ROWS = 128_000  # the same bound for all labels together
PIECES = 4  # places of a training row that windows are taken from
EPOCHS, RATE, SEED = 20, 0.1, 7
BATCH = 512
STEPS = 160  # at least, so that a small sample is learned as surely as a large one


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower(x: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the two-byte Latin-1 capitals in lower case."""
    x = _LOWER[x]
    capital = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) + 1
    x[capital] += 0x20
    return x


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows by position [WINDOW, n] of uint8, document of each); the last window of a longer text ends with the text."""
    parts, owner = [], []
    for k, t in enumerate(texts):
        a = lower(np.frombuffer(t, np.uint8))
        if not len(a):
            continue
        n = -(-len(a) // WINDOW)
        if n == 1:
            w = np.zeros((1, WINDOW), np.uint8)
            w[0, : len(a)] = a
        else:
            w = np.empty((n, WINDOW), np.uint8)
            w[:-1] = a[: (n - 1) * WINDOW].reshape(n - 1, WINDOW)
            w[-1] = a[-WINDOW:]
        parts.append(w)
        owner.append(np.full(n, k))
    if not parts:
        return np.empty((WINDOW, 0), np.uint8), np.empty(0, np.int64)
    return np.ascontiguousarray(np.concatenate(parts).T), np.concatenate(owner)


class ByteCNN:
    """The network: embedding E, filters F[w][k] (EMBEDDING x FILTERS for the k-th byte), softmax weights V and bias b."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.E = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.F = {w: rng.normal(0, 0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.V = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.b = np.zeros(len(labels), np.float32)
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def tables(self) -> dict:
        """Per width, look-up tables with the number of bytes that each covers."""
        if self._tables is None:
            self._tables = {}
            for w in WIDTHS:
                one = [self.E @ f for f in self.F[w]]
                self._tables[w] = [((one[k][:, None] + one[k + 1][None]).reshape(65536, FILTERS), 2) if k + 1 < w else (one[k], 1) for k in range(0, w, 2)]
        return self._tables

    def responses(self, x: np.ndarray, w: int) -> np.ndarray:
        """[WINDOW-w+1, n, FILTERS] filter outputs."""
        n, at, out = WINDOW - w + 1, 0, None
        for table, size in self.tables()[w]:
            index = x[at : at + n].astype(np.intp)
            if size == 2:
                index = index * 256 + x[at + 1 : at + 1 + n]
            got = table.take(index, axis=0)
            out = got if out is None else np.add(out, got, out=out)
            at += size
        return out

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.responses(x, w).max(axis=0) for w in WIDTHS], axis=1) if x.shape[1] else np.empty((0, len(WIDTHS) * FILTERS), np.float32)

    def logits(self, x: np.ndarray, batch: int = 128) -> np.ndarray:
        """[n, labels] for windows by position; in batches, to stay within cache."""
        return np.concatenate([np.maximum(self.features(x[:, i : i + batch]), 0) @ self.V + self.b for i in range(0, max(1, x.shape[1]), batch)])

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> None:
        """Mini-batch Adam on the mean cross-entropy; more epochs where fewer than STEPS steps would be made."""
        parts = max(1, x.shape[1] // BATCH)
        epochs = max(epochs, -(-STEPS // parts))
        rng = np.random.default_rng(seed)
        state: dict = {}
        step = 0

        def adam(name, value, grad):
            m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

        for _ in range(epochs):
            for part in np.array_split(rng.permutation(x.shape[1]), parts):
                step += 1
                xb, yb, n = x[:, part], y[part], len(part)
                self._tables = None
                tops, where = [], []
                for w in WIDTHS:
                    r = self.responses(xb, w)
                    where.append(r.argmax(axis=0))
                    tops.append(np.take_along_axis(r, where[-1][None], axis=0)[0])
                h = np.concatenate(tops, axis=1)
                a = np.maximum(h, 0)
                z = a @ self.V + self.b
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), yb] -= 1
                p /= n
                gV, gb, gh = a.T @ p, p.sum(axis=0), (p @ self.V.T) * (h > 0)
                gE, gF = np.zeros_like(self.E), {}
                for i, w in enumerate(WIDTHS):
                    g = gh[:, i * FILTERS : (i + 1) * FILTERS]
                    gF[w] = np.zeros_like(self.F[w])
                    for k in range(w):
                        seen = xb[where[i] + k, np.arange(n)[:, None]].astype(np.intp)
                        table = np.bincount((seen * FILTERS + np.arange(FILTERS)).ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
                        gF[w][k] = self.E.T @ table
                        gE += table @ self.F[w][k].T
                for name, value, grad in (("V", self.V, gV), ("b", self.b, gb), ("E", self.E, gE), *((f"F{w}", self.F[w], gF[w]) for w in WIDTHS)):
                    adam(name, value, grad)
        self._tables = None


def fit(df: DataFrame, text: str = "text", label: str = "lang", rows_per_label: int = ROWS_PER_LABEL) -> ByteCNN | None:
    """Train on a bounded sample of the labelled rows of df: up to rows_per_label distinct texts of each label, chosen by a hash of the text.

    With very many labels it is ROWS over their number, one at least. Of each text, windows at PIECES evenly spaced
    places are used. Rows with null text or label and empty texts don't count. Returns None when there is no labelled row.
    """
    rows = df.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).cast("string").alias("label"), F.col(text).cast("binary").alias("t")).withColumn("h", F.xxhash64("t"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return None
    wanted = max(1, min(rows_per_label, ROWS // len(sizes)))
    share = df.sparkSession.createDataFrame([(k, min(1.0, 2 * wanted / n)) for k, n in sizes.items()], "label string, share double")
    rows = rows.join(F.broadcast(share), "label").where(F.pmod("h", F.lit(1 << 20)) / (1 << 20) < F.col("share"))
    size = F.octet_length("t")
    pieces = [F.substring(F.col("t"), (F.lit(k) * F.greatest(size - WINDOW, F.lit(0)) / max(1, PIECES - 1)).cast("int") + 1, F.lit(WINDOW)) for k in range(PIECES)]
    texts = rows.select("label", "h", F.array(*pieces).alias("pieces")).groupBy("label", "h").agg(F.first("pieces").alias("pieces"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))  # over the sample only
    got = texts.withColumn("rank", rank).where(F.col("rank") <= wanted).select("label", "h", "pieces").collect()
    labels = sorted(sizes)
    got.sort(key=lambda r: (r["h"], r["label"]))
    x, _ = windows([bytes(p) for r in got for p in r["pieces"]])
    model = ByteCNN(labels)
    if x.shape[1]:
        model.train(x, np.repeat([labels.index(r["label"]) for r in got], PIECES))
    return model


def _predict(batches, model, column, keep):
    for batch in batches:
        for rows, texts in chunked([batch], column, 1 << 20):
            plain = [t or b"" for t in texts]
            letters = [any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in plain]
            x, owner = windows([t if ok else b"" for t, ok in zip(plain, letters, strict=True)])
            pred, score = np.full(len(plain), "und", object), np.ones(len(plain))
            if x.shape[1] and model is not None:
                z = model.logits(x).astype(np.float64)
                alive = (((x | 32) >= 97) & ((x | 32) <= 122) | (x >= 128)).any(axis=0)
                total = np.zeros((len(plain), len(model.labels)))
                np.add.at(total, owner[alive], z[alive])
                n = np.bincount(owner[alive], minlength=len(plain))
                z = total / np.maximum(n, 1)[:, None]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for k in np.flatnonzero(n):
                    pred[k], score[k] = model.labels[int(p[k].argmax())], float(p[k].max())
            kept = [rows.column(rows.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])


def predict(df: DataFrame, model: ByteCNN | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's `keep` columns (default: all but lang_pred and score) with lang_pred and score (the mean windows' softmax, 0 to 1).

    `und`, with score 1, where the text is null or has no letter, or where nothing could be learned. A text's windows
    cover all of it.
    """
    keep = [c for c in df.columns if c not in ("lang_pred", "score")] if keep is None else keep
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(lambda batches: _predict(batches, shared.value, text, keep), f"{schema}, lang_pred string, score double")


def held_out(id_column: Column, divisor: int = 4, kept: int = 2) -> Column:
    from .shared import remainder

    return remainder(id_column, divisor) == kept
