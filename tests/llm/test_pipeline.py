"""The stages of corpus_pipeline.py on their own and one after the other, against plain restatements."""

import re

import corpus_pipeline
from lexiweave.llm import language_id
from lexiweave.llm.shared import remainder
from pyspark.sql import functions as F

from . import brute
from .test_operators import SF, frame, odd_texts

STAGE = dict(corpus_pipeline.STAGES)


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def survivors(texts):
    """What near_duplicates keeps: the smallest id of each component, repeated rows once, and rows without id."""
    found = brute.jaccard(texts)
    return sorted({(i, t) for (i, t), (_, _, low) in zip(texts, found, strict=True) if i is None or low is None or i == low}, key=repr)


def cut(texts, length=200):
    """Texts without the bytes of repeated strings; those that have a word left."""
    seen, out = {}, []
    raw = [(i, (t or "").encode()) for i, t in texts]
    for _, b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")))
    return out


def test_near_duplicates_and_repeats(spark):
    docs = frame(spark, odd_texts(), extra=False)
    kept = STAGE["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert texts_of(kept) == survivors(odd_texts())
    plain = [(i, f"{i} " + "word " * 3 + f"tail{i}") for i in range(30)]  # nothing repeats: all of it stays as it is
    assert texts_of(STAGE["repeats"](spark, frame(spark, plain, extra=False), SF)) == sorted(plain, key=repr)
    passage = " ".join(f"w{k}" for k in range(90))
    texts = [*plain, (100, "before " + passage + " after"), (101, passage), (102, "x " + passage + " y"), (103, None), (104, "")]
    got = STAGE["repeats"](spark, frame(spark, texts, extra=False), SF)
    want = [(i, t) for i, t in cut(texts) if re.search(r"[^\x20\x09-\x0D]", t)]
    assert texts_of(got) == sorted(want, key=repr)
    assert got.where(F.col("n_chars") != F.length("text")).count() == 0
    for name in ("near_duplicates", "repeats", "decontamination", "pieces"):
        assert STAGE[name](spark, docs.limit(0), SF).count() == 0


def test_decontamination(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [(k, f"plain text number {k} without any passage") for k in range(5)]
    leaks = [(10 + k, f"first{k} words {t} last{k} words") for k, (_, t) in enumerate(items[:5])]
    got = dict(texts_of(STAGE["decontamination"](spark, frame(spark, clean + leaks, extra=False), SF)))
    assert all(got[i] == t for i, t in clean)
    left = [(i, got[i]) for i, _ in leaks]
    assert all(not hit for *_, hit in brute.contamination(left, items))
    assert all(f"first{i - 10}" in t and f"last{i - 10}" in t for i, t in left)


def test_stages_over_odd_texts(spark):
    """Null, empty, very long and repeated texts, null ids and columns of clashing names go through every stage; an empty table gives an empty one."""
    docs = frame(spark, odd_texts()).withColumns({"lang_pred": F.lit("x"), "piece_ids": F.lit("y"), "spans": F.lit(0), "score": F.lit("z")})
    texts = odd_texts()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "pieces":
            assert got.columns == docs.columns
            assert {(r["lang_pred"], r["piece_ids"], r["spans"], r["score"]) for r in got.select("lang_pred", "piece_ids", "spans", "score").collect()} == {("x", "y", 0, "z")}
        assert {r["doc_id"] for r in got.select("doc_id").collect()} <= {i for i, _ in texts}
    assert texts_of(got) == sorted(texts, key=repr)
    assert {r["n_pieces"] for r in got.where("text is null").collect()} == {None}
    kept = texts_of(STAGE["language_id"](spark, docs, SF))
    assert set(kept) <= {(i, t) for i, t in texts if t and any(map(str.isalpha, t))}
    clean = STAGE["decontamination"](spark, docs, SF)
    assert texts_of(clean) == sorted(((i, t) for i, t in texts if t and re.search(r"[^\x20\x09-\x0D]", t)), key=repr)


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    judged = language_id.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= corpus_pipeline.MIN_SCORE))
    first = texts_of(judged)
    assert texts_of(STAGE["language_id"](spark, docs, SF)) == first and len(first) >= 0.9 * docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "n_pieces", "piece_ids"]
    got = {r["doc_id"]: r for r in out.collect()}
    near = dict(survivors(first))
    repeated = {i: t for i, t in cut(list(near.items())) if re.search(r"[^\x20\x09-\x0D]", t)}
    assert set(got) <= set(repeated)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, *_, x in brute.contamination(list(repeated.items()), items) if x}
    assert all(got[i]["text"] == t for i, t in repeated.items() if i not in hit)
    assert all(len(r["piece_ids"]) == r["n_pieces"] for r in got.values())
