import hashlib
import math
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave.llm import chat_format, decontaminate, embedding_dedup, language_id, ngram_jaccard, ngram_lm, queries, sentencepiece_codec, suffix_dedup, url_filters, warc

from lexiweave.llm.components import forest

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(got, want):
    assert rows(got) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def odd_texts():
    """Null, empty, blank, very long, low-entropy, repeated and non-ASCII texts, with null and repeated ids."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghé漢") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c d"), (None, "a b c d"), (7, "x" * 3000), (8, "x" * 450), (9, "ab " * 900)]
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(120)] = word()
        out.append((20 + k, " ".join(near)))
    out += [(40, " ".join(base)), (40, " ".join(base)), (None, " ".join(base)), (41, " ".join(base).upper())]
    out += [(50 + k, " ".join(word() for _ in range(30 + 7 * k)) + "\n" + passage + "\n" + " ".join(word() for _ in range(25))) for k in range(6)]
    out += [(70, passage + passage), (71, "😀" * 120), (72, "é" * 99 + "😀" * 120), (80, " ".join(word() for _ in range(20000)))]
    return out


def frame(spark, texts, extra=True):
    data = [(i, t, "en", "s", 0) for i, t in texts]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    return df.withColumns({"rid": F.lit(1), "h": F.lit("x"), "key": F.lit(2), "t": F.lit(0.5), "id": F.lit("i")}) if extra else df


def test_jaccard(spark, documents):
    same(queries.op1_ngram_jaccard_join(spark, SF), brute.jaccard(documents))
    same(ngram_jaccard.jaccard_components(frame(spark, odd_texts())), brute.jaccard(odd_texts()))
    assert rows(ngram_jaccard.jaccard_components(frame(spark, []))) == []


def near_copies(n=150, changes=5, seed=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(100)]
    texts = []
    for k in range(n):
        near = list(base)
        for _ in range(rng.randint(0, changes)):
            near[rng.randrange(100)] = word()
        texts.append((k, " ".join(near)))
    return texts


def test_jaccard_bounds_change_nothing(spark, monkeypatch):
    """Near copies around the threshold: with regions that aren't gathered, and groups divided by rows of a table, down to blocks."""
    texts = near_copies() + odd_texts()
    want = brute.jaccard(texts)
    same(ngram_jaccard.jaccard_components(frame(spark, texts)), want)
    monkeypatch.setattr(ngram_jaccard, "HOT", 3)
    same(ngram_jaccard.jaccard_components(frame(spark, texts)), want)
    for group, rounds in ((2000, 4), (700, 2)):
        monkeypatch.setattr(ngram_jaccard, "GROUP", group)
        monkeypatch.setattr(ngram_jaccard, "ROUNDS", rounds)
        same(ngram_jaccard.jaccard_components(frame(spark, texts)), want)


def test_jaccard_regions_are_exact(monkeypatch):
    """Voronoi regions with windows find the same components as all pairs, whatever the number of pivots and the leaf size."""
    rng = np.random.default_rng(4)
    for leaf, pivots in ((1, 2), (3, 4), (12, 6)):
        monkeypatch.setattr(ngram_jaccard, "LEAF", leaf)
        monkeypatch.setattr(ngram_jaccard, "PIVOTS", pivots)
        for spread in (5, 20, 40, 90):
            base = rng.choice(10**6, (5, 60), replace=False)
            sets = []
            for k in range(80):
                own = base[k % 5].copy()
                own[rng.choice(60, rng.integers(0, 1 + 60 * spread // 100), replace=False)] = rng.integers(10**6, 10**7)
                sets.append(np.unique(own).astype(np.uint64))
            region = ngram_jaccard.Region(np.concatenate(sets), np.array([len(x) for x in sets]), 80)
            region.join()
            plain = [set(x.tolist()) for x in sets]
            links = [(a, b) for a in range(80) for b in range(a) if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])]
            assert region.label.tolist() == brute.components(80, links)


def test_jaccard_candidates_are_complete(monkeypatch):
    """Sparse and dense regions, spread over batches, keep every link."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = [t.encode() for _, t in near_copies(120, 3)]
    s = ngram_jaccard.Sets(texts)
    h, doc, place = ngram_jaccard.prefixes(s, s.distinct(), np.empty(0, np.uint64), 80)
    by = np.lexsort((s.k1[doc].view(np.int64), h.view(np.int64)))
    h, doc, place = h[by], doc[by], place[by]
    signs = ngram_jaccard.signatures(s, np.arange(len(texts)))[doc]
    columns = [h.view(np.int64), s.k1[doc].view(np.int64), s.size[doc].astype(np.int32), place.astype(np.int32), *(np.ascontiguousarray(signs[:, k]) for k in range(4))]
    names = [x.split()[0] for x in ngram_jaccard.REGIONS.split(", ")]
    whole = pa.record_batch([pa.array(c) for c in columns], names=names)
    cuts = np.sort(rng.integers(0, len(h), 30)).tolist()
    batches = [whole.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, len(h)], strict=True)]
    for dense in (2, 32, 1000):
        monkeypatch.setattr(ngram_jaccard, "DENSE", dense)
        got = pa.Table.from_batches(ngram_jaccard._candidates(batches, 80))
        low = dict(zip(*(x.tolist() for x in forest(got.column("u").to_numpy(), got.column("v").to_numpy())), strict=True))
        assert any(got.column("sure").to_pylist()) == (dense == 2)
        group = lambda k: low.get(int(s.k1[k].view(np.int64)), int(s.k1[k].view(np.int64)))  # noqa: B023, E731
        for a, _, c in brute.jaccard([(k, t.decode()) for k, t in enumerate(texts)]):
            assert group(a) == group(c)


def thue_morse(letters):
    t = "a"
    while len(t) < letters:
        t += t.translate({97: "b", 98: "a"})
    return t, t.translate({97: "b", 98: "a"})


def test_jaccard_long_words_ids_and_threshold(spark):
    x, y = thue_morse(2048)
    many = [f"w{k}" for k in range(100_004)]
    texts = [(1, f"p q r s {x}"), (2, f"p q r s {y}"), (2**62 + 5, "one two three four five six"), (2**62 + 7, "one two three four five six"), (-(2**63), "a b c d e f g"), (2**63 - 1, "a b c d e f g"), (-5, None)]
    for k, cut in ((10, 80_004), (20, 80_003)):  # 80,000 of 100,000 shingles are shared, and one less
        tail = [f"v{k}" + w for w in many]
        texts += [(k, " ".join(tail)), (k + 1, " ".join(tail[:cut]))]
    same(ngram_jaccard.jaccard_components(frame(spark, texts)), brute.jaccard(texts))


def test_one_of_each(spark):
    kept = ngram_jaccard.one_of_each(frame(spark, odd_texts()))
    low = {i: c for i, _, c in brute.jaccard(odd_texts()) if i is not None}
    assert {r["doc_id"] for r in kept.collect()} - {None} == {i for i, c in low.items() if i == c}
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_suffix_dedup(spark, documents):
    same(queries.op6_suffix_array_dedup(spark, SF), brute.repeats(documents))
    same(suffix_dedup.report(frame(spark, odd_texts())), brute.repeats(odd_texts()))
    assert rows(suffix_dedup.report(frame(spark, []))) == []


def test_suffix_dedup_hot_and_cold_paths_agree(spark, monkeypatch):
    want = brute.repeats(odd_texts(), 50)
    for hot in (2, 5, 1000):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        same(suffix_dedup.report(frame(spark, odd_texts()), length=50), want)


def test_suffix_dedup_leaves_no_shuffles(spark, monkeypatch):
    """What its steps shuffle, and the hot windows they store, is gone before the spans are joined, whenever the JVM collects its garbage."""
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    local = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in local for p in d.rglob("shuffle_*.data")}
    large = lambda p: p.exists() and p.stat().st_size > 10_000
    before, folders = files(), set(shared.glob("*"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = suffix_dedup.with_spans(docs)
    for _ in range(50):
        if not any(map(large, files() - before)):
            break
        time.sleep(0.1)
    assert not any(map(large, files() - before))
    assert {p.name.rsplit("-", 1)[0] for p in set(shared.glob("*")) - folders} == {"anchors", "hot-spans", "spans"}
    assert found.where("repeats is not null").count() and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_spans_of_a_row_are_joined():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 60):
        row = np.empty(n, suffix_dedup.RID)
        row["a"], row["b"] = rng.integers(-2, 2, n) << 62, rng.integers(0, 2, n)
        start = rng.integers(0, 200, n).astype(np.int32) + np.int32(2**31 - 300)
        stop = start + rng.integers(1, 12, n).astype(np.int32)
        spans = {}
        for k, a, b in sorted(zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)):
            spans.setdefault(k, []).append((a, b))
        got = list(zip(*(x.tolist() for x in suffix_dedup._joined(row, start, stop)), strict=True))
        assert got == [(k, a, b) for k in sorted(spans) for a, b in suffix_dedup.merged(spans[k])]


def test_strip_repeats_keeps_characters(spark):
    out = suffix_dedup.strip_repeats(frame(spark, odd_texts()))
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (1, None) in got and (4, "a") in got and (71, "") in got


@pytest.mark.parametrize("length", [1, 5, 8, 11, 30])
def test_suffix_family(length):
    """Batches of strings get arrays in byte order, and every string that any batch repeats is marked."""
    rng = np.random.default_rng(length)
    for _ in range(8):
        family, flat = suffix_dedup.SuffixFamily(length), []
        for n in rng.integers(0, 60, 9):
            buf = rng.integers(97, 99, n + length).astype(np.uint8)
            at = np.sort(rng.choice(n + 1, rng.integers(0, n + 1), replace=False))
            family.add(buf, at)
            flat += [buf[i : i + length].tobytes() for i in at]
        assert family.repeated[: family.size].tolist() == [flat.count(x) > 1 for x in flat]
        assert len(family.levels) <= 1 + np.log2(1 + family.size)
        for buf, at, _ in family.levels:
            strings = [buf[i : i + length].tobytes() for i in at]
            assert strings == sorted(set(strings))


def test_suffix_family_goes_by_bytes(monkeypatch):
    """Equal fingerprints of different strings don't make a repeat."""
    monkeypatch.setattr(suffix_dedup, "span_hash", lambda sums, start, end: np.zeros(len(start), np.uint64))
    family = suffix_dedup.SuffixFamily(12)
    family.add(np.frombuffer(b"abcdefghijklXbcdefghijklabcdefghijkl", np.uint8), np.array([0, 12, 24]))
    assert family.repeated[:3].tolist() == [True, False, True]


def test_suffix_dedup_in_pieces(spark, monkeypatch):
    """A text above two chunks is worked on in pieces; strings of 1,024 bytes and more don't collide by the hash's algebra."""
    rng = random.Random(3)
    part = "".join(rng.choice("abcd ") for _ in range(700))
    long = "".join(rng.choice("abcdefgh ") for _ in range(5_000_000))
    x, y = thue_morse(2048)
    texts = [(1, long[:3_799_900] + part + long[3_799_900:] + part), (2, "zz" + part), (3, x), (4, y)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.report(frame(spark, texts[:2], False)).collect()}
    assert got[1] == (1400, 2) and got[2] == (700, 1)
    same(suffix_dedup.report(frame(spark, texts[2:], False), length=2048), brute.repeats(texts[2:], 2048))


def test_decontamination(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    same(queries.op4_benchmark_decontamination(spark, SF), brute.contamination(documents, items))


def odd_items():
    return [(1, "one two"), (2, "One, TWO three"), (3, None), (4, "..."), (10, " ".join(f"w{k}" for k in range(15))), (None, "null item"), (9, "one two"), (11, "é漢 w1")]


def test_decontamination_edges(spark, monkeypatch):
    texts = [(1, "zero one TWO. three! one two"), (2, None), (3, ""), (4, " ".join(f"W{k}" for k in range(30))), (5, "w1 " + " ".join(f"w{k}" for k in range(3, 13))), (None, "null item é漢 W1"), (6, "one"), (6, "one two"), (7, "two " * 5000 + "one two")]
    want = brute.contamination(texts, odd_items())
    bench = spark.createDataFrame(odd_items(), "item_id long, text string").withColumn("doc_id", F.lit(1))

    def got(docs):
        f = decontaminate.find_contamination(docs, bench, keep=["doc_id"])
        return [(r[0], r["n_words"], sum(s["last_word"] - s["first_word"] for s in r["spans"]), len(r["items"]), decontaminate.digest_items(r["items"]), bool(r["spans"])) for r in f.collect()]

    assert sorted(got(frame(spark, texts)), key=repr) == sorted(want, key=repr)
    clash = frame(spark, texts).withColumns({"spans": F.lit(1), "items": F.lit("x"), "n_words": F.lit(0)})
    assert sorted(got(clash), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 40)  # several blocks of items
    assert sorted(got(frame(spark, texts)), key=repr) == sorted(want, key=repr)
    assert got(frame(spark, [])) == []
    none = decontaminate.find_contamination(frame(spark, texts), bench.limit(0), keep=["doc_id"])
    assert all(not r["spans"] and not r["items"] for r in none.collect())


def test_decontamination_long_words_and_texts(spark):
    """Words of 2,048 letters that a polynomial hash confuses; hits at the ends of neighbouring documents; a text above several token blocks."""
    x, y = thue_morse(2048)
    items = [(1, f"{x} one"), (2, "end of it"), (3, " ".join(f"q{k}" for k in range(12)))]
    texts = [(1, f"a {y} one"), (2, f"a {x} one"), (3, "the end of it"), (4, "end of it"), (5, "end of it end of it"), (6, "word " * 700_000 + " ".join(f"q{k}" for k in range(12)) + " tail")]
    found = decontaminate.find_contamination(frame(spark, texts, False).coalesce(1), spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id"])
    got = [(r[0], r["n_words"], sum(s["last_word"] - s["first_word"] for s in r["spans"]), len(r["items"]), decontaminate.digest_items(r["items"]), bool(r["spans"])) for r in found.collect()]
    assert sorted(got) == sorted(brute.contamination(texts, items))


def test_strip_spans(spark):
    texts = [(1, "zero one two! three"), (2, None), (3, "nothing here")]
    found = decontaminate.find_contamination(frame(spark, texts, False), spark.createDataFrame([(1, "one two")], "item_id long, text string"))
    out = decontaminate.strip_spans(found)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "zero ! three", 2: None, 3: "nothing here"}


def test_fm_index():
    rng = np.random.default_rng(2)
    for n in (1, 5, 300):
        text = rng.integers(0, 4, n)
        index = decontaminate.FMIndex(text, 4)
        patterns = rng.integers(1, 4, (20, 3))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(n - 2) if (text[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    values = np.array([2, 2, 2, 2, 1, 2, 2, 2, 2, 1, 0])
    assert decontaminate.suffix_array(values).tolist() == sorted(range(11), key=lambda i: values[i:].tolist())


def test_language_id(spark):
    out = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_id_against_plain_convolution(spark, documents):
    """Labels and scores are those of the trained network's definition, over whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    texts = documents[::8] + [(i, t) for i, t in odd_texts() if i != 80] + [(i + 1000, (t or "").upper()) for i, t in documents[:3]] + [(91, "ÀÉ×ß " * 70), (92, "1234 " * 60 + "ab")]
    for r in language_id.predict(frame(spark, texts), model).collect():
        label, score = brute.language(model, r["text"])
        assert r["lang_pred"] == label and abs(r["score"] - score) < 1e-4, r["doc_id"]


def test_language_id_learns_from_distinct_texts(spark):
    """A label whose rows are mostly copies of one text is learned like others; clashing columns are replaced."""
    rng = random.Random(2)
    words = {"en": "the of and to in that was with for this house water river".split(), "fr": "le les des une dans que pour avec cette maison rivière être où".split()}
    text = lambda k: " ".join(rng.choice(words[k]) for _ in range(40))
    common = text("fr")
    data = [(i, text("en"), "en") for i in range(1500)] + [(5000 + i, common, "fr") for i in range(1500)] + [(9000 + i, text("fr"), "fr") for i in range(30)]
    docs = spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in data], DOCS).withColumns({"lang_pred": F.lit("x"), "score": F.lit("y"), "h": F.lit(0), "label": F.lit("z"), "n": F.lit(1)})
    got = language_id.predict(docs, language_id.fit(docs)).select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.99


def test_language_id_edges(spark):
    docs = spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, "s", 0) for i, t in odd_texts()], DOCS)
    model = language_id.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).where("doc_id is not null").collect()}
    assert got[1] == got[2] == got[3] == got[71] == "und" and got[4] == got[80] == "en"
    assert language_id.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def test_language_model(spark, documents):
    check_scores(queries.op8_lm_scoring(spark, SF), documents)
    docs = frame(spark, odd_texts()).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
    model, counts = ngram_lm.fit(docs.where("not held_out"))
    check_scores(ngram_lm.score(docs, model, counts), odd_texts())
    model, counts = ngram_lm.fit(docs.limit(0))
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in ngram_lm.score(docs, model, counts).collect())


def check_scores(got, texts):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(map(tuple, got.collect()), key=key)
    want = sorted(brute.base_scores(texts), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])
    assert all(np.isfinite(r[6]) and r[6] < 0 for r in got)


def test_language_model_rare_words_are_joined(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_lm, "HOT_WORDS", 20)
    check_scores(queries.op8_lm_scoring(spark, SF), documents)


def test_language_model_predicts_held_out_text_better_than_the_base(spark):
    r = queries.op8_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_language_model_counts_are_exact_at_any_size(spark, monkeypatch):
    """Scores equal those of plain counts, also where a filter of few bits would answer `maybe` to most of them."""
    from lexiweave.llm import filters

    monkeypatch.setattr(filters, "MAX_BITS", 1 << 13)
    monkeypatch.setattr(filters.build_filter, "__defaults__", (1 << 13,))
    rng = random.Random(9)
    texts = [(k, " ".join(rng.choice("abcdefgh") + str(int(rng.paretovariate(0.7)) % 900) for _ in range(rng.randint(0, 120)))) for k in range(300)]
    docs = frame(spark, texts, extra=False).withColumn("held_out", F.col("doc_id") % 5 == 0)
    model, counts = ngram_lm.fit(docs.where("not held_out"))
    want = brute_scores([t for k, t in texts if k % 5], dict(texts))
    for scored in (ngram_lm.score(docs, model, counts), ngram_lm.score_held_out(docs)):
        got = {r["doc_id"]: r["score"] for r in scored.collect()}
        assert got.keys() == want.keys()
        assert np.allclose([got[k] for k in want], list(want.values()))


def test_language_model_counts_what_was_seen_once(spark):
    texts = [(1, "twice here twice here"), (2, "once upon"), (3, "once upon"), (4, "never heard")]
    docs = frame(spark, texts, extra=False).withColumn("held_out", F.col("doc_id") > 2)
    model, counts = ngram_lm.fit(docs.where("not held_out"))
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, model, counts).collect()}
    want = brute_scores([t for k, t in texts if k <= 2], dict(texts))
    assert np.allclose([got[k] for k in want], list(want.values()))
    assert got[3] > got[4]


def test_language_model_odd_rows(spark):
    """A null held_out isn't learned from; null, empty and repeated texts and ids are scored, clashing columns not read."""
    texts = [(1, "a b a"), (1, "a b a"), (2, None), (3, ""), (None, "b c"), (4, "never seen")]
    docs = frame(spark, texts).withColumn("held_out", F.when(F.col("doc_id") == 4, F.lit(None)).otherwise(F.lit(False))).withColumns({"score": F.lit("x"), "n_tokens": F.lit("y"), "block": F.lit(0)})
    got = ngram_lm.score_held_out(docs).collect()
    want = brute_scores([t or "" for k, t in texts if k != 4], {k: t or "" for k, t in texts})
    assert len(got) == len(texts) and all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in got)
    assert {r["n_known"] for r in got if r["doc_id"] == 4} == {1}
    assert ngram_lm.score_held_out(docs.limit(0)).count() == 0
    alone = ngram_lm.score_held_out(docs.where("held_out is null")).first()
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"]) == (0, 0, 0.0)


def brute_scores(training, texts):
    """Interpolated scores from counts in dictionaries."""
    words, pairs = Counter(), Counter()
    for t in training:
        tokens = [*t.split(), "</s>"]
        words.update(tokens)
        pairs.update(zip(["<s>", *tokens], tokens, strict=False))
    scale = sum(words.values()) + len(words) + 1
    out = {}
    for k, t in texts.items():
        tokens = [*t.split(), "</s>"]
        out[k] = 0.0
        for a, b in zip(["<s>", *tokens], tokens, strict=False):
            history = len(training) if a == "<s>" else max(1, words[a])
            out[k] += math.log10(0.4 * min(1.0, pairs[a, b] / history) + 0.6 * (words[b] + 1) / scale)
    return out


def test_levels():
    keys = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    from lexiweave.llm.filters import KeyFilter, segment

    held = np.concatenate([ngram_lm.level_key(keys[q:], q) for q in range(1, 12)])
    f = KeyFilter(1, 1 << 20, np.frombuffer(segment(held, 1 << 20), np.uint8))
    assert ngram_lm.probe_levels(f, keys).tolist() == [min(k, 11) for k in range(199)]


def test_embeddings(spark):
    table = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(queries.op9_embedding_near_dedup(spark, SF), brute.near_vectors(table))


def odd_vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    near = [(100 + k, (base[k % 6] + rng.normal(size=8) * 0.12).tolist(), k % 2) for k in range(90)]
    odd = [(1, None, 0), (2, [0.0] * 8, 0), (3, [1.0, None] * 4, 0), (4, [float("nan")] * 8, 0), (5, [float("inf")] * 8, 0), (6, [], 0), (7, [1.0] * 8, None), (8, [1.0] * 4, 0), (9, [2.0] * 4, 0)]
    return near + odd + [(200, [3.0] * 8, 1), (200, [3.0] * 8, 1), (None, [3.0] * 8, 1), (201, [1e-30] * 8, 1), (202, [-3.0] * 8, 1), (None, None, 1), (2**62 + 5, [5.0, 1.0] * 4, 1), (2**63 - 1, [5.0, 1.0] * 4, 1), (-(2**63), [9.0, 1.8] * 4, 1)]


def test_embedding_edges(spark, monkeypatch):
    df = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>, label int").withColumns({"ok": F.lit(1), "k1": F.lit(2), "c": F.lit(3)})
    table = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    same(embedding_dedup.near_duplicates(df), brute.near_vectors(table))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    monkeypatch.setattr(embedding_dedup, "LEAF", 3)
    same(embedding_dedup.near_duplicates(df), brute.near_vectors(table))
    assert rows(embedding_dedup.near_duplicates(df.limit(0))) == []


def test_sentencepiece(spark):
    texts = odd_texts() + [(90, "literal ▁ mark"), (91, "  two  spaces "), (92, "tab\tnul\x00end"), (93, "a" * 5000)]
    df = frame(spark, texts)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(df))
    assert out.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert out.where("text is null and piece_ids is null").count() == 1 and out.where("text = '' and size(piece_ids) = 0").count() == 1
    one = {(r["doc_id"], r["text"]): r["piece_ids"] for r in sentencepiece_codec.encode(df).collect()}
    two = {(r["doc_id"], r["text"]): r["piece_ids"] for r in sentencepiece_codec.encode(df.repartition(7, "text")).collect()}
    other = {(r["doc_id"], r["text"]): r["piece_ids"] for r in sentencepiece_codec.encode(df, seed=1).collect()}
    assert one == two and one != other
    assert sentencepiece_codec.encode(df.limit(0)).count() == 0
    whole = {(r["doc_id"], r["text"]): r for r in sentencepiece_codec.round_trip(df).collect()}
    assert all(r["piece_ids"] == one[k] and r["decoded"] == k[1] for k, r in whole.items()) and len(whole) == len(one)
    assert queries.op3_sentencepiece(spark, SF).where("not lossless").count() == 0


def test_sampling_follows_the_lattice():
    """Drawn segmentations of one unit come as often as their weights say."""
    p = sentencepiece_codec.load(sentencepiece_codec.MODEL, 1.0)
    keys = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    text = b"then"
    ids, offsets = sentencepiece_codec.encode_texts([text] * len(keys), keys, p, 0)
    seen = {}
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        k = tuple(ids[a:b].tolist())
        seen[k] = seen.get(k, 0) + 1
    weight = {k: np.exp(sum(p.weight[i] for i in k)) for k in seen}
    total = sum(weight.values())
    for k, n in seen.items():
        if n > 400:
            assert abs(n / len(keys) - weight[k] / total) < 0.03


def test_sentencepiece_against_plain_lattices(spark, documents):
    """Whole texts: the ids of every document and odd text are those that node by node sampling draws; unit by unit their shares add up to those of all paths."""
    plain = brute.Segmenter(sentencepiece_codec.MODEL)
    texts = documents + odd_texts()[:30] + [(95, "    indented\n\n        twice  "), (96, "  "), (97, " " * 200 + "x"), (98, "é" * 60), (99, "漢字😀" * 20), (100, None)]
    df = frame(spark, texts)
    keys = {r["doc_id"]: r["k"] for r in df.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    for r in sentencepiece_codec.encode(df).collect():
        if r["text"] is not None:
            assert r["piece_ids"] == plain.sample(r["text"].encode(), keys[r["doc_id"]] & brute.MASK), r["doc_id"]
    p, text, draws = sentencepiece_codec.load(sentencepiece_codec.MODEL, 1.0), "the  cat", 20000
    want = {(): 1.0}
    for u in plain.units(text.encode()):
        want = {a + b: x * y for a, x in want.items() for b, y in plain.paths(u).items()}
    assert abs(sum(want.values()) - 1) < 1e-9
    ids, cuts = sentencepiece_codec.encode_texts([text.encode()] * draws, np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), p, 0)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    assert set(seen) <= set(want)
    assert all(abs(seen[k] - draws * q) < 6 * math.sqrt(draws * q) + 6 for k, q in want.items())


def test_sentencepiece_replaces_clashing_columns_and_keeps_repeated_rows(spark):
    df = frame(spark, [(1, "a  b"), (1, "a  b"), (None, "c"), (2, None)]).withColumns({"piece_ids": F.lit("x"), "decoded": F.lit(0)})
    got = sentencepiece_codec.round_trip(df)
    assert got.count() == 4 and got.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert len({tuple(r["piece_ids"]) for r in got.where("doc_id = 1").collect()}) == 1


def test_runs_of_spaces_are_drawn_as_pieces():
    """Pieces of several spaces take part: their draws aren't empty, and a text of another row's spaces doesn't run into the next."""
    p = sentencepiece_codec.load(sentencepiece_codec.MODEL, 1.0)
    n = 3000
    ids, cuts = sentencepiece_codec.encode_texts([b"x    y ", b" z"] * n, np.arange(2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), p, 0)
    wide = {i for i, b in enumerate(p.bytes) if len(b) > 1 and not b.strip(b" ")}
    assert wide and wide & set(ids.tolist())
    whole = [b"".join(p.bytes[i] for i in ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert set(whole[::2]) == {b" x    y "} and set(whole[1::2]) == {b"  z"}


def test_url_filter(spark):
    rules = url_filters.rules_table(spark, queries.URL_RULES)
    urls = ["http://EXAMPLE.org/es/x", "https://a.example.org/en/12?q", "http://example.org/en", "http://notexample.org/es/", "http://x.com/fr/", "http://com/de/1", "http://x.net/", "no scheme", "http://org", "http://org/", "ftp://u@x.org:80/a", "http:///p", "://a.org/b#c/://d", None, None]
    df = spark.createDataFrame([(None if k == 3 else k // 2, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_filter(df, rules).collect()}
    assert (0, "example.org", "/es/x", "example.org/es/", "block") in got and (0, "a.example.org", "/en/12", "example.org/en/1", "block") in got
    assert (1, "example.org", "/en", "org/", "allow") in got and (None, "notexample.org", "/es/", "org/", "allow") in got
    assert (2, "x.com", "/fr/", "com/fr/", "allow") in got and (2, "com", "/de/1", "com/de/", "block") in got
    assert (4, "org", "", None, "allow") in got and (6, "a.org", "/b", "org/", "allow") in got and (7, "", "", None, "allow") in got
    assert url_filters.url_filter(df, rules).count() == len(urls)
    twice = df.union(df)
    assert url_filters.url_filter(twice, rules).count() == 2 * len(urls)
    assert {r["verdict"] for r in url_filters.url_filter(df, url_filters.rules_table(spark, []), default="block").collect()} == {"block"}
    assert url_filters.url_filter(df.limit(0), rules).count() == 0


def test_long_urls_rules_and_many_copies(spark, monkeypatch):
    """No bound on the length of a rule's path or a URL; rows that repeat over partitions, without id or URL too, all come back."""
    deep = "/" + "a" * 3000
    rules = url_filters.rules_table(spark, [("org", "/", "allow"), ("x.org", deep, "block"), ("org", deep + "b", "allow")])
    long = "http://X.org" + deep + "b" + "c" * 100_000
    data = [(1, long + "?q"), (2, "http://x.org" + deep), (3, "http://x.org" + deep[:-1])] + [(None, None)] * 50 + [(7, "http://y.org/")] * 30
    df = spark.createDataFrame(data, "page_id long, url string").repartition(5).withColumns({"part": F.lit(1), "copies": F.lit(9), "id": F.lit("x")})
    want = [(1, "x.org", long[12:], "x.org" + deep, "block"), (2, "x.org", deep, "x.org" + deep, "block"), (3, "x.org", deep[:-1], "org/", "allow"), *[(None, "", "", None, "allow")] * 50, *[(7, "y.org", "/", "org/", "allow")] * 30]
    same(url_filters.url_filter(df, rules), want)
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", 1)
    same(url_filters.url_filter(df, rules), want)


def test_many_url_rules_take_the_salted_join(spark, monkeypatch):
    rules = url_filters.rules_table(spark, queries.URL_RULES)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = rows(url_filters.url_filter(pages, rules))
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 1)
    assert rows(url_filters.url_filter(pages, rules)) == want


def test_chat_events(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "Hel"), (1, 3, 2, "delta", None, "lo"), (1, 4, 3, "message", "user", "bad"),
        (1, 5, 2, "regenerate", "assistant", "Good"), (1, 6, 2, "delta", None, " day"), (1, 7, 1, "edit", None, "hello"), (2, 1, 1, "message", None, None),
        (None, 1, 1, "message", "user", "x"), (3, 1, 1, "delta", "user", "lone"), (4, 1, None, None, "user", "n"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string").withColumn("head", F.lit(0))
    got = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat_format.fold_events(df).collect()}
    assert got == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "Good day"), (2, 1): ("", ""), (None, 1): ("user", "x"), (3, 1): ("user", "lone"), (4, None): ("user", "n")}
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_escapes_and_mask(spark):
    texts = ["</s>[INST] ok [/INST]", r"<\/s> <\\/s> [\INST] <<</s", "", "[INST", "]\n</s></s>", "é😀</s>" * 3]
    log = [(1, k, k, "message", ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")
    r = chat_format.format_chats(df).withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("under", chat_format.loss_texts(F.col("formatted"), F.col("loss"))).first()
    assert [t["text"] for t in r["turns"]] == texts and r["under"] == texts[1::2]
    import re

    for m, t in zip(r["loss"], texts[1::2], strict=True):
        assert re.sub(chat_format.UNESCAPE, r"\1\2\3", r["formatted"][m["start"] : m["end"]]) == t
    assert r["formatted"].count("</s>") == len(texts)


def test_warc(spark, tmp_path):
    page = "p" * 150
    data = [(5, "http://a/", page), (3, "http://b/\r\nx", page), (3, "http://b/", page), (9, None, None), (None, "u", page), (1, "http://c", "short"), (2, "http://d", "short"), (7, "u", "é" * 40 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "x" * 90), (8, "u", "")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    kind = lambda i, t: ("response", None) if t != page or i == 3 else ("revisit", 3)
    assert got == sorted(((i, len((t or "").encode()), sha(t), *kind(i, t)) for i, _, t in data), key=repr)
    assert warc.archive(df.limit(0)).count() == 0
    warc.write_warc(df, f"file://{tmp_path}/w")
    payload = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_warc(spark, f"file://{tmp_path}/w").where("record_type = 'response'").collect()}
    assert payload[7] == data[7][2] and payload[3] == page


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    """Long payloads spread over files; one above the bound has its own; columns with clashing names and payloads that end in line ends do no harm."""
    rng = random.Random(8)
    data = [(k, f"u{k}", "".join(rng.choice("ab\r\n") for _ in range(rng.randint(0, 3000))) + "\r\n" * (k % 3)) for k in range(60)] + [(60, "big", "x" * 200_000), (61, "big", "x" * 200_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3).withColumns({"id": F.lit(1), "digest": F.lit("d"), "size": F.lit(0), "g": F.lit(""), "payload": F.lit("p"), "value": F.lit(1)})
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path, file_bytes=20_000)
    files = spark.read.format("binaryFile").load(path).select("length").where("length > 0").collect()
    assert len(files) > 5 and sorted(r[0] for r in files)[-2] < 25_000
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"], bytes(r["payload"]).decode()) for r in warc.read_warc(spark, path).collect()}
    assert got == {k: ("revisit", 200_000, "") if k == 61 else ("response", len(t), t) for k, _, t in data}


def test_warc_candidates_in_linear_time():
    for hostile in (b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 1\r\n", b"WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n", b"\r\n"):
        payload = hostile * 200_000
        data = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(payload), payload)
        at, to = warc.candidates(data)
        assert at[warc.reachable(at, to, len(data))].tolist() == [0]


def test_warc_chain():
    record = b"WARC/1.1\r\nContent-Length: 12\r\n\r\nWARC/1.1\r\nab\r\n\r\n"
    at, to = warc.candidates(record * 3)
    keep = warc.reachable(at, to, len(record) * 3)
    assert at[keep].tolist() == [0, len(record), 2 * len(record)] and len(at) == 6
    with pytest.raises(ValueError):
        warc.reachable(at, to, len(record) * 3 + 1)
    with pytest.raises(ValueError):
        warc.reachable(*warc.candidates(b"x" + record), len(record) + 1)


def test_chat_query_over_odd_rows(spark, tmp_path):
    """Ties of a turn, repeated rows, null texts, roles and ids, a very long text, extra columns: what is read back equals the rows."""
    data = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "assistant", "a"), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, 0, None, "x</s>"), (2, 1, "assistant", "y" * 300_000 + "é😀"), (3, None, "assistant", "z"), (None, 1, "user", "n")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "kind": F.lit("delta"), "msg": F.lit("m")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op5_chat_formatting(spark, f"file://{tmp_path}").collect()}
    probe = [(-1, 0, "user", queries.PROBE_TEXT), (-1, 1, "assistant", queries.PROBE_TEXT)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in (1, 2, 3, None, -1):
        key = lambda r: ((r[1] is not None, r[1]), (r[2] is not None, r[2]), (r[3] is not None, r[3]))
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in data + probe if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got.pop(conv)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), sha(loss))
    assert not got
