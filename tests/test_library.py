import bz2
import gzip
import io
import json
import tarfile
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiweave import file_catalog
from lexiweave.codecs import dictionary, registry
from lexiweave.codecs.dictionary import PairConfig, PairTokens, SymbolTable
from lexiweave.functions import bitvector as bv
from lexiweave.functions import strings as S
from lexiweave.operators import engine, etl, layout, profile, report
from lexiweave.plans import suite
from lexiweave.sources import archives, json_array, one_file, results
from lexiweave.streaming.encode import decode_stream, encode_stream

FIXTURES = {
    "empty": [],
    "single_empty": [b""],
    "empties_mixed": [b"", b"a", b"", b"bb", b""],
    "exact_64k": [b"x" * 65535, b"y", b"z"],
    "oversize_first": [b"q" * 70000, b"a", b"b"],
    "oversize_middle": [b"a", b"q" * 70000, b"b"],
    "identical": [b"same string"] * 300,
    "incompressible": [np.random.default_rng(k).integers(0, 256, 50 * k, dtype=np.uint8).tobytes() for k in range(12)] + [b"\x00\xff\x00", b"\xff"],
}


def frame(spark, values):
    return spark.createDataFrame([(3 * k, v) for k, v in enumerate(values)], "id long, value binary").repartition(3)


def greedy(values, limit):
    ids, size, block = [], 0, -1
    for v in values:
        if block < 0 or size + len(v) > limit:
            block, size = block + 1, 0
        ids.append(block)
        size += len(v)
    return ids


@pytest.mark.parametrize("name", FIXTURES)
def test_offsets_and_blocks(spark, name):
    values = FIXTURES[name]
    off = layout.with_offsets(frame(spark, values), bucket=5)
    ends = np.cumsum([len(v) for v in values]).tolist()
    assert [tuple(r) for r in off.orderBy("pos").select("pos", "start", "end").collect()] == [(k, e - len(v), e) for k, (v, e) in enumerate(zip(values, ends, strict=True))]
    for limit in (1, 3, 40, layout.BLOCK):
        assert [r["block_id"] for r in layout.block_ids(off, limit).orderBy("pos").collect()] == greedy(values, limit)


@pytest.mark.parametrize("key", registry.CODECS)
def test_codecs(spark, key):
    for name, values in FIXTURES.items():
        off = layout.with_offsets(frame(spark, values))
        encoded = engine.compress(off, key)
        assert [bytes(r["value"]) for r in engine.decompress(encoded).orderBy("pos").collect()] == values, name
    asked = spark.createDataFrame([(0, 3), (1, 0), (2, 3), (3, 99)], "qid long, idx long")
    assert {(r["qid"], bytes(r["value"])) for r in engine.lookup(encoded, asked).collect()} == {(0, values[3]), (1, values[0]), (2, values[3])}
    assert engine.space(encoded).first()["raw_bytes"] == sum(map(len, values))


def test_dictionaries():
    words = [b"compress", b"compression", b"", b"press\xff\x00", bytes(range(256))] * 40
    for table in (SymbolTable.train(words), PairTokens.train(words)):
        assert all(table.decode(table.encode(w)) == w for w in [*words, b"unseen \xfe", b"\xff\xff"])
    assert len(SymbolTable.train(words).encode(b"compression")) <= 4
    assert SymbolTable.train([]).decode(SymbolTable.train([]).encode(b"ab")) == b"ab"


def test_greedy_matches(monkeypatch):
    """Against a plain loop, with windows and segments so small that every seam occurs."""
    rng = np.random.default_rng(5)
    words = [b"".join(rng.choice([b"ab", b"abc", b"c", b"\xff", b"bca", b"\x00"], k).tolist()) for k in rng.integers(0, 90, 60)]
    for table in (SymbolTable.train(words[:9]), PairTokens.train(words[:30])):
        known = {s: k for k, s in enumerate(getattr(table, "tokens", None) or table.symbols)}
        for window, segment in ((1 << 22, 128), (64, 7), (5, 3)):
            monkeypatch.setattr(dictionary, "WINDOW", window)
            monkeypatch.setattr(dictionary, "SEGMENT", segment)
            places, codes, before = table.matcher.tokens(*dictionary.parts(pa.array(words, pa.binary())))
            want, base, counts = [], 0, [0]
            for w in words:
                i = 0
                while i < len(w):
                    m = next((m for m in range(min(16, len(w) - i), 0, -1) if w[i : i + m] in known), 0)
                    want.append((base + i, known[w[i : i + m]] if m else -1))
                    i += max(m, 1)
                base += len(w)
                counts.append(len(want))
            assert list(zip(places.tolist(), codes.tolist(), strict=True)) == want and before.tolist() == counts
        coded = table.encode_all(pa.array(words, pa.binary()))
        assert table.decode_all(coded.slice(3, 9), np.array([len(w) for w in words[3:12]])).to_pylist() == words[3:12]
        with pytest.raises(ValueError):
            table.decode_all(coded, np.array([len(w) + 1 for w in words]))


def test_pair_config():
    words = [b"compress", b"compression", b"press"] * 400
    few = PairTokens.train(words, PairConfig(bits=9, count=2))
    assert len(few.tokens) <= 512 and few.decode(few.encode(b"compressions")) == b"compressions"
    assert len(PairTokens.train(words, PairConfig(dynamic=0.15)).tokens) > 256
    for bad in ({"bits": 17}, {"count": 0}, {"dynamic": 0.0}):
        with pytest.raises(ValueError):
            PairConfig(**bad)


@pytest.mark.parametrize("key", ["zstd", "fsst", "fsst_block", "onpair"])
def test_stored_encoding(spark, tmp_path, monkeypatch, key):
    monkeypatch.setattr(engine, "SPAN", 40)
    values = [b"value %d" % (k * k) for k in range(200)]
    engine.store(engine.compress(layout.with_offsets(frame(spark, values)), key), f"{tmp_path}/e")
    stored = engine.load(spark, f"{tmp_path}/e")
    assert [bytes(r["value"]) for r in engine.decompress(stored).orderBy("pos").collect()] == values
    found = engine.lookup(stored, spark.createDataFrame([(0, 3), (1, 170), (2, 999)], "qid long, idx long"))
    assert {(r["qid"], bytes(r["value"])) for r in found.collect()} == {(0, values[3]), (1, values[170])}


def test_sparse_ids(spark):
    ids = sorted({int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300)} | set(range(50)) | {2**62, 2**62 + 1, 2**63 - 1})
    df = spark.createDataFrame([(k, "x" * (k % 7)) for k in ids], "id long, value string").repartition(3)
    off = layout.with_offsets(df, bucket=20)
    got = off.orderBy("pos").collect()
    ends = np.cumsum([k % 7 for k in ids]).tolist()
    assert [(r["id"], r["pos"], r["end"]) for r in got] == [(k, n, e) for n, (k, e) in enumerate(zip(ids, ends, strict=True))]
    assert len({r["bucket"] for r in got}) > 5
    assert [r["block_id"] for r in layout.block_ids(off, 40).orderBy("pos").collect()] == greedy([b"x" * (k % 7) for k in ids], 40)
    with pytest.raises(Exception, match="which orders the collection"):
        layout.with_offsets(spark.createDataFrame([(1, "a"), (None, "b")], "id long, value string")).collect()


def test_registry():
    assert len(registry.CODECS) == 11
    with pytest.raises(ValueError):
        registry.find("nope")
    with pytest.raises(ValueError):
        registry.register(registry.find("raw"))


def test_json_arrays(spark, tmp_path):
    good = {"a.json": ["x\n\"y\"", "é", "", "\U0001f600"], "b.json": []}
    for name, v in good.items():
        (tmp_path / name).write_text(json.dumps(v))
    (tmp_path / "note.txt").write_text("no")
    got = json_array.read_json_array(spark, f"{tmp_path}/*.json").orderBy("file", "id").collect()
    assert [(r["file"], r["id"], r["value"]) for r in got] == [("a.json", k, v) for k, v in enumerate(good["a.json"])]
    assert [r["name"] for r in json_array.list_datasets(spark, str(tmp_path)).collect()] == ["a.json", "b.json"]
    for k, bad in enumerate(('["a", null]', '["a", 1]', '{"a": 1}', '["a"', '["a", ["b"]]', "3")):
        (tmp_path / f"bad{k}.jsonx").write_text(bad)
        with pytest.raises(Exception, match="not an array of strings"):
            json_array.read_json_array(spark, f"{tmp_path}/bad{k}.jsonx").collect()
        assert json_array.read_json_array(spark, f"{tmp_path}/bad{k}.jsonx", "skip").count() == 0
    json_array.write_json_array(spark.createDataFrame([(1, "b"), (0, 'a"')], "id long, value string"), f"{tmp_path}/out")
    json_array.write_json_array(spark.createDataFrame([(1, "other")], "id long, value string"), f"{tmp_path}/out", mode="ignore")
    (part,) = (tmp_path / "out").glob("part-*")
    assert json.loads(part.read_text()) == ['a"', "b"]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "q.tar.gz", "w:gz") as tar:
        for name, text in (("x/a.tsv", "1\tone\n2\ttwo\n"), ("b.txt", "no\n"), ("c.tsv", "3\tthree")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    got = archives.read_tar_lines(spark, f"{tmp_path}/q.tar.gz").orderBy("member", "line").collect()
    assert [r["value"] for r in got] == ["3\tthree", "1\tone", "2\ttwo"]
    (tmp_path / "l.bz2").write_bytes(bz2.compress(b"c\nd"))
    assert [r["value"] for r in archives.read_lines(spark, f"{tmp_path}/l.bz2").collect()] == ["c", "d"]
    (tmp_path / "l.gz").write_bytes(gzip.compress(b"a\n\nb\n"))
    assert [r["value"] for r in archives.read_lines(spark, f"{tmp_path}/l.gz").collect()] == ["a", "", "b"]


def test_results(spark, tmp_path):
    assert results.read_results(spark, f"{tmp_path}/none.json").count() == 0
    row = ("d.json", "Raw", 1.23456789, float("inf"), 2.0, 7)
    df = spark.createDataFrame([row], results.SCHEMA)
    results.append_results(df, f"{tmp_path}/log")
    results.append_results(df, f"{tmp_path}/log")
    log = results.read_results(spark, f"{tmp_path}/log")
    assert [tuple(r) for r in log.collect()] == [("d.json", "Raw", 1.23457, None, 2.0, 7)] * 2
    results.export_results(log, f"{tmp_path}/export")
    assert results.read_results(spark, f"{tmp_path}/export").count() == 2
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        results.read_results(spark, f"{tmp_path}/bad.json").collect()


def test_reports_are_means_of_means(spark):
    rows = [("a", "X", 1.0, 1.0, 1.0, 1), ("a", "X", 2.0, 1.0, 1.0, 2), ("b", "X", 6.0, 1.0, 1.0, 4)]
    df = spark.createDataFrame(rows, results.SCHEMA)
    full = report.full(df)
    assert [(r["dataset_name"], r["compression_rate"], r["average_random_access_time"]) for r in full.collect()] == [("a", 1.5, 1), ("b", 6.0, 4), ("AVERAGE", 3.75, 2)]
    assert "rate 3.750" in report.printed(full).where("dataset_name = 'AVERAGE'").first()["line"]


def values(df):
    return [r["value"] for r in df.collect()]


def test_etl(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string").coalesce(1)
    assert values(etl.second_column(lines("no", "1\t q ", "2\ta\tb", "3\t \x1c"))) == ["q", "a\tb"]
    assert values(etl.url_column(lines("D\thttp://a\tt\tb", "D\tftp://b", "D", "D\thttps://c "))) == ["http://a", "https://c "]
    assert values(etl.json_titles(lines('{"title": " a "}', "{}", '{"title": null}', '{"title": " "}', "{bad"))) == ["a"]
    ttl = lines("# c", " ", '<s> <p> ""@en .', r'<s> "a \"q\" b"@en .', '<s> "x"@en-GB .', "<s> <o> .", '"@en')
    assert values(etl.literals(ttl)) == ["", r"a \"q\" b", "x"]


def test_profile(spark):
    df = spark.createDataFrame([(v,) for v in ("é", "è", "abc", "abc", "abd", "")], "value string")
    r = profile.adjacent_prefixes(df).first()
    assert (r["lcp_sum"], r["pairs"]) == (3 + 2 + 1, 5)
    assert profile.adjacent_prefixes(df.limit(1)).first()["avg_lcp"] == 0
    assert profile.alphabet(df).first()["alphabet"] == 7
    assert tuple(profile.printed(df, "f").first()) == ("f", "6", "83.33%", "2.17 bytes", "7", "1.20 bytes")
    b = profile.basics(df).first()
    assert (b["n"], round(b["unique_pct"], 3)) == (6, 83.333)
    assert profile.basics(df.limit(0)).first()["avg_bytes"] is None
    assert df.select(S.common_prefix(F.lit("é"), F.lit("è")).alias("k")).first()["k"] == 1


def test_bitvector(spark):
    v = bv.append_bits(bv.push(bv.extend_ones(bv.zeroes(3), 2), False), 5, 3)  # 000 11 0 101
    got = spark.range(1).select(bv.length(v), bv.get(v, 3), bv.get(v, 99), bv.get_bits(v, 3, 6), bv.get_bits(v, 5, 9), bv.next_one(v, 3), bv.prev_one(v, 3), bv.positions(v), bv.get(bv.put(v, 0, True), 0), bv.is_empty(bv.empty()), bv.words(bv.ones(65))).first()
    assert tuple(got) == (9, True, None, 0b101011, None, 4, None, [3, 4, 6, 8], True, True, [-1, 1])


def test_suite(spark):
    assert suite.plan(spark, spark.createDataFrame([("a.json",)], "name string")).count() == 9
    df = frame(spark, [b"some text", b"some more text"] * 20)
    out = suite.run(spark, {"a.json": df}, codecs=("raw", "zstd"), iterations=1, queries=10).collect()
    assert [r["compressor_name"] for r in out] == ["Raw", "Zstd"] and out[0]["compression_rate"] == 1.0


def test_suite_over_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(["some text", "more", ""] * 9))
    (tmp_path / "in" / "b.json").write_text("[1, 2]")
    table, failed = suite.run_folder(spark, f"{tmp_path}/in", f"{tmp_path}/log", codecs=("raw",), iterations=2, queries=5)
    assert [(r["dataset_name"], r["compression_rate"]) for r in table.collect()] == [("a.json", 1.0), ("AVERAGE", 1.0)]
    assert results.read_results(spark, f"{tmp_path}/log").count() == 2
    assert [x[:3] for x in failed] == [("b.json", "raw", 0), ("b.json", "raw", 1)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "text"), (2, None)], "id long, value string").write.parquet(f"{tmp_path}/in")
    table = SymbolTable.train([b"text"] * 9)
    stream = spark.readStream.schema("id long, value string").parquet(f"{tmp_path}/in")
    query = encode_stream(stream, table).writeStream.format("memory").queryName("coded").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    got = {r["id"]: r["code"] for r in spark.table("coded").collect()}
    assert table.decode(bytes(got[1])) == b"text" and got[2] is None
    back = {r["id"]: r["value"] for r in decode_stream(spark.table("coded").select("id", "code"), table).collect()}
    assert bytes(back[1]) == b"text" and back[2] is None


def test_datasets_are_files(spark, tmp_path):
    odd = ['q"\n\\', "", None, "\u00e9", "[", ","]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, value string").repartition(4)
    folder = f"file://{tmp_path}/d"
    assert json_array.write_dataset(df, folder, "odd.json") and json.loads((tmp_path / "d/odd.json").read_text()) == odd
    with pytest.raises(FileExistsError):
        json_array.write_dataset(df, folder, "odd.json")
    assert not json_array.write_dataset(df.limit(0), folder, "odd.json", mode="ignore")
    assert json.loads((tmp_path / "d/odd.json").read_text()) == odd
    assert json_array.write_dataset(df.limit(0), folder, "odd.json", mode="overwrite") and json.loads((tmp_path / "d/odd.json").read_text()) == []
    assert [p.name for p in (tmp_path / "d").iterdir() if not p.name.startswith(".")] == ["odd.json"]
    with pytest.raises(ValueError):
        one_file.write_bytes(spark, b"", f"{folder}/x", mode="append")


def test_added_codecs_can_be_taken_out():
    with pytest.raises(ValueError):
        registry.unregister("raw")
    registry.register(registry.Codec("own", "Own", "string", bytes, lambda d, n: d))
    registry.unregister("own")
    assert len(registry.CODECS) == 11


@pytest.mark.parametrize("name", sorted(file_catalog.QUERIES))
def test_file_queries_against_sql(spark, name):
    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("no tables")
    db = duckdb.connect()
    for f in sf.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = file_catalog.QUERIES[name](spark, str(sf))
    want = db.execute(file_catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
