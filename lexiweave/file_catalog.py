"""Registered queries that go through files: sources, sinks, stored encodings, streams, suites. They write under scratch() and read back."""

from __future__ import annotations

import bz2
import io
import tarfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiweave import catalog
from lexiweave.codecs import registry
from lexiweave.codecs.dictionary import PairConfig, SymbolTable
from lexiweave.operators import engine, layout
from lexiweave.plans import suite
from lexiweave.session import scratch
from lexiweave.sources import archives, json_array, one_file, results
from lexiweave.streaming.encode import decode_stream, encode_stream

ODD = '\n"\\é'  # ends each nation's name, so that escapes are written and read


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(ODD)).alias("value"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("value"))


def _datasets(spark: SparkSession, sf_dir: str) -> str:
    """A folder with three datasets and a file that is none."""
    folder = scratch(spark, "datasets")
    json_array.write_dataset(_regions(spark, sf_dir), folder, "region.json")
    json_array.write_dataset(_nations(spark, sf_dir), folder, "nation.json")
    json_array.write_dataset(_nations(spark, sf_dir).limit(0), folder, "empty.json")
    one_file.write_lines(spark.range(1).select(F.lit("no").alias("value")), f"{folder}/note.txt")
    return folder


def source_json_arrays(spark, sf_dir):
    """The strings of a folder of datasets, written as arrays and read strictly."""
    return json_array.read_json_array(spark, f"{_datasets(spark, sf_dir)}/*.json")


def source_json_skip(spark, sf_dir):
    """As source_json_arrays, with malformed files in between that are skipped."""
    folder = _datasets(spark, sf_dir)
    for k, bad in enumerate(('["a", 1]', '{"a": 1}', '["a"', '["a", null]')):
        one_file.write_bytes(spark, bad.encode(), f"{folder}/bad{k}.json")
    return json_array.read_json_array(spark, f"{folder}/*.json", "skip")


def source_listing(spark, sf_dir):
    """The datasets of a folder by path, with their place and length."""
    listed = json_array.list_datasets(spark, _datasets(spark, sf_dir))
    return listed.select("name", "length", (F.row_number().over(Window.orderBy("path")) - 1).alias("place"))


def sink_modes(spark, sf_dir):
    """A dataset written, kept when it exists, and replaced: its strings after each step."""
    folder, out = scratch(spark, "modes"), []
    for step, (df, mode) in enumerate(((_regions, "errorifexists"), (_nations, "ignore"), (_nations, "overwrite"))):
        written = json_array.write_dataset(df(spark, sf_dir), folder, "d.json", mode=mode)
        now = json_array.read_json_array(spark, f"{folder}/d.json").select(F.lit(step).alias("step"), F.lit(written).alias("written"), "id", "value")
        path = scratch(spark, "step")
        now.write.parquet(path)
        out.append(spark.read.schema(now.schema).parquet(path))
    return reduce(DataFrame.unionByName, out)


def _lines(compression: str):
    def q(spark, sf_dir):
        path = scratch(spark, compression)
        rows = catalog.table(spark, sf_dir, "customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name").alias("value"))
        rows.write.option("compression", compression).text(path)
        return archives.read_lines(spark, path)

    return q


def source_tar_lines(spark, sf_dir):
    """Lines of an archive's .tsv members; nations by region and one member that isn't asked for. The archive's rows are those of nation, 25."""
    rows = catalog.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").orderBy("n_nationkey").collect()
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w:gz") as tar:
        for region in sorted({r["n_regionkey"] for r in rows}):
            for suffix in (".tsv", ".txt"):
                text = "".join(f"{r['n_nationkey']}\t{r['n_name']}\n" for r in rows if r["n_regionkey"] == region).encode()
                member = tarfile.TarInfo(f"nations/{region}{suffix}")
                member.size = len(text)
                tar.addfile(member, io.BytesIO(text))
    path = f"{scratch(spark, 'tar')}/nations.tar.gz"
    one_file.write_bytes(spark, held.getvalue(), path)
    return archives.read_tar_lines(spark, path)


def _highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest measurement of each dataset and codec."""
    metrics = ("compression_rate", "compression_speed", "decompression_speed", "average_random_access_time")
    return catalog.results(spark, sf_dir).groupBy("dataset_name", "compressor_name").agg(*(F.max(c).alias(c) for c in metrics))


def results_log(spark, sf_dir):
    """A log after two appends."""
    path, rows = scratch(spark, "log"), _highest(spark, sf_dir)
    results.append_results(rows.where("dataset_name < 'set3'"), path)
    results.append_results(rows.where("dataset_name >= 'set3'"), path)
    return results.read_results(spark, path)


def results_export(spark, sf_dir):
    """An export that has replaced another; the log that wasn't there has no rows."""
    path, rows = scratch(spark, "export"), _highest(spark, sf_dir)
    results.export_results(rows, path)
    results.export_results(rows.where("dataset_name < 'set3'"), path)
    return results.read_results(spark, path).unionByName(results.read_results(spark, scratch(spark, "none")))


def _stored(key: str):
    def q(spark, sf_dir):
        off, path = catalog.offsets(spark, sf_dir), scratch(spark, f"encoded-{key}")
        engine.store(engine.compress(off, key), path)
        found = engine.lookup(engine.load(spark, path), engine.query_workload(off, catalog.LOOKUPS))
        return found.select("qid", "idx", F.col("value").cast("string").alias("text"))

    return q


def roundtrip_onpair_config(spark, sf_dir):
    """Tokens of 12 bits at most, for pairs whose bound adapts."""
    got = engine.decompress(engine.compress(catalog.offsets(spark, sf_dir), "onpair", config=PairConfig(bits=12, dynamic=0.15)))
    return got.select(F.col("pos").alias("doc_id"), F.col("value").cast("string").alias("text"))


def roundtrip_added_codec(spark, sf_dir):
    """A codec of a user's own, found by its key."""
    registry.register(registry.Codec("bz2", "BZ2", "block", bz2.compress, lambda d, n: bz2.decompress(d)))
    try:
        got = engine.decompress(engine.compress(catalog.offsets(spark, sf_dir), "bz2"))
    finally:
        registry.unregister("bz2")
    return got.select(F.col("pos").alias("doc_id"), F.col("value").cast("string").alias("text"))


def stream_roundtrip(spark, sf_dir):
    """documents as a stream, encoded into files by a frozen dictionary; the files as a stream, decoded."""
    docs, path = catalog.table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "stream")
    table = SymbolTable.train(engine.training_sample(catalog.offsets(spark, sf_dir)))
    docs.write.parquet(f"{path}/in")

    def step(rows: DataFrame, name: str) -> DataFrame:
        query = rows.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-log").trigger(availableNow=True).start()
        query.awaitTermination()
        return rows

    coded = step(encode_stream(spark.readStream.schema(docs.schema).parquet(f"{path}/in"), table, "text").select("doc_id", "code"), "coded")
    decoded = step(decode_stream(spark.readStream.schema(coded.schema).parquet(f"{path}/coded"), table, value="text"), "decoded")
    return spark.read.schema(decoded.schema).parquet(f"{path}/decoded").select("doc_id", F.col("text").cast("string").alias("text"))


def suite_folder(spark, sf_dir):
    """The report of a suite over a folder, one dataset of which can't be read: runs that fail leave no result."""
    folder = scratch(spark, "suite")
    json_array.write_dataset(_regions(spark, sf_dir), folder, "region.json")
    json_array.write_dataset(_nations(spark, sf_dir), folder, "nation.json")
    one_file.write_bytes(spark, b"[1, 2]", f"{folder}/numbers.json")
    table, failed = suite.run_folder(spark, folder, scratch(spark, "log"), codecs=("raw",), iterations=1, queries=20)
    return table.select("dataset_name", "compressor_name", "compression_rate", F.lit(len(failed)).alias("n_failed"))


def suite_measures(spark, sf_dir):
    """Whether each measured time of a run is a positive number; what it is differs from run to run."""
    measured = suite.run(spark, {"region.json": _regions(spark, sf_dir), "nation.json": _nations(spark, sf_dir)}, codecs=("raw", "zstd"), iterations=1, queries=20)
    good = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False)).alias(c)
    return measured.select("dataset_name", "compressor_name", *(good(c) for c in ("compression_rate", "compression_speed", "decompression_speed", "average_random_access_time")))


def space_parts(spark, sf_dir):
    """The parts of each codec's space that follow from the collection, and whether the sums and the rate agree with the parts."""
    s = catalog.space_accounting(spark, sf_dir)
    used = F.col("payload_bytes") + F.col("dict_bytes") + F.col("metadata_bytes")
    agree = (F.col("space_used") == used) & (F.col("space_total") == used + F.col("offset_bytes")) & (F.col("rate") == F.col("raw_bytes") / used)
    return s.select("codec", "n_items", "raw_bytes", "metadata_bytes", "offset_bytes", (F.col("dict_bytes") > 0).alias("has_dictionary"), agree.alias("agree"))


_STORED = ("raw", "zstd", "fsst", "fsst_block", "onpair")
QUERIES = {
    f.__name__: f
    for f in (source_json_arrays, source_json_skip, source_listing, sink_modes, source_tar_lines, results_log, results_export, roundtrip_onpair_config, roundtrip_added_codec, stream_roundtrip, suite_folder, suite_measures, space_parts)
} | {"source_gzip_lines": _lines("gzip"), "source_bzip2_lines": _lines("bzip2")} | {f"stored_lookup_{k}": _stored(k) for k in _STORED}

# SQL

_NATIONS = "SELECT n_nationkey AS id, n_name || chr(10) || '\"\\é' AS value FROM nation"
_REGIONS = "SELECT r_regionkey AS id, r_name AS value FROM region"
_ALL = f"SELECT 'nation.json' AS file, row_number() OVER (ORDER BY id) - 1 AS id, value FROM ({_NATIONS}) UNION ALL SELECT 'region.json', row_number() OVER (ORDER BY id) - 1, value FROM ({_REGIONS})"
# a line each for the brackets; quotes and a line break around each string, and commas between; ODD takes 8 bytes when escaped
_LENGTHS = "SELECT 'nation.json' AS name, CAST(4 + sum(strlen(n_name) + 8 + 4) - 1 AS BIGINT) AS length, 1 AS place FROM nation UNION ALL SELECT 'region.json', CAST(4 + sum(strlen(r_name) + 4) - 1 AS BIGINT), 2 FROM region UNION ALL SELECT 'empty.json', 4, 0"
_HIGHEST = f"WITH {catalog._RESULTS}, h AS (SELECT dataset_name, compressor_name, max(compression_rate) AS compression_rate, max(compression_speed) AS compression_speed, max(decompression_speed) AS decompression_speed, max(t) AS average_random_access_time FROM r GROUP BY ALL) SELECT * FROM h"
_LINES = "SELECT CAST(c_custkey AS VARCHAR) || chr(9) || c_name AS value FROM customer"
_TEXTS = "SELECT doc_id, text FROM documents"
_PARTS = ", ".join(f"('{c.key}', {str(c.unit == 'block').lower()}, {str(c.unit.startswith('trained')).lower()})" for c in registry.CODECS.values())

ORACLES = {
    "source_json_arrays": _ALL,
    "source_json_skip": _ALL,
    "source_listing": _LENGTHS,
    "sink_modes": f"WITH n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, value FROM ({_NATIONS})), r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, value FROM ({_REGIONS})) SELECT 0 AS step, true AS written, * FROM r UNION ALL SELECT 1, false, * FROM r UNION ALL SELECT 2, true, * FROM n",
    "source_gzip_lines": _LINES,
    "source_bzip2_lines": _LINES,
    "source_tar_lines": "SELECT 'nations/' || CAST(n_regionkey AS VARCHAR) || '.tsv' AS member, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS line, CAST(n_nationkey AS VARCHAR) || chr(9) || n_name AS value FROM nation",
    "results_log": _HIGHEST,
    "results_export": _HIGHEST + " WHERE dataset_name < 'set3'",
    "roundtrip_onpair_config": _TEXTS,
    "roundtrip_added_codec": _TEXTS,
    "stream_roundtrip": _TEXTS,
    "suite_folder": "SELECT *, 'Raw' AS compressor_name, 1.0::DOUBLE AS compression_rate, CAST(1 AS INTEGER) AS n_failed FROM (VALUES ('nation.json'), ('region.json'), ('AVERAGE')) t(dataset_name)",
    "suite_measures": "SELECT dataset_name, compressor_name, true AS compression_rate, true AS compression_speed, true AS decompression_speed, true AS average_random_access_time FROM (VALUES ('nation.json'), ('region.json')) d(dataset_name), (VALUES ('Raw'), ('Zstd')) c(compressor_name)",
    "space_parts": catalog._blocks(layout.BLOCK)
    + f"SELECT codec, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS raw_bytes, CASE WHEN block THEN {registry.BLOCK_METADATA} * count(DISTINCT block_id) ELSE 0 END AS metadata_bytes, 8 * count(*) AS offset_bytes, trained AS has_dictionary, true AS agree FROM m, (VALUES {_PARTS}) c(codec, block, trained) GROUP BY codec, block, trained",
} | {f"stored_lookup_{k}": catalog.ORACLES[f"lookup_{k}"] for k in _STORED}
