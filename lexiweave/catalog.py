"""All registered queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.codecs.registry import CODECS
from lexiweave.functions import bitvector as bv
from lexiweave.functions import strings as S
from lexiweave.operators import engine, etl, layout, profile, report
from lexiweave.plans import suite

LOOKUPS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main collection: documents' texts by doc_id."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("value"))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_offsets(collection(spark, sf_dir))


# layout


def collection_offsets(spark, sf_dir):
    return offsets(spark, sf_dir).select("id", "pos", "start", "end")


def _metadata(limit):
    def q(spark, sf_dir):
        return layout.block_metadata(layout.with_blocks(offsets(spark, sf_dir), limit)).select("block_id", "first_pos", "n_items", "items_psum", "raw_bytes")

    return q


def in_block_delimiters(spark, sf_dir):
    blocks = layout.with_blocks(offsets(spark, sf_dir))
    return layout.in_block_delimiters(blocks, layout.block_metadata(blocks))


def block_lookup(spark, sf_dir):
    off = offsets(spark, sf_dir)
    meta = layout.block_metadata(layout.with_blocks(off))
    return layout.find_block(engine.query_workload(off, LOOKUPS), meta).select("qid", "idx", "block_id")


def query_workload(spark, sf_dir):
    return engine.query_workload(collection(spark, sf_dir), LOOKUPS)


# codecs


def _roundtrip(key):
    def q(spark, sf_dir):
        got = engine.decompress(engine.compress(offsets(spark, sf_dir), key))
        return got.select(F.col("pos").alias("doc_id"), F.col("value").cast("string").alias("text"))

    return q


def _lookup(key):
    def q(spark, sf_dir):
        off = offsets(spark, sf_dir)
        found = engine.lookup(engine.compress(off, key), engine.query_workload(off, LOOKUPS))
        return found.select("qid", "idx", F.col("value").cast("string").alias("text"))

    return q


def _verify(key):
    def q(spark, sf_dir):
        off = offsets(spark, sf_dir)
        return engine.verify(off, engine.decompress(engine.compress(off, key)))

    return q


def _space(key):
    return lambda spark, sf_dir: engine.space(engine.compress(offsets(spark, sf_dir), key))


def block_compress_deflate(spark, sf_dir):
    s = engine.compress(offsets(spark, sf_dir), "deflate").segments
    return s.select(F.col("segment_id").alias("block_id"), "n_items", "raw_bytes", F.octet_length("payload").cast("long").alias("compressed_bytes"))


def space_accounting(spark, sf_dir):
    """One row a codec."""
    off = offsets(spark, sf_dir)
    out = None
    for key in CODECS:
        one = engine.space(engine.compress(off, key))
        out = one if out is None else out.unionByName(one)
    return out


# profile


def profile_basics(spark, sf_dir):
    return profile.basics(collection(spark, sf_dir))


def profile_alphabet(spark, sf_dir):
    return profile.alphabet(collection(spark, sf_dir))


def profile_avg_lcp(spark, sf_dir):
    return profile.adjacent_prefixes(collection(spark, sf_dir))


def profile_printed(spark, sf_dir):
    return profile.printed(collection(spark, sf_dir), "documents")


# results: events stand for measurements


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("set"), F.pmod("user_id", F.lit(7)).cast("string"), F.lit(".json")).alias("dataset_name"), F.col("event_type").alias("compressor_name"), F.floor(F.col("value") * 8).cast("double").alias("compression_rate"),
        F.pmod("event_id", F.lit(997)).cast("double").alias("compression_speed"), F.pmod(F.col("event_id") * 31, F.lit(1009)).cast("double").alias("decompression_speed"), F.pmod(F.col("event_id") * 17, F.lit(4001)).cast("long").alias("average_random_access_time"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in report.METRICS})


def report_by_dataset(spark, sf_dir):
    return _rounded(report.by_dataset(results(spark, sf_dir)))


def report_overall(spark, sf_dir):
    return _rounded(report.overall(report.by_dataset(results(spark, sf_dir))))


def report_full(spark, sf_dir):
    return _rounded(report.full(results(spark, sf_dir)))


def suite_plan(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(".json")).alias("name"))
    return suite.plan(spark, names)


# ingest


def etl_tsv_col2(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("\t", F.col("page_id").cast("string"), F.concat(F.lit("  "), F.col("url"), F.lit("\t tail \t"))).alias("value"))
    return etl.second_column(lines)


def etl_url_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("D"), F.col("page_id").cast("string"), F.lit("\t"), F.when(F.col("page_id") % 5 == 0, F.lit("ftp://x")).otherwise(F.col("url")), F.lit("\ttitle\tbody")).alias("value"))
    return etl.url_column(lines)


def etl_json_field(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit('{"x": 1}')).when(F.col("event_id") % 7 == 1, F.lit("{bad")).when(F.col("event_id") % 7 == 2, F.lit('{"k": null}')).otherwise(F.col("props")).alias("value"))
    return etl.json_titles(lines, field="k")


def _statements(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 9 == 0, F.lit("# comment")).when(F.col("c_custkey") % 9 == 1, F.lit("   ")).when(F.col("c_custkey") % 9 == 2, F.lit("<s> <p> <o> ."))
    quoted = F.concat(F.lit('<s> <p> "'), F.col("c_name"), F.when(F.col("c_custkey") % 9 == 3, F.lit(r" \"q\" ")).otherwise(F.lit("")), F.when(F.col("c_custkey") % 9 == 4, F.lit('"@en-GB .')).otherwise(F.lit('"@en .')))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(name, quoted).alias("value"))


def etl_literal_extract(spark, sf_dir):
    return etl.literals(_statements(spark, sf_dir))


def etl_limit(spark, sf_dir):
    return etl.literals(_statements(spark, sf_dir), limit=100, order="c_custkey")


def etl_strip_nonempty(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(" \t"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("")).otherwise(F.col("n_name")), F.lit("\n ")).alias("value"))
    return rows.withColumn("value", S.strip(F.col("value"))).where(F.length("value") > 0)


def common_prefix(spark, sf_dir):
    """Bytes that each page's URL has in common with the page's before."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    before = p.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("before"))
    return p.join(before, "page_id").select("page_id", S.common_prefix(F.col("url"), F.col("before")).alias("lcp"))


def metric_functions(spark, sf_dir):
    d = collection(spark, sf_dir)
    n = S.byte_length(F.col("value"))
    return d.select("id", n.alias("n_bytes"), F.round(S.mib(n), 9).alias("mib"), F.round(S.ratio(n, F.length("value").cast("long")), 9).alias("bytes_per_char"), S.fixed(n / 1000.0, 3).alias("kb"))


# bit vectors, from the bits of order keys


def _bits(spark, sf_dir):
    o = table(spark, sf_dir, "supplier").select("s_suppkey")
    return o.withColumn("v", bv.append_bits(bv.zeroes(3), F.col("s_suppkey"), 12))


def bitvector_reads(spark, sf_dir):
    v = F.col("v")
    return _bits(spark, sf_dir).select("s_suppkey", bv.length(v).alias("n"), bv.get(v, 4).alias("bit4"), bv.get(v, 99).alias("outside"), bv.get_bits(v, 3, 12).alias("field"), bv.next_one(v, 4).alias("next"), bv.prev_one(v, 9).alias("prev"), F.size(bv.positions(v)).alias("ones"))


def bitvector_writes(spark, sf_dir):
    v = bv.push(bv.extend_ones(bv.put(F.col("v"), 0, True), 2), False)
    return _bits(spark, sf_dir).select("s_suppkey", bv.get_bits(v, 0, 18).alias("value"), F.size(v).alias("n"), bv.words(v)[0].alias("word"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        collection_offsets, in_block_delimiters, block_lookup, query_workload, block_compress_deflate, space_accounting, profile_basics, profile_alphabet, profile_avg_lcp, profile_printed, report_by_dataset, report_overall, report_full,
        suite_plan, etl_tsv_col2, etl_url_filter, etl_json_field, etl_literal_extract, etl_limit, etl_strip_nonempty, common_prefix, metric_functions, bitvector_reads, bitvector_writes,
    )
}
QUERIES |= {"block_layout_64k": _metadata(layout.BLOCK), "batch_layout_4m": _metadata(layout.BATCH), "space_raw": _space("raw")}
for _key in CODECS:
    QUERIES |= {f"roundtrip_{_key}": _roundtrip(_key), f"lookup_{_key}": _lookup(_key), f"verify_{_key}": _verify(_key)}

# SQL

OFFSETS = "o AS (SELECT doc_id AS id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(strlen(text) AS BIGINT) AS size, CAST(sum(strlen(text)) OVER (ORDER BY doc_id) AS BIGINT) AS \"end\" FROM documents)"


def _blocks(limit: int) -> str:
    """CTEs: o, b (first position of each block), m (each item's block)."""
    return f"""WITH RECURSIVE {OFFSETS}, hop(first) AS (
  SELECT min(pos) FROM o UNION ALL
  SELECT (SELECT min(x.pos) FROM o x WHERE x.pos > hop.first AND x."end" - (SELECT y."end" - y.size FROM o y WHERE y.pos = hop.first) > {limit}) FROM hop WHERE hop.first IS NOT NULL
), b AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS block_id, lead(first) OVER (ORDER BY first) AS nxt FROM hop WHERE first IS NOT NULL),
m AS (SELECT o.*, block_id, first FROM o JOIN b ON pos >= first AND (nxt IS NULL OR pos < nxt))
"""


def _metadata_sql(limit: int) -> str:
    return _blocks(limit) + "SELECT block_id, min(pos) AS first_pos, count(*) AS n_items, max(pos) + 1 AS items_psum, CAST(sum(size) AS BIGINT) AS raw_bytes FROM m GROUP BY block_id"


_WORKLOAD = f"q AS (SELECT i AS qid, (i * 2654435761 + 13) % (SELECT count(*) FROM documents) AS idx FROM range({LOOKUPS}) t(i))"
_RESULTS = """r AS (SELECT 'set' || CAST(user_id % 7 AS VARCHAR) || '.json' AS dataset_name, event_type AS compressor_name, floor(value * 8) AS compression_rate, CAST(event_id % 997 AS DOUBLE) AS compression_speed,
  CAST((event_id * 31) % 1009 AS DOUBLE) AS decompression_speed, (event_id * 17) % 4001 AS t FROM events),
a AS (SELECT compressor_name, dataset_name, avg(compression_rate) AS compression_rate, avg(compression_speed) AS compression_speed, avg(decompression_speed) AS decompression_speed, CAST(floor(avg(t)) AS BIGINT) AS average_random_access_time FROM r GROUP BY ALL),
v AS (SELECT compressor_name, 'AVERAGE' AS dataset_name, avg(compression_rate) AS compression_rate, avg(compression_speed) AS compression_speed, avg(decompression_speed) AS decompression_speed, CAST(floor(avg(average_random_access_time)) AS BIGINT) AS average_random_access_time FROM a GROUP BY compressor_name)"""
_REPORT = "compressor_name, dataset_name, round(compression_rate, 6) AS compression_rate, round(compression_speed, 6) AS compression_speed, round(decompression_speed, 6) AS decompression_speed, average_random_access_time"
_LITERALS = r"""s AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN '# comment' WHEN 1 THEN '   ' WHEN 2 THEN '<s> <p> <o> .' ELSE '<s> <p> "' || c_name || CASE WHEN c_custkey % 9 = 3 THEN ' \"q\" ' ELSE '' END || CASE WHEN c_custkey % 9 = 4 THEN '"@en-GB .' ELSE '"@en .' END END AS value FROM customer),
l AS (SELECT c_custkey, regexp_extract(value, '^[^"]*"(.*)"@en', 1) AS value FROM s WHERE NOT starts_with(value, '#') AND length(trim(value)) > 0 AND regexp_matches(value, '^[^"]*"(.*)"@en'))"""
_BITS = "b AS (SELECT s_suppkey, '000' || reverse(right(bin(4096 + s_suppkey % 4096), 12)) AS s FROM supplier)"

ORACLES: dict[str, str] = {
    "collection_offsets": f'WITH {OFFSETS} SELECT id, pos, "end" - size AS start, "end" FROM o',
    "block_layout_64k": _metadata_sql(layout.BLOCK),
    "batch_layout_4m": _metadata_sql(layout.BATCH),
    "in_block_delimiters": _blocks(layout.BLOCK) + 'SELECT pos, block_id, "end" - size - (SELECT y."end" - y.size FROM o y WHERE y.pos = first) AS item_start, "end" - (SELECT y."end" - y.size FROM o y WHERE y.pos = first) AS item_end FROM m',
    "block_lookup": _blocks(layout.BLOCK) + f", {_WORKLOAD} SELECT qid, idx, block_id FROM q JOIN m ON idx = pos",
    "query_workload": f"WITH {_WORKLOAD} SELECT * FROM q",
    "space_raw": "SELECT 'raw' AS codec, count(*) AS n_items, CAST(sum(strlen(text)) AS BIGINT) AS raw_bytes, CAST(sum(strlen(text)) AS BIGINT) AS payload_bytes, CAST(0 AS BIGINT) AS dict_bytes, CAST(0 AS BIGINT) AS metadata_bytes, 8 * count(*) AS offset_bytes, CAST(sum(strlen(text)) AS BIGINT) AS space_used, CAST(sum(strlen(text)) AS BIGINT) + 8 * count(*) AS space_total, CAST(1.0 AS DOUBLE) AS rate FROM documents",
    "profile_basics": "SELECT count(*) AS n, 100.0::DOUBLE * count(DISTINCT text) / count(*) AS unique_pct, avg(strlen(text)) AS avg_bytes FROM documents",
    "profile_alphabet": "SELECT count(DISTINCT b) AS alphabet FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents)",
    "profile_avg_lcp": """WITH h AS (SELECT hex(encode(text)) AS h, lag(hex(encode(text))) OVER (ORDER BY encode(text)) AS p FROM documents),
c AS (SELECT CASE WHEN h = p THEN length(h) // 2 ELSE (list_position(list_transform(list_zip(string_split(h, ''), string_split(p, '')), lambda x: coalesce(x[1] = x[2], false)), false) - 1) // 2 END AS k FROM h WHERE p IS NOT NULL)
SELECT CAST(sum(k) AS BIGINT) AS lcp_sum, count(*) AS pairs, CAST(sum(k) AS DOUBLE) / count(*) AS avg_lcp FROM c""",
    "report_by_dataset": f"WITH {_RESULTS} SELECT {_REPORT} FROM a",
    "report_overall": f"WITH {_RESULTS} SELECT {_REPORT} FROM v",
    "report_full": f"WITH {_RESULTS} SELECT {_REPORT}, false AS is_avg FROM a UNION ALL SELECT {_REPORT}, true AS is_avg FROM v",
    "suite_plan": "SELECT r_name || '.json' AS dataset_name, codec, CAST(iteration AS INTEGER) AS iteration FROM region, (VALUES ('raw'), ('onpair'), ('fsst')) c(codec), range(3) i(iteration)",
    "etl_tsv_col2": "SELECT page_id, trim(url || chr(9) || ' tail ', ' ' || chr(9)) AS value FROM pages WHERE url IS NOT NULL",
    "etl_url_filter": "SELECT page_id, url AS value FROM pages WHERE page_id % 5 <> 0 AND starts_with(url, 'http')",
    "etl_json_field": "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE event_id % 7 > 2 AND length(coalesce(json_extract_string(props, '$.k'), '')) > 0",
    "etl_literal_extract": f"WITH {_LITERALS} SELECT * FROM l",
    "etl_limit": f"WITH {_LITERALS} SELECT * FROM l ORDER BY c_custkey LIMIT 100",
    "etl_strip_nonempty": "SELECT n_nationkey, n_name AS value FROM nation WHERE n_nationkey % 4 <> 0",
    "common_prefix": """WITH p AS (SELECT a.page_id, hex(encode(a.url)) AS h, hex(encode(b.url)) AS p FROM pages a JOIN pages b ON a.page_id = b.page_id + 1)
SELECT page_id, CASE WHEN h = p THEN length(h) // 2 ELSE (list_position(list_transform(list_zip(string_split(h, ''), string_split(p, '')), lambda x: coalesce(x[1] = x[2], false)), false) - 1) // 2 END AS lcp FROM p""",
    "metric_functions": "SELECT doc_id AS id, CAST(strlen(text) AS BIGINT) AS n_bytes, round(strlen(text) / (1024.0::DOUBLE * 1024.0), 9) AS mib, CASE WHEN length(text) > 0 THEN round(CAST(strlen(text) AS DOUBLE) / length(text), 9) END AS bytes_per_char, format('{:.3f}', CAST(strlen(text) AS DOUBLE) / 1000.0) AS kb FROM documents",
    "bitvector_reads": f"""WITH {_BITS} SELECT s_suppkey, 15 AS n, s[5] = '1' AS bit4, CAST(NULL AS BOOLEAN) AS outside, CAST(s_suppkey % 4096 AS BIGINT) AS field,
  CASE WHEN strpos(substr(s, 6), '1') > 0 THEN CAST(strpos(substr(s, 6), '1') + 4 AS INTEGER) END AS next, CASE WHEN strpos(reverse(left(s, 9)), '1') > 0 THEN CAST(9 - strpos(reverse(left(s, 9)), '1') AS INTEGER) END AS prev, CAST(length(replace(s, '0', '')) AS INTEGER) AS ones FROM b""",
    "bitvector_writes": "SELECT s_suppkey, CAST(1 + (s_suppkey % 4096) * 8 + 32768 + 65536 AS BIGINT) AS value, 18 AS n, CAST(1 + (s_suppkey % 4096) * 8 + 32768 + 65536 AS BIGINT) AS word FROM supplier",
}
ORACLES["profile_printed"] = f"""SELECT 'documents' AS file, format('{{:,}}', n) AS count_n, printf('%.2f', unique_pct) || '%' AS "unique", printf('%.2f', avg_bytes) || ' bytes' AS avg_length, CAST(alphabet AS VARCHAR) AS alphabet_size,
  printf('%.2f', avg_lcp) || ' bytes' AS avg_lcp FROM ({ORACLES["profile_basics"]}), ({ORACLES["profile_alphabet"]}), ({ORACLES["profile_avg_lcp"]})"""
for _key in CODECS:
    ORACLES |= {
        f"roundtrip_{_key}": "SELECT doc_id, text FROM documents",
        f"lookup_{_key}": f"WITH {OFFSETS}, {_WORKLOAD} SELECT qid, idx, text FROM q JOIN o ON idx = pos",
        f"verify_{_key}": "SELECT count(*) AS n_items, CAST(0 AS BIGINT) AS mismatches FROM documents",
    }
