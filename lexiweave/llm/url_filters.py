"""URL filters, DataFrame functions only.

A rule is a host and a path prefix with a verdict. Every URL is expanded into the
host suffixes and path prefixes that a rule could have; the expansions are equi-joined
with the rules on a short prefix of a SHA-256 digest, the full digest confirms, and
the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 8  # hex digits of the digest to join on
BROADCAST_RULES = 50_000  # up to so many rules are broadcast,
BROADCAST_BYTES = 16 << 20  # of up to so many bytes with digests and verdicts
SALTS = 16  # beyond that, hot expressions are spread over so many keys


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first `://` up to `/`, `?` or `#`, A-Z lower-cased; then up to `?` or `#`. Both empty without `://` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a DataFrame of literals."""
    one = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    if not one:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
    return spark.range(1).select(F.inline(F.array(*one)))


def url_filter(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row: (id, host, path, rule, verdict).

    rules: host, path, verdict. A rule fits its host and all subdomains when the URL's path starts with the rule's
    path; the longest rule text (host + path) wins, then the longer host, then `block`. rule is null and verdict is
    `default` where none fits. Null and malformed URLs have an empty host and path, which no rule with a host fits.
    Repeated rows give repeated results; a null id is a value like any other; other columns are not read. URLs and rules may have any length. Rules with
    null host or path are ignored; an empty rules table leaves every row with the default.
    """
    rules = rules.where("host is not null and path is not null").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.coalesce("verdict", F.lit(default)).alias("r_verdict")
    )
    shape = rules.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(1)).alias("labels"), F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"), F.coalesce(F.sum(2 * F.octet_length("r_host") + F.octet_length("r_path") + 200), F.lit(0)).alias("bytes")).first()
    # n distinct lengths take rules of n * n / 2 characters at least, so this list is small beside the rules.
    lengths = F.lit(shape["lengths"] or [0])
    keyed = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)
    rules = rules.withColumn("r_digest", keyed(F.col("r_host"), F.col("r_path"))).groupBy("r_digest").agg(F.first("r_host").alias("r_host"), F.first("r_path").alias("r_path"), F.max("r_verdict").alias("r_verdict"))
    rules = rules.withColumn("r_short", F.substring("r_digest", 1, PREFIX_CHARS))

    host, path = url_parts(F.col("url"))
    # Copies are counted inside a partition of the input, so that no row stands for more of them than one task has read.
    row = ["id", "url", "part"]
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.spark_partition_id().alias("part")).groupBy(*row).agg(F.count("*").alias("copies"))
    rows = rows.select(*row, "copies", host.alias("host"), path.alias("path"))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(shape["labels"]))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: keyed(s, p))))
    wide = rows.withColumn("digest", F.explode_outer(pairs)).withColumn("short", F.substring("digest", 1, PREFIX_CHARS))
    match = (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest"))
    if shape["n"] <= BROADCAST_RULES and shape["bytes"] <= BROADCAST_BYTES:
        joined = wide.join(F.broadcast(rules), match, "left")
    else:
        salted = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = wide.withColumn("salt", F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int")).join(salted, match & (F.col("salt") == F.col("r_salt")), "left")
    rank = F.when(F.col("r_digest").isNotNull(), F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), "r_verdict", F.concat("r_host", "r_path").alias("rule")))
    best = joined.groupBy(*row, "copies", "host", "path").agg(F.max(rank).alias("best"))
    best = best.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return best.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


__all__ = ["rules_table", "url_filter", "url_parts"]
