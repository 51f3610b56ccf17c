"""Corpus preparation in five stages, each reading what the one before has written.

1. language_id: documents whose text is null, has no letter, or whose language is less likely than MIN_SCORE go.
2. near_duplicates: of each group of near-duplicates the document with the smallest id stays.
3. repeats: bytes of strings of 200 bytes that also start elsewhere are cut; documents left without a word go.
4. decontamination: words of benchmark passages are cut; documents left without a word go.
5. pieces: texts are segmented by sampling, and decoding must give them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import decontaminate, language_id, ngram_jaccard, sentencepiece_codec, suffix_dedup
from lexiweave.llm.shared import remainder, stored
from lexiweave.session import reach_workers

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.5  # held-out documents of sf0.1 score 0.434 or more in all but 0.05 % and 0.748 or more in all but 0.5 %; four languages share 0.25 each at least
ORACLE_SQL = None  # the stages aren't SQL; tests hold near-duplicates, repeats and decontamination against plain restatements


def _plain(docs: DataFrame) -> DataFrame:
    """docs with other names for the columns beside those of documents, so that they don't clash with an operator's."""
    return docs.toDF(*(c if c in COLUMNS else f"column_{k}_beside" for k, c in enumerate(docs.columns)))


def _resized(docs: DataFrame, before: DataFrame) -> DataFrame:
    """docs with n_chars as their texts are now, without those that have no word left, in the columns of `before`."""
    kept = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*before.columns)


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is known: those with null text, without a letter, or with a score below MIN_SCORE go. Learns from labelled rows that aren't held out; without any, nothing stays."""
    reach_workers(spark)
    plain = _plain(docs)
    model = language_id.fit(plain.where(F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(True))))
    judged = language_id.predict(plain, model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest id, repeated rows once; documents without words or id all stay."""
    plain = _plain(docs)
    return ngram_jaccard.one_of_each(plain).select(*plain.columns).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the characters of repeated strings of 200 bytes, the first copy's too; documents without a word left, and null texts, go."""
    plain = _plain(docs)
    return _resized(suffix_dedup.strip_repeats(plain), plain).toDF(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the words of benchmark windows; documents without a word left, and null texts, go. An empty benchmark changes nothing."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = _plain(docs)
    found = decontaminate.find_contamination(plain, items)
    return _resized(decontaminate.strip_spans(found), plain).toDF(*docs.columns)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, n_pieces, piece_ids; a text that decoding doesn't give back is an error."""
    out = sentencepiece_codec.round_trip(docs)
    text = F.when(F.col("decoded").eqNullSafe(F.col("text")), F.col("text")).otherwise(F.raise_error(F.lit("decoding lost text")))
    return out.select("doc_id", text.alias("text"), F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language_id", detect_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", cut_benchmark),
    ("pieces", segment),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the last one's rows (doc_id, text, n_pieces, piece_ids). Columns beside those of documents are carried along, whatever their names; an empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(reach_workers(spark), docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
