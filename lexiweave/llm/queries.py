"""The opN_<name> queries: the operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, language_id, ngram_jaccard, ngram_lm, sentencepiece_codec, suffix_dedup, url_filters, warc
from .shared import remainder

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PROBE_TEXT = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(_table(spark, sf_dir, "pages"), url_filters.rules_table(spark, URL_RULES))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, pieces, digests of the sampled ids and of the decoded text, and whether decoding gave the text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_codec.round_trip(docs)
    ids = F.array_join("piece_ids", ",")
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("piece_ids").isNotNull(), F.size("piece_ids")).cast("long").alias("n_pieces"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["last_word"] - x["first_word"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _streamed(messages: DataFrame) -> DataFrame:
    """The log of events that leaves these messages (conv_id, msg, role, text): by turns streamed in two parts, edited once, and regenerated after a draft."""
    half = F.ceil(F.length("text") / 2).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.when(F.lit(kind != "delta"), F.col("role")).alias("role"), text.alias("text"))
    first, rest, draft = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text")), F.lit("draft")
    streamed = F.array(event("message", first), event("delta", rest))
    edited = F.array(event("message", draft), event("edit", F.col("text")))
    again = F.array(event("message", draft), event("regenerate", first), event("delta", rest))
    log = F.when(F.col("msg") % 3 == 0, streamed).when(F.col("msg") % 3 == 1, edited).otherwise(again)
    return messages.select("conv_id", "msg", F.posexplode(log).alias("k", "event")).select("conv_id", (4 * F.col("msg") + F.col("k")).alias("seq"), "msg", "event.*")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as logs of deltas, edits and regenerations (rows of equal turn by role and text), folded, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE_TEXT).alias("text")) for k, role in enumerate(("user", "assistant"))))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.union(probe).withColumn("msg", F.row_number().over(order).cast("long"))
    events = _streamed(events)
    chats = chat_format.format_chats(events).withColumn("turns", chat_format.read_back(F.col("formatted")))
    chats = chats.withColumn("loss_text", F.array_join(chat_format.loss_texts(F.col("formatted"), F.col("loss")), ""))
    log = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(log).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    return ngram_lm.score_held_out(docs)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_url_filters, op3_sentencepiece, op4_benchmark_decontamination, op5_chat_formatting, op6_suffix_array_dedup, op7_language_id, op8_lm_scoring, op9_embedding_near_dedup, op10_warc)}
