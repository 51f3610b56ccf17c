r"""Chat formatting from event logs, DataFrame functions only.

A log row is an event of a conversation: `message` starts a message, `delta` appends to it,
`edit` replaces its text, `regenerate` drops it and all later messages and starts it anew.
Events are partitioned by conversation and sorted by sequence; one window finds what later
regenerations have dropped, one aggregation folds each message, one more renders the
conversation. All three need the same partitioning, so the log is shuffled once.

A turn is rendered as `[INST]role[/INST]text</s>`. Inside roles and texts a control string gets
a backslash after its first character, as does one that has such backslashes already; taking one
backslash away restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEGIN, MID, END = "[INST]", "[/INST]", "</s>"
ESCAPE = r"(<|\[)(\\*)(/s>|INST\]|/INST\])"
UNESCAPE = r"(<|\[)\\(\\*)(/s>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    """Text in which no control string occurs."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What escape() was given."""
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the messages that a log's events leave.

    events: conv_id, seq, msg, kind, role, text. Null texts are empty; null roles become empty; kinds that are null or
    unknown count as `message`. Events of equal seq are taken by (msg, kind, role, text). A delta without a message
    starts one. Null conv_id is one conversation of its own.
    """
    e = events.select("conv_id", "seq", "msg", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    later = W.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("msg"), F.desc("kind"), F.desc("role"), F.desc("text")).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later)).where("cut is null or msg is null or msg < cut")
    folded = e.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    begins = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(0)))
    kept = F.slice("log", begins + 1, F.size("log"))
    return folded.select("conv_id", "msg", F.coalesce(F.get(F.reverse(F.filter("log", lambda x: x["role"].isNotNull())), F.lit(0))["role"], F.lit("")).alias("role"), F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def format_chats(events: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, n_turns, loss): each conversation as one text, with its loss mask.

    loss lists, in order, the trained roles' texts inside `formatted`: turn (0-based), start and end (code points of
    `formatted`, end exclusive) and offset (code points from the turn's own start). A conversation is one text, so it
    must fit in a row; nothing else of it is gathered.
    """
    turns = fold_events(events)
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(MID))
    turns = turns.withColumn("head", F.length(head)).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("segment", F.concat(head, "body", F.lit(END)))
    order = W.partitionBy("conv_id").orderBy("msg")
    turns = turns.withColumn("turn", F.row_number().over(order) - 1).withColumn("at", F.sum(F.length("segment")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.length("segment"))
    mask = F.when(F.col("role").isin(*trained), F.struct("turn", (F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.col("head") + F.length("body")).alias("end"), F.col("head").alias("offset")))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "segment"))).alias("parts"), F.sort_array(F.collect_list(mask)).alias("loss"), F.count("*").alias("n_turns"))
    return chats.select("conv_id", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("formatted"), "n_turns", "loss")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    cut = lambda p: F.locate(MID, p)
    begin, mid = len(BEGIN), len(MID)
    return F.transform(parts, lambda p: F.struct(unescape(F.substring(p, begin + 1, cut(p) - begin - 1)).alias("role"), unescape(F.substring(p, cut(p) + mid, F.length(p))).alias("text")))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under a loss mask, unescaped, in order."""
    parts = F.split(formatted, END)
    return F.transform(loss, lambda m: unescape(F.substring(F.get(parts, m["turn"]), (m["offset"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
