"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply is
trainable. Turns that follow the last reply (or a conversation without any) become one more example in
which nothing is trainable, so the output holds every turn.

The template writes each turn as ``<|turn|>role<|text|>text<|end|>``. Texts and roles are escaped: ``&``
becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so they can't hold a control string; undoing the two in
reverse order gives the text back.

Defined results: null texts and null roles count as empty; rows of equal turn go by role and text; repeated
rows are turns of their own; a role other than ``assistant`` is never trainable; rows whose conv_id is null
form one conversation; a null turn sorts first; columns besides the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows conv_id, example (from 0), formatted, loss_start, loss_length: the trainable part in code points.

    One shuffle by conv_id; a conversation is one row, as each of its longest examples must be.
    """
    said = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))
    size = F.size("said")
    replies = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("said", i)["role"] == ASSISTANT)
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("said")).withColumn("replies", replies)
    ends = F.when(F.element_at("said", -1)["role"] == ASSISTANT, F.col("replies")).otherwise(F.concat("replies", F.array(size)))
    chats = chats.select("conv_id", "said", F.transform("said", marked).alias("parts"), ends.alias("ends"))
    each = chats.select("conv_id", "said", "parts", F.posexplode("ends").alias("example", "end"))
    last = F.element_at("said", F.col("end"))
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("end")), "")
    target = F.when(last["role"] == ASSISTANT, F.length(escape(last["text"])))
    return each.select("conv_id", "example", formatted.alias("formatted"), target.alias("loss_length")).select(
        "conv_id", "example", "formatted", (F.length("formatted") - len(END) - F.col("loss_length")).alias("loss_start"), "loss_length"
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example as array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    head = lambda x: F.substring_index(x, TEXT, 1)
    return F.transform(pieces, lambda x: F.struct(unescape(F.substr(head(x), F.lit(len(TURN) + 1))).alias("role"), unescape(F.substr(x, F.length(head(x)) + len(TEXT) + 1)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the formatted examples alone."""
    loss = F.coalesce(unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length"))), F.lit(""))
    whole = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    longest = F.max_by("formatted", F.length("formatted"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]), "")
    chats = examples.groupBy("conv_id").agg(longest.alias("longest"), texts.alias("loss"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    return chats.withColumn("turns", read_turns(F.col("longest"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )
