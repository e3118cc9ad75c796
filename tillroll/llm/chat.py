"""Chat formatting: prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all turns before it are
context, its reply alone is trainable.  Turns after the last assistant turn are
kept in one more example without a target, so the output holds every turn.

Template.  An assistant turn is ``<s>role\\ntext</s>``, any other turn is
``[INST]role\\ntext[/INST]``.  A control string inside a role or text gets one
backslash after its first character (``</s>`` becomes ``<\\/s>``); one that
already has k backslashes there gets k + 1.  No text can thus end or open a
turn, and taking one backslash out again restores it exactly.

Defined cases: null text, role or turn count as an empty text, an empty role
and a turn before all others; rows are ordered by (turn, role, text), and
repeated rows stay as turns of their own; a null ``conv_id`` is one
conversation.  Only ``conv_id, turn, role, text`` are read.  An empty table
gives no example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_ESCAPE = r"(<|\[)(\\*)(/?s>|/?INST\])"
_UNESCAPE = r"(<|\[)(\\*)\\(/?s>|/?INST\])"
_TURN = r"(?s)<s>.*?</s>|\[INST\].*?\[/INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _role_out(role: Column) -> Column:
    """A line break would end the role: it is written as backslash-n, and a backslash as two."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, n_turns, target_turn (null: no target), formatted, loss_start, loss_chars.

    ``formatted`` is the whole text; code points [loss_start, loss_start +
    loss_chars) are the loss mask.  The turns of a conversation meet in one
    row, which is the unit of this operator; examples are cut from its text.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = (conversations
             .select("conv_id", F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2 ** 63))).alias("turn"),
                                         role.alias("role"), text.alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    is_reply = lambda t: t["role"] == ASSISTANT
    head = lambda t: F.concat(F.when(is_reply(t), "<s>").otherwise("[INST]"), _role_out(t["role"]), F.lit("\n"))
    tail = lambda t: F.when(is_reply(t), "</s>").otherwise("[/INST]")
    pieces = turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        is_reply(t).alias("reply"), head(t).alias("head"), escape(t["text"]).alias("body"), tail(t).alias("tail"))).alias("p"))
    whole = pieces.select("conv_id", "p", F.size("p").alias("all_turns"),
                          F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("whole"),
                          F.aggregate("p", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(
                              F.element_at(acc, -1) + F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"])))).alias("ends"))
    last = F.col("all_turns") - 1
    spots = whole.select("*", F.filter(F.sequence(F.lit(0), last), lambda i: F.element_at("p", i + 1)["reply"] | (i == last)).alias("at"))
    one = spots.select("conv_id", "whole", "ends", F.explode("at").alias("i"), "p").select(
        "conv_id", "whole", "ends", "i", F.element_at("p", F.col("i") + 1).alias("x"))
    start = F.element_at("ends", F.col("i") + 1)
    return one.select(
        "conv_id",
        (F.col("i") + 1).cast("long").alias("n_turns"),
        F.when(F.col("x.reply"), F.col("i").cast("long")).alias("target_turn"),
        F.substring("whole", F.lit(1), F.element_at("ends", F.col("i") + 2)).alias("formatted"),
        F.when(F.col("x.reply"), start + F.length("x.head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("x.reply"), F.length("x.body")).otherwise(0).cast("long").alias("loss_chars"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns (role, text) and the text under the loss masks in order."""
    per_conv = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("target_turn").isNotNull(), F.struct(
            "target_turn", F.expr("substring(formatted, cast(loss_start as int) + 1, cast(loss_chars as int))").alias("masked"))))).alias("masks"))
    raw = F.regexp_extract_all("whole", F.lit(_TURN), F.lit(0))
    strip = lambda t: F.when(F.startswith(t, F.lit("<s>")), F.substring(t, F.lit(4), F.length(t) - 7)).otherwise(
        F.substring(t, F.lit(7), F.length(t) - 13))
    turns = F.transform(raw, lambda t: F.struct(
        _role_in(F.substring_index(strip(t), "\n", 1)).alias("role"),
        unescape(F.substring(strip(t), F.instr(strip(t), "\n") + 1, F.length(t))).alias("text")))
    return per_conv.select("conv_id", "formatted_chars", turns.alias("turns"),
                           F.transform("masks", lambda m: unescape(m["masked"])).alias("replies"))


def digests(examples: DataFrame) -> DataFrame:
    back = read_back(examples)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("replies", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")
