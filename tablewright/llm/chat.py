"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns up to it as context and only its text
under the loss. Turns after the last assistant turn are kept in one more example without a
target, so nothing of a conversation is lost. A turn is written `<turn role>text</turn>`;
inside roles and texts the backslash becomes `\\b`, `<` becomes `\\l` and `>` becomes `\\g`, so no
text can hold a mark and reading back is exact.

Null texts and roles count as empty, a null turn number comes first, equal turn numbers are
ordered by role and text (ties, and repeated rows, are turns of their own), a null conv_id is a
conversation of its own. Texts of any length are kept whole; a conversation's turns are gathered in one
row, so it must fit a task. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = "assistant"


def escaped(c: Column) -> Column:
    for plain, mark in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescaped(c: Column) -> Column:
    for plain, mark in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, target (number of its last turn, from 1), formatted, loss_start and loss_length: code points under the loss."""
    empty = F.lit("")
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit("<turn "), escaped(t["role"]), F.lit(">"))
    rendered = grouped.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == TARGET).alias("targets"),
        F.transform("turns", lambda t: F.length(head(t))).alias("heads"),
        F.transform("turns", lambda t: F.concat(head(t), escaped(t["text"]), F.lit("</turn>"))).alias("written"),
    )
    n = F.size("written")
    wanted = F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at("targets", k) | (k == n))
    each = rendered.select("*", F.explode(wanted).alias("target"))
    last, is_target = F.element_at("written", F.col("target")), F.element_at("targets", F.col("target"))
    whole = each.select("conv_id", "target", F.array_join(F.slice("written", F.lit(1), F.col("target")), "").alias("formatted"), F.length(last).alias("size"), F.element_at("heads", F.col("target")).alias("head"), is_target.alias("is_target"))
    start = F.length("formatted") - F.col("size") + F.col("head")
    return whole.select("conv_id", "target", "formatted", start.alias("loss_start"), F.when(F.col("is_target"), F.col("size") - F.col("head") - len("</turn>")).otherwise(0).alias("loss_length"), "is_target")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    pieces = F.filter(F.split(formatted, "</turn>"), lambda p: p != "")
    cut = lambda p: F.split(p, ">")
    return F.transform(pieces, lambda p: F.struct(unescaped(F.substring(cut(p)[0], 7, 2147483647)).alias("role"), unescaped(cut(p)[1]).alias("text")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples hold, for each conversation: turns read back from its longest example, texts under the loss from all."""
    loss = unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    masked = examples.select("conv_id", "target", "formatted", F.when(F.col("is_target"), loss).otherwise("").alias("loss"))
    by = masked.groupBy("conv_id").agg(F.max_by("formatted", "target").alias("whole"), F.array_sort(F.collect_list(F.struct("target", "loss"))).alias("losses"), F.sum(F.length("formatted")).alias("formatted_chars"))
    read = by.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars")
