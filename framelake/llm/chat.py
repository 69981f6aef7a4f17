"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Each assistant turn becomes one example: all turns before it as context, and its reply as the only trainable span.
Turns after the last assistant turn (or all, if there is none) form a tail example without a trainable span, so
that nothing of a conversation is lost.

The template writes a turn as ``<s>role\\ntext</s>``.  Control strings inside roles and texts get a backslash after
their first character, and backslashes are doubled, so both can be read back exactly.

Turns are ordered by turn, then role, then text (nulls first); equal rows all stay.  A null role or text counts as
empty; rows without conv_id form one conversation.  Further columns are ignored, whatever their names.  A conversation has to
fit into one row; an empty table gives an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, LINE = "<s>", "</s>", "<nl>"
#: Strings that may stand in a formatted text only where the template puts them.
CONTROLS = (OPEN, CLOSE, LINE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The role whose turns are learned.
TARGET = "assistant"


def escape(text: Column) -> Column:
    return functools.reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"{x[0]}\\{x[1:]}")), CONTROLS, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text: Column) -> Column:
    return F.replace(functools.reduce(lambda c, x: F.replace(c, F.lit(f"{x[0]}\\{x[1:]}"), F.lit(x)), CONTROLS, text), F.lit("\\\\"), F.lit("\\"))


def format_chats(df: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, example`` (from 0), ``text`` (formatted), ``loss_start``, ``loss_chars``.

    The span counts code points of ``text`` from 0; it is null for a tail.
    """
    role, said = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    turns = df.select("conv_id", F.struct("turn", F.col("role").alias("own_role"), F.col("text").alias("own_text"), head.alias("head"), escape(said).alias("body"), (role == TARGET).alias("learn")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    targets = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("turns", i)["learn"] | (i == n - 1))
    one = whole.select("conv_id", "turns", F.posexplode(targets).alias("example", "at"))
    last = F.get("turns", F.col("at"))
    context = F.concat_ws("", F.transform(F.slice("turns", 1, F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))))
    made = one.select("conv_id", "example", context.alias("context"), last["head"].alias("head"), last["body"].alias("body"), last["learn"].alias("learn"))
    return made.select(
        "conv_id",
        "example",
        F.concat("context", "head", "body", F.lit(CLOSE)).alias("text"),
        F.when(F.col("learn"), F.length("context") + F.length("head")).cast("long").alias("loss_start"),
        F.when(F.col("learn"), F.length("body")).cast("long").alias("loss_chars"),
    )


def parse_chat(text: Column) -> Column:
    """The turns of a formatted text, an array of ``struct<role, text>``."""
    parts = F.filter(F.split(text, CLOSE, -1), lambda x: x != "")
    body = F.transform(parts, lambda x: F.substring(x, len(OPEN) + 1, F.length(x)))
    return F.transform(
        body,
        lambda x: F.struct(
            unescape(F.replace(F.substring_index(x, "\n", 1), F.lit(LINE), F.lit("\n"))).alias("role"),
            unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text"),
        ),
    )


def loss_text(text: Column, start: Column, chars: Column) -> Column:
    """The trainable span as it was said; null without one."""
    return unescape(F.substring(text, (start + 1).cast("int"), chars.cast("int")))
