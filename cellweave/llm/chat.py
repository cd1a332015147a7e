"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before it as context and only that reply trainable.

Template of a turn: <|im_start|>ROLE, newline, TEXT, <|im_end|>, newline. In texts and roles a backslash is doubled and
<| becomes <\\|, so no text can hold a control string, and both steps are undone one after the other: an inserted
backslash stands alone between < and |, all others come in pairs. A newline in a role becomes <\\/ likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def _alone() -> Column:
    """Tells rows without a conv_id apart."""
    return F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to examples: conv_id, example (from 0), n_turns, text, loss_begin, loss_end.

    loss_begin and loss_end: code points of `text` that are trainable, the target's escaped text. Turns after the last
    assistant turn make an example without trainable text, so that nothing of a conversation is lost. Turns are ordered
    by turn, role and text, nulls first; null roles and texts count as empty; a row without a conv_id is a conversation of
    its own, so that such rows never meet in one place; repeated rows are repeated turns. Columns besides these four are
    left out, whatever their names; no turns give no examples. A conversation has to fit in one row, as its last example
    does.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"), F.concat(head, escape(text), F.lit(END + "\n")).alias("formatted"), F.length(head).alias("head"))
    whole = turns.groupBy("conv_id", _alone().alias("alone")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("turns", i - 1)["role"] == "assistant") | (i == n))
    each = whole.select("conv_id", "turns", F.posexplode(targets).alias("example", "n_turns"))
    target = F.get("turns", F.col("n_turns") - 1)
    joined = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n_turns")), lambda t: t["formatted"]), "")
    each = each.select("conv_id", "example", F.col("n_turns").cast("long"), joined.alias("text"), target.alias("target"))
    begin = F.length("text") - F.length("target.formatted") + F.col("target.head")
    trained = F.col("target.role") == "assistant"
    return each.select(
        "conv_id",
        F.col("example").cast("long"),
        "n_turns",
        "text",
        F.when(trained, begin).otherwise(0).cast("long").alias("loss_begin"),
        F.when(trained, F.length("text") - len(END + "\n")).otherwise(0).cast("long").alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text, escapes undone."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda x: x != "")
    body = lambda x: F.substring(x, F.instr(x, "\n") + 1, F.length(x))
    return F.transform(parts, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring_index(body(x), END, 1)).alias("text")))


def loss_text(text: str = "text") -> Column:
    """The trainable text of an example, escapes undone."""
    return unescape(F.col(text).substr(F.col("loss_begin").cast("int") + 1, (F.col("loss_end") - F.col("loss_begin")).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Read back from examples, a row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all its examples)."""
    rows = examples.select("conv_id", "example", "text", loss_text().alias("loss"))
    whole = rows.groupBy("conv_id", _alone().alias("alone")).agg(
        F.max_by("text", "example").alias("text"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    parsed = parse_turns(F.col("text"))
    flat = F.array_join(F.transform(parsed, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size(parsed).cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
