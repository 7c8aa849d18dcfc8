"""Prefix-target chat formatting: every assistant turn becomes an example of its own, with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: What opens and closes a turn, by role. Any other role is named inside OTHER.
OPEN = {"user": "[INST] ", "assistant": "[ANS] ", "system": "[SYS] "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " [/SYS]"}
OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE = "[ROLE] ", " [/ROLE] ", " [/TURN]"

#: What follows the first character of a control string.
_TAILS = r"/?(?:INST|ANS|SYS|ROLE|TURN)\]|/?s>"
#: One whole turn of a formatted conversation.
TURN = r"(?s)\[(?:INST|ANS|SYS|ROLE)\] .*? (?:\[/INST\]|</s>|\[/SYS\]|\[/TURN\])"


def escape(text: Column) -> Column:
    """The text with one backslash more inside each control string, so that it holds none; `unescape` takes it away."""
    return F.regexp_replace(text, rf"([\[<])(\\*)(?={_TAILS})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)(?={_TAILS})", "$1$2")


def _pick(role: Column, table_: dict[str, str], other: Column) -> Column:
    out = other
    for name, mark in table_.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def prefix_targets(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each assistant turn, and one for the turns that follow the last of them, if any.

    Columns: conv_id; example (from 0 in each conversation); target_turn (place of the reply among the turns, from 0;
    null where no reply is trained); formatted (all turns up to the reply, the reply's turn closed); loss_start and
    loss_length, in characters: the escaped reply within formatted, the only trainable span (0 and 0 without one);
    is_last, of the row that holds every turn of its conversation.

    Each conversation is gathered once (a row of one group must fit in memory, as an example does anyway); its examples
    are prefixes of one string. Null texts and roles count as empty; a null conv_id is a conversation of its own. Turns
    go by turn, then role, then text, so ties and repeated rows all stay, in a fixed order. No rows: no rows.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    body = escape(F.col("t.text"))
    kind = F.col("t.role")
    opened = _pick(kind, OPEN, F.concat(F.lit(OTHER_OPEN), escape(kind), F.lit(OTHER_NAMED)))
    rows = rows.select(
        "conv_id",
        F.struct(F.col("t.turn").alias("turn"), kind.alias("role"), F.col("t.text").alias("raw"), F.concat(opened, body, _pick(kind, CLOSE, F.lit(OTHER_CLOSE))).alias("turn_text"), F.length(body).alias("n")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # ends[k]: characters of all turns up to turn k
    ends = F.aggregate(
        "turns",
        F.array().cast("array<bigint>"),
        lambda a, t: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint")) + F.length(t.turn_text))),
    )
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.n.alias("n"))).alias("turns"), F.array_join(F.transform("turns", lambda t: t.turn_text), "").alias("whole"), ends.alias("ends"))
    last = F.size("turns") - 1
    targets = F.filter(F.transform("turns", lambda t, k: F.when((t.role == "assistant") | (k == last), k)), lambda k: k.isNotNull())
    each = whole.select("conv_id", "turns", "whole", "ends", F.posexplode(targets).alias("example", "k"))
    item, end = F.get("turns", F.col("k")), F.get("ends", F.col("k")).cast("int")
    trained = item["role"] == "assistant"
    return each.select(
        "conv_id",
        "example",
        F.when(trained, F.col("k")).alias("target_turn"),
        F.substring("whole", F.lit(1), end).alias("formatted"),
        F.when(trained, end - len(CLOSE["assistant"]) - item["n"]).otherwise(0).alias("loss_start"),
        F.when(trained, item["n"]).otherwise(0).alias("loss_length"),
        (F.col("k") == last).alias("is_last"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""

    def one(turn: Column) -> Column:
        named = F.lit(OTHER_OPEN)
        out = None
        for name in OPEN:
            a, b = len(OPEN[name]), len(CLOSE[name])
            found = F.struct(F.lit(name).alias("role"), unescape(F.substring(turn, F.lit(a + 1), F.length(turn) - a - b)).alias("text"))
            out = F.when(turn.startswith(OPEN[name]), found) if out is None else out.when(turn.startswith(OPEN[name]), found)
        a, b, mid = len(OTHER_OPEN), len(OTHER_CLOSE), len(OTHER_NAMED)
        at = F.instr(turn, OTHER_NAMED)
        other = F.struct(unescape(F.substring(turn, F.lit(a + 1), at - a - 1)).alias("role"), unescape(F.substring(turn, at + mid, F.length(turn) - at - mid - b + 1)).alias("text"))
        return out.when(turn.startswith(named), other)

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), one)


def trained_text(formatted: Column, loss_start: Column, loss_length: Column) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescape(F.substring(formatted, loss_start + 1, loss_length))


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    examples = prefix_targets(turns)
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("bigint").alias("chars"),
        F.when(F.col("target_turn").isNotNull(), trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))).alias("loss"),
        F.when(F.col("is_last"), parse(F.col("formatted"))).alias("turns"),
    )
    back = read.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x.loss), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("loss").alias("n_examples"),
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
