"""Multi-turn conversations: message lists, rendered text, assistant-only labels.

One row per conversation, whatever its turn numbers; ``(conv_id, turn)`` must be unique (fold
repeats first with ``unique_outputs(messages, ("conv_id", "turn"))``). A whole conversation is
a row of its own size. Where one may be too large for that, ``render_turns`` gives its turns
with their offsets, and ``supervise_dialogues`` drops what lies behind ``max_seq_len`` before
anything is collected, so that limit bounds the row.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from mcqflow.functions.chat import CHATML, ChatTemplate
from mcqflow.functions.labels import ignored
from mcqflow.functions.tokens import attention_mask, truncate
from mcqflow.operators.numbering import running_sum

_FIELDS = ("conv_id", "turn", "role", "text")


def invalid_message() -> Column:
    """Why a message can't be rendered, or null."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in _FIELDS]
    return F.coalesce(*missing)


def split_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages of whole conversations, messages of those in which one is invalid, with the reason)."""
    bad = messages.where(invalid_message().isNotNull()).select(F.col("conv_id").alias("_bad")).distinct()
    same = F.col("conv_id").eqNullSafe(F.col("_bad"))
    held = messages.join(bad, same, "left_semi").withColumn("invalid_reason", invalid_message())
    return messages.join(bad, same, "left_anti"), held


def enforce_messages(messages: DataFrame, on_invalid: str = "raise") -> DataFrame:
    """Messages that can be rendered. ``raise`` fails the job on a bad one; ``quarantine`` leaves
    out its whole conversation, which ``split_messages`` gives."""
    if on_invalid == "quarantine":
        return split_messages(messages)[0]
    if on_invalid != "raise":
        raise ValueError(f"on_invalid must be 'raise' or 'quarantine', got {on_invalid!r}")
    fail = F.raise_error(F.concat(F.lit("invalid message: "), invalid_message())).cast("boolean")
    # Not deterministic, so that the check isn't pushed below a join that leaves bad messages out.
    here = F.monotonically_increasing_id() >= 0
    return messages.where(F.when(invalid_message().isNull(), here).otherwise(fail))


def _in_turn_order(messages: DataFrame, value: Column, out: str) -> DataFrame:
    grouped = messages.select("conv_id", F.struct("turn", value.alias("v")).alias("t")).groupBy("conv_id")
    return grouped.agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.v").alias(out))


def assemble_messages(messages: DataFrame, on_invalid: str = "raise") -> DataFrame:
    """``(conv_id, messages array<struct<role,content>>)`` in turn order."""
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    return _in_turn_order(enforce_messages(messages, on_invalid), message, "messages")


def render_dialogues(
    messages: DataFrame,
    template: ChatTemplate = CHATML,
    on_invalid: str = "raise",
    generation: bool = False,
    enable_thinking: bool = False,
) -> DataFrame:
    """``(conv_id, turns, text)``: turns rendered where they are read, then joined.

    ``generation`` ends the text with the head of the assistant's answer.
    """
    good = enforce_messages(messages, on_invalid)
    rendered = _in_turn_order(good, template.turn(F.col("role"), F.col("text")), "turns")
    end = template.answer_head(enable_thinking) if generation else ""
    text = F.concat(F.array_join("turns", ""), F.lit(end))
    return rendered.select("conv_id", F.size("turns").alias("turns"), text.alias("text"))


def render_turns(messages: DataFrame, template: ChatTemplate = CHATML, on_invalid: str = "raise") -> DataFrame:
    """``(conv_id, turn, text, offset)``: the rendered turns and the characters before each.

    Offsets are prefix sums over buckets of turns, so a conversation of any length is spread.
    """
    text = template.turn(F.col("role"), F.col("text"))
    rows = enforce_messages(messages, on_invalid).select("conv_id", "turn", text.alias("text"))
    summed = running_sum(rows.withColumn("_n", F.length("text")), "_n", "turn", "offset", ["conv_id"])
    return summed.select("conv_id", "turn", "text", "offset")


def supervise_dialogues(
    messages: DataFrame,
    codec: Any,
    template: ChatTemplate = CHATML,
    max_seq_len: int | None = None,
    on_invalid: str = "raise",
) -> DataFrame:
    """Ids, mask and labels of whole conversations, supervised on assistant turns only.

    What an assistant turn's content and closing string encode to is
    supervised; every other id, the head of the assistant turn included, is
    ignored. Turns are encoded one by one. With ``max_seq_len`` turns that start
    behind it go before the rest is collected, and the arrays are cut there.
    """
    good = enforce_messages(messages, on_invalid)
    head = codec.encode(template.head(F.col("role")))
    body = codec.encode(F.concat(F.col("text"), F.lit(template.close)))
    encoded = good.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    if max_seq_len is not None:
        sized = encoded.withColumn("_n", F.size("head") + F.size("body"))
        starts = running_sum(sized, "_n", "turn", "_start", ["conv_id"]).where(F.col("_start") < max_seq_len)
        encoded = starts.withColumn("body", F.slice("body", 1, max_seq_len))
    taught = F.col("role") == template.assistant
    turn = F.struct(
        F.concat("head", "body").alias("ids"),
        F.concat(
            ignored(F.size("head")),
            F.when(taught, F.col("body")).otherwise(ignored(F.size("body"))),
        ).alias("labels"),
    )
    rows = _in_turn_order(encoded, turn, "turns")
    ids = truncate(F.flatten(F.col("turns.ids")), max_seq_len)
    labels = truncate(F.flatten(F.col("turns.labels")), max_seq_len)
    return rows.select(
        "conv_id", ids.alias("input_ids"), attention_mask(ids).alias("attention_mask"), labels.alias("labels")
    )
