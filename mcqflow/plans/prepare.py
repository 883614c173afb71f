"""Fine-tuning preparation from question rows to token rows and training batches."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from mcqflow.functions.answers import answer_letter
from mcqflow.functions.chat import CHATML, ChatTemplate
from mcqflow.functions.labels import mask_prompt
from mcqflow.functions.prompts import build_prompt
from mcqflow.functions.tokens import attention_mask
from mcqflow.operators.accuracy import subject_or_blank
from mcqflow.operators.batching import SEED, pad_to_width, permuted_rows, shuffle_rows, with_batch, with_width
from mcqflow.operators.contract import enforce_mcq

MAX_SEQ_LEN = 1024
_ORDERS = {"digest": shuffle_rows, "computed": permuted_rows}


def exam_texts(
    df: DataFrame,
    template: str = "simple_exam",
    chat: ChatTemplate = CHATML,
    enable_thinking: bool = False,
    on_invalid: str = "raise",
) -> DataFrame:
    """Add ``gold``, ``prompt_text`` and ``full_text`` to question rows."""
    rows = enforce_mcq(df, on_invalid)
    mode = "null" if on_invalid == "null" else "raise"
    question = build_prompt(template, F.col("subject"), F.col("question"), F.col("choices"))
    if on_invalid == "null":
        question = F.when(F.size("choices") >= 4, question)
    return (
        rows.withColumns({"gold": answer_letter(F.col("answer"), mode), "_question": question})
        .withColumns(
            {
                "prompt_text": chat.prompt(F.col("_question"), enable_thinking),
                "full_text": chat.dialogue(F.col("_question"), F.col("gold"), enable_thinking),
            }
        )
        .drop("_question")
    )


def eval_prompts(df: DataFrame, keep: Sequence[str] = ("item_id",), **options: Any) -> DataFrame:
    """``prompt_text, gold, subject`` per question; a null subject becomes the empty one."""
    return exam_texts(df, **options).select(
        *keep, "prompt_text", "gold", subject_or_blank(F.col("subject")).alias("subject")
    )


def encode_exam(
    df: DataFrame,
    codec: Any,
    max_seq_len: int = MAX_SEQ_LEN,
    supervised_only: bool = False,
    **options: Any,
) -> DataFrame:
    """Question rows with ``input_ids`` of the full text and the prompt's ``prompt_len``.

    Prompt and full text are measured separately, both cut to ``max_seq_len``.
    ``supervised_only`` leaves out rows whose prompt takes the whole length; it
    compares counts, where a filter on the labels would encode the text again.
    """
    texts = exam_texts(df, **options)
    prompt, full = F.col("prompt_text"), F.col("full_text")
    if supervised_only:
        texts = texts.where(codec.count(prompt, max_seq_len) < codec.count(full, max_seq_len))
    return texts.withColumns(
        {
            "input_ids": codec.encode(full, max_seq_len),
            "prompt_len": codec.count(prompt, max_seq_len),
        }
    )


def prepare_sft(
    df: DataFrame,
    codec: Any,
    max_seq_len: int = MAX_SEQ_LEN,
    keep: Sequence[str] = ("item_id",),
    keep_subject: bool = False,
    flag_mismatch: bool = False,
    **options: Any,
) -> DataFrame:
    """``input_ids, attention_mask, labels`` per question: one projection over the scan.

    The prompt is masked by its count of ids. ``flag_mismatch`` adds whether the
    prompt's ids are not the first ids of the full text, where that count would
    mask the wrong ones.
    """
    encoded = encode_exam(df, codec, max_seq_len, **options)
    ids, prompt_len = F.col("input_ids"), F.col("prompt_len")
    out = [
        *keep,
        ids,
        attention_mask(ids).alias("attention_mask"),
        mask_prompt(ids, prompt_len).alias("labels"),
    ]
    if keep_subject:
        out.append(subject_or_blank(F.col("subject")).alias("subject"))
    if flag_mismatch:
        head = F.slice(ids, 1, prompt_len)
        same = head == codec.encode(F.col("prompt_text"), max_seq_len)
        out.append((~same).alias("prefix_mismatch"))
    return encoded.select(*out)


def batched_rows(df: DataFrame, codec: Any, **options: Any) -> tuple[DataFrame, dict[str, Any]]:
    """The rows that batches are made of, and the options to encode them with afterwards."""
    rows = enforce_mcq(df, options.get("on_invalid", "raise"))
    if options.pop("supervised_only", False):
        columns = rows.columns
        limit = options.get("max_seq_len", MAX_SEQ_LEN)
        rows = encode_exam(rows, codec, limit, True, **{k: v for k, v in options.items() if k != "max_seq_len"}).select(*columns)
    return rows, options | {"on_invalid": "null"}


def training_batches(
    df: DataFrame,
    codec: Any,
    batch_size: int = 1,
    seed: int = SEED,
    epochs: int = 1,
    side: str = "right",
    order: str = "digest",
    **options: Any,
) -> DataFrame:
    """Shuffled, batched and padded training rows: ``epoch, batch_id, slot, item_id`` and arrays.

    Rows that break the contract, and with ``supervised_only`` those without a supervised id,
    leave before the others are numbered, so every batch but the last is full. The source rows are numbered and moved to their batch first; they are encoded
    there, so no id array ever crosses an exchange. Mask and labels are made
    after the width is known: the sort by batch carries the ids alone.

    ``order`` is ``"digest"``, where each epoch is sorted by a digest of its ids, or ``"computed"``, where
    a permutation gives the positions and an epoch's texts cross one exchange, that to their batch.
    """
    if order not in _ORDERS:
        raise ValueError(f"order must be one of {sorted(_ORDERS)}, got {order!r}")
    good, options = batched_rows(df, codec, **options)
    shuffled = with_batch(_ORDERS[order](good, seed, epochs), "position", batch_size)
    placed = shuffled.repartition("epoch", "batch_id")
    columns = ("epoch", "batch_id", "slot", "item_id", "input_ids", "prompt_len")
    encoded = encode_exam(placed, codec, **options).select(*columns)
    ids = F.col("input_ids")
    rows = with_width(encoded, ("epoch", "batch_id")).withColumns(
        {
            "attention_mask": attention_mask(ids),
            "labels": mask_prompt(ids, F.col("prompt_len")),
        }
    )
    return pad_to_width(rows.drop("prompt_len"), codec.pad_id, side)
