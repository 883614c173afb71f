"""Evaluation by generated answers or by the first supervised token."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from mcqflow.functions.answers import is_correct, parse_letter
from mcqflow.functions.labels import token_at
from mcqflow.functions.tokens import cut_prompt
from mcqflow.operators.accuracy import (
    result_record,
    result_rows,
    score_letters,
    subject_accuracy,
    subject_or_blank,
)
from mcqflow.operators.alignment import align_outputs, for_runs
from mcqflow.operators.predict import (
    first_token_ordered_predictor,
    first_token_predictor,
    run_predictor,
)
from mcqflow.operators.selection import exact_batches
from mcqflow.plans.prepare import MAX_SEQ_LEN, batched_rows, encode_exam, eval_prompts
from mcqflow.sources.sinks import write_prepared

PROMPT_MAX_LENGTH = 2048
MAX_NEW_TOKENS = 5
TEMPERATURE = 0.0


@dataclass(frozen=True)
class Evaluation:
    """An evaluation as tables: flagged rows, per-subject counts and the record."""

    metric: str
    scored: DataFrame
    subjects: DataFrame

    @property
    def record(self) -> DataFrame:
        return result_record(self.subjects, self.metric)

    @property
    def rows(self) -> DataFrame:
        """The record in long form, for any number of subjects."""
        return result_rows(self.subjects, self.metric)


def _evaluation(metric: str, scored: DataFrame) -> Evaluation:
    return Evaluation(metric, scored, subject_accuracy(scored))


def _with_letters(
    gold: DataFrame, outputs: DataFrame, keys: Sequence[str], on_duplicate: str
) -> DataFrame:
    """Gold rows with the letter of their output and whether it is right.

    The letter is parsed where the output is read and travels as its character
    code: a number folds in a hash aggregate, and no text is exchanged or sorted.
    """
    code = F.ascii(parse_letter(F.col("output_text"))).alias("code")
    aligned = align_outputs(gold, outputs.select(*keys, code), keys, on_duplicate)
    scored = aligned.withColumn("pred", F.char("code")).drop("code")
    return scored.withColumn("correct", is_correct(F.col("pred"), F.col("gold")))


def evaluate_outputs(
    df: DataFrame, outputs: DataFrame, on_duplicate: str = "raise", **options: Any
) -> Evaluation:
    """Score a table of outputs ``(item_id, output_text)`` made elsewhere. Of repeated
    outputs ``on_duplicate="least"`` keeps the first letter in the alphabet."""
    gold = eval_prompts(df, **options).drop("prompt_text")
    return _evaluation("generate", _with_letters(gold, outputs, ("item_id",), on_duplicate))


def score_runs(
    df: DataFrame,
    outputs: DataFrame,
    runs: Sequence[str],
    on_duplicate: str = "raise",
    **options: Any,
) -> DataFrame:
    """Scored rows of several runs from one table ``(run, item_id, output_text)``; an item
    a run never answered counts as wrong."""
    gold = for_runs(eval_prompts(df, **options).drop("prompt_text"), runs)
    return _with_letters(gold, outputs, ("run", "item_id"), on_duplicate)


def evaluate_generated(
    df: DataFrame,
    load: Callable[[], Callable[..., Sequence[Any]]],
    codec: Any = None,
    batch_size: int = 4,
    max_new_tokens: int = MAX_NEW_TOKENS,
    temperature: float = TEMPERATURE,
    prompt_max_length: int = PROMPT_MAX_LENGTH,
    outputs_path: str | None = None,
    **options: Any,
) -> Evaluation:
    """Prompt, let the user's model answer, parse the letter and count.

    With a ``codec`` the model takes id lists (the prompt cut to
    ``prompt_max_length`` ids) and returns prompt and answer ids; without one it
    takes and returns text. Gold and subject ride along, so nothing is joined
    and the only exchange is that of the per-subject counts. ``outputs_path``
    stores the answers first: lost executors then cost no second generation.
    """
    prompts = eval_prompts(df, **options)
    asked = {"batch_size": batch_size, "max_new_tokens": max_new_tokens, "temperature": temperature}
    if codec is None:
        answered = run_predictor(prompts, load, "prompt_text", "output_text", **asked).drop("prompt_text")
    else:
        ids = codec.encode(F.col("prompt_text"), prompt_max_length)
        encoded = prompts.select("item_id", "gold", "subject", ids.alias("input_ids"))
        answered = run_predictor(encoded, load, "input_ids", "output_ids", "array<int>", **asked)
        suffix = cut_prompt(F.col("output_ids"), F.size("input_ids"))
        answered = answered.select("item_id", "gold", "subject", codec.decode(suffix).alias("output_text"))
    if outputs_path is not None:
        answered = write_prepared(answered, outputs_path, partition_by=())
    return _evaluation("generate", score_letters(answered))


def first_token_rows(
    df: DataFrame,
    codec: Any,
    max_seq_len: int = MAX_SEQ_LEN,
    shift: int = 0,
    keep: Sequence[str] = ("item_id",),
    **options: Any,
) -> DataFrame:
    """Token rows with ``pos`` to score and ``gold_token``, both null where no label is
    supervised.

    The first supervised position of a question is its prompt's length, so no
    labels are made. Rows without one are left for the predictor to drop: a
    filter here would be pushed below the encoding and encode the text again.
    """
    rows = encode_exam(df, codec, max_seq_len, **options)
    ids, prompt_len = F.col("input_ids"), F.col("prompt_len")
    return rows.select(
        *keep,
        subject_or_blank(F.col("subject")).alias("subject"),
        F.when(prompt_len < F.size(ids), prompt_len - shift).alias("pos"),
        token_at(ids, prompt_len).alias("gold_token"),
        ids,
    )


def _first_token_evaluation(predicted: DataFrame) -> Evaluation:
    flag = is_correct(F.col("pred_token"), F.col("gold_token")).alias("correct")
    return _evaluation(
        "first_token", predicted.select("item_id", "subject", "gold_token", "pred_token", flag)
    )


def evaluate_first_token(
    df: DataFrame,
    load: Callable[[], Callable[..., Any]],
    codec: Any,
    batch_size: int = 8,
    max_seq_len: int = MAX_SEQ_LEN,
    shift: int = 0,
    **options: Any,
) -> Evaluation:
    """First-token accuracy. Batches are cut and padded inside each task: which rows
    share a batch does not change a prediction, so rows are neither numbered nor moved."""
    rows = first_token_rows(df, codec, max_seq_len, shift, **options)
    asked = rows.select("item_id", "subject", "gold_token", "pos", "input_ids")
    return _first_token_evaluation(first_token_predictor(asked, load, codec.pad_id, batch_size))


def evaluate_first_token_batched(
    df: DataFrame,
    load: Callable[[], Callable[..., Any]],
    codec: Any,
    batch_size: int = 8,
    max_seq_len: int = MAX_SEQ_LEN,
    shift: int = 0,
    **options: Any,
) -> Evaluation:
    """As ``evaluate_first_token`` for a model that needs the exact consecutive batches:
    the rows that keep the contract are moved once, to partitions that begin and end with a batch
    in item order, and encoded and padded there."""
    good, options = batched_rows(df, codec, max_seq_len=max_seq_len, **options)
    options.pop("max_seq_len")
    batched = exact_batches(good, batch_size)
    rows = first_token_rows(batched, codec, max_seq_len, shift, ("item_id", "batch_id"), **options)
    return _first_token_evaluation(first_token_ordered_predictor(rows, load, codec.pad_id))


def evaluate(metric: str, df: DataFrame, load: Callable[[], Any], codec: Any = None, **options: Any) -> Evaluation:
    """The evaluation of the named metric; an unknown name fails while planning."""
    if metric == "generate":
        return evaluate_generated(df, load, codec, **options)
    if metric == "first_token":
        return evaluate_first_token(df, load, codec, **options)
    raise ValueError(f"metric must be 'generate' or 'first_token', got {metric!r}")
