"""The multiple-choice row contract: what a row must hold before anything is built from it."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from mcqflow.functions.answers import LETTERS, answer_letter

REQUIRED = ("item_id", "question", "choices", "answer")
MODES = ("raise", "null", "quarantine")


def with_contract_columns(df: DataFrame) -> DataFrame:
    """Check the required columns exist, add a null ``subject`` if absent, and make
    a boolean answer an integer one."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if "subject" not in df.columns:
        df = df.withColumn("subject", F.lit(None).cast("string"))
    if isinstance(df.schema["answer"].dataType, BooleanType):
        df = df.withColumn("answer", F.col("answer").cast("int"))
    return df


def _options() -> list[Column]:
    return [F.get(F.col("choices"), F.lit(i)) for i in range(len(LETTERS))]


def is_valid() -> Column:
    """Whether a row keeps the contract, in few and cheap terms."""
    letter = answer_letter(F.col("answer"), "null")
    terms = [F.col("item_id"), F.col("question"), *_options(), letter]
    return reduce(and_, (t.isNotNull() for t in terms))


def invalid_reason() -> Column:
    """Why a row breaks the contract, or null."""
    choices = F.col("choices")
    empty = reduce(or_, (c.isNull() for c in _options()))
    return (
        F.when(is_valid(), F.lit(None).cast("string"))
        .when(F.col("item_id").isNull(), "missing item_id")
        .when(F.col("question").isNull(), "missing question")
        .when(choices.isNull(), "missing choices")
        .when(F.size(choices) < len(LETTERS), "fewer than four choices")
        .when(empty, "null choice")
        .when(F.col("answer").isNull(), "missing answer")
        .otherwise("invalid answer")
    )


def check_mcq(df: DataFrame) -> DataFrame:
    """Add ``invalid_reason``: null for a good row."""
    return with_contract_columns(df).withColumn("invalid_reason", invalid_reason())


def split_mcq(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows in quarantine with their reason), both lazy."""
    return with_contract_columns(df).where(is_valid()), check_mcq(df).where(~is_valid())


def enforce_mcq(df: DataFrame, on_invalid: str = "raise") -> DataFrame:
    """Rows that satisfy the contract.

    ``raise`` fails the job on the first bad row. The check sits in a filter, so
    column pruning cannot remove it. ``quarantine`` keeps only good rows (take
    the others from ``split_mcq``). ``null`` keeps every row; an answer that
    cannot be read and a prompt that cannot be built become null later.
    """
    if on_invalid not in MODES:
        raise ValueError(f"on_invalid must be one of {MODES}, got {on_invalid!r}")
    if on_invalid == "null":
        return with_contract_columns(df)
    if on_invalid == "quarantine":
        return split_mcq(df)[0]
    fail = F.raise_error(F.concat(F.lit("invalid row: "), invalid_reason())).cast("boolean")
    return with_contract_columns(df).where(F.when(is_valid(), F.lit(True)).otherwise(fail))
