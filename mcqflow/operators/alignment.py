"""Pairing model outputs with gold rows by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def for_runs(gold: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Each gold row once per run, so that an item a run never answered still counts."""
    return gold.withColumn("run", F.explode(F.array(*(F.lit(r) for r in runs))))


def unique_outputs(
    outputs: DataFrame, keys: Sequence[str] = ("item_id",), on_duplicate: str = "raise"
) -> DataFrame:
    """At most one output per key. Repeats are an error, or with ``least`` the
    smallest value is kept, whatever order rows arrive in.

    Partial aggregation folds repeats before the exchange, and the exchange is
    the one the following join needs.
    """
    if on_duplicate not in ("raise", "least"):
        raise ValueError(f"on_duplicate must be 'raise' or 'least', got {on_duplicate!r}")
    values = [c for c in outputs.columns if c not in keys]
    value = F.struct(*values) if len(values) != 1 else F.col(values[0])
    folded = outputs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), F.min(value).alias("_value")
    )
    if on_duplicate == "raise":
        fail = F.raise_error(F.lit("more than one output for an item")).cast("boolean")
        folded = folded.where(F.when(F.col("_copies") == 1, F.lit(True)).otherwise(fail))
    if len(values) == 1:
        return folded.select(*keys, F.col("_value").alias(values[0]))
    return folded.select(*keys, *(F.col("_value")[c].alias(c) for c in values))


def align_outputs(
    gold: DataFrame,
    outputs: DataFrame,
    keys: Sequence[str] = ("item_id",),
    on_duplicate: str = "raise",
) -> DataFrame:
    """Gold rows with their outputs; a gold row without an output keeps nulls."""
    return gold.join(unique_outputs(outputs, keys, on_duplicate), list(keys), "left")
