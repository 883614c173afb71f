"""Shuffling, batching, padding and the training manifest.

Number and batch the compact source rows first and encode them afterwards
(``plans.prepare.training_batches``): both exchanges then carry text, and the
wide id arrays are made and padded where the batch already is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mcqflow.functions.labels import IGNORE
from mcqflow.functions.permutation import permuted
from mcqflow.operators.numbering import hashed_index, row_index

SEED = 42


def shuffle_key(seed: int, epoch: Column, item: Column) -> Column:
    """Digest that orders an epoch. Unlike ``rand()`` it is the same after a retry."""
    return F.md5(
        F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), item.cast("string"))
    )


def shuffle_rows(
    df: DataFrame, seed: int = SEED, epochs: int = 1, item: str = "item_id", hex_digits: int = 4
) -> DataFrame:
    """Every row once per epoch with its ``position`` in that epoch's random order."""
    runs = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = shuffle_key(seed, F.col("epoch"), F.col(item))
    return hashed_index(
        runs, key, "position", within=["epoch"], groups=epochs, hex_digits=hex_digits
    )


def permuted_rows(df: DataFrame, seed: int = SEED, epochs: int = 1, item: str = "item_id") -> DataFrame:
    """Every row once per epoch with its ``position``, which a keyed permutation computes from the rank of
    the unique integer ``item``. No epoch is sorted, and none of its rows are moved for it.

    One aggregate over ``item`` runs when this is called. Ids without gaps are their own ranks; others
    are numbered first, in one exchange for all epochs. Null ids have no rank and are an error.
    """
    low, high, known, rows = df.agg(F.min(item), F.max(item), F.count(item), F.count(F.lit(1))).first()
    if known < rows:
        raise ValueError(f"{rows - known} rows have no {item}")
    if rows and high - low + 1 == rows:
        ranked = df.withColumn("_rank", F.col(item).cast("bigint") - F.lit(low))
    else:
        ranked = row_index(df, item, "_rank")
    runs = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"))
    return runs.withColumn("position", permuted(F.col("_rank"), rows, key)).drop("_rank")


def with_batch(df: DataFrame, index: str, batch_size: int) -> DataFrame:
    """Fixed-size consecutive batches over a 0-based index; the last one may be short."""
    at = F.col(index)
    return df.withColumn("batch_id", F.floor(at / batch_size).cast("bigint")).withColumn(
        "slot", (at % batch_size).cast("int")
    )


def consecutive_batches(df: DataFrame, batch_size: int, item: str = "item_id") -> DataFrame:
    """Batches in the order of ``item``, as an evaluation reads them."""
    return with_batch(row_index(df, item), "row_index", batch_size).drop("row_index")


def assign_steps(df: DataFrame, world: int = 1, accumulation: int = 1) -> DataFrame:
    """Rank, micro-batch and 0-based optimizer step within the epoch for each batch."""
    local = F.floor(F.col("batch_id") / world)
    return df.withColumns(
        {
            "rank": (F.col("batch_id") % world).cast("int"),
            "micro": (local % accumulation).cast("int"),
            "step": F.floor(local / accumulation).cast("bigint"),
        }
    )


def training_manifest(
    df: DataFrame,
    batch_size: int = 1,
    world: int = 1,
    accumulation: int = 1,
    epochs: float = 1,
    seed: int = SEED,
    item: str = "item_id",
) -> DataFrame:
    """Where each item goes: ``epoch, step, rank, micro, batch_id, slot, item``.

    With a fraction of an epoch the last one stops at the total number of steps; that is
    counted when this is called.
    """
    shuffled = shuffle_rows(df.select(item), seed, math.ceil(epochs), item)
    placed = assign_steps(with_batch(shuffled, "position", batch_size), world, accumulation)
    if epochs != int(epochs):
        totals = step_totals(df.select(item), batch_size, accumulation, world, epochs).first()
        placed = placed.where(F.col("epoch") * totals.steps_per_epoch + F.col("step") < totals.total_steps)
    return placed.select("epoch", "step", "rank", "micro", "batch_id", "slot", item)


def step_totals(
    df: DataFrame,
    batch_size: int = 1,
    accumulation: int = 1,
    world: int = 1,
    epochs: float = 1.0,
    warmup_ratio: float = 0.03,
) -> DataFrame:
    """One row of step counts. Needs only the row count, so it never shuffles rows."""
    batches = F.ceil(F.col("samples") / batch_size)
    return (
        df.agg(F.count(F.lit(1)).alias("samples"))
        .withColumn("batches", batches.cast("bigint"))
        .withColumn(
            "steps_per_epoch",
            F.ceil(F.ceil(F.col("batches") / world) / accumulation).cast("bigint"),
        )
        .withColumn(
            "total_steps", F.floor(F.lit(float(epochs)) * F.col("steps_per_epoch")).cast("bigint")
        )
        .withColumn(
            "warmup_steps",
            F.floor(F.col("total_steps") * F.lit(float(warmup_ratio))).cast("bigint"),
        )
    )


def step_table(manifest: DataFrame) -> DataFrame:
    """The steps of a manifest, numbered from 1 through all epochs, with their item count.

    The per-epoch maxima come from the already aggregated steps and number one
    row per epoch.
    """
    steps = manifest.groupBy("epoch", "step").agg(F.count(F.lit(1)).alias("items"))
    lengths = steps.groupBy("epoch").agg((F.max("step") + 1).alias("_steps"))
    before = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    starts = lengths.select(
        "epoch",
        "_steps",
        F.coalesce(F.sum("_steps").over(before), F.lit(0)).alias("_start"),
    )
    return steps.join(starts, "epoch").select(
        "epoch",
        (F.col("_start") + F.col("step") + 1).alias("step"),
        "items",
        (F.col("step") + 1 == F.col("_steps")).alias("ends_epoch"),
    )


def due_steps(steps: DataFrame, every: int | None = None) -> DataFrame:
    """Steps with a save or an evaluation due: each multiple of ``every`` (0 is never),
    or the last step of each epoch when ``every`` is None."""
    if every is None:
        return steps.where("ends_epoch")
    if every <= 0:
        return steps.where(F.lit(False))
    return steps.where(F.col("step") % every == 0)


def _fills(pad_id: int) -> dict[str, int]:
    return {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORE}


def _pad(values: Column, fill: int, width: Column, side: str) -> Column:
    if side not in ("right", "left"):
        raise ValueError(f"side must be 'right' or 'left', got {side!r}")
    filler = F.array_repeat(F.lit(fill), (width - F.size(values)).cast("int"))
    return F.concat(values, filler) if side == "right" else F.concat(filler, values)


def with_width(df: DataFrame, batch: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Add ``width``, the length of the longest ids in the row's batch.

    A batch never exceeds its fixed size, so neither does a window partition.
    """
    return df.withColumn("width", F.max(F.size("input_ids")).over(W.partitionBy(*batch)))


def pad_to_width(df: DataFrame, pad_id: int, side: str = "right") -> DataFrame:
    """Fill ids, mask and labels up to ``width``, which goes."""
    padded = {c: _pad(F.col(c), fill, F.col("width"), side) for c, fill in _fills(pad_id).items()}
    return df.withColumns(padded).drop("width")


def pad_batches(
    df: DataFrame, pad_id: int, batch: Sequence[str] = ("batch_id",), side: str = "right"
) -> DataFrame:
    """Pad ids, mask and labels of each row to the longest row of its batch."""
    return pad_to_width(with_width(df, batch), pad_id, side)


def collate_batches(
    df: DataFrame,
    pad_id: int,
    batch: Sequence[str] = ("batch_id",),
    order: str = "slot",
    keep: Sequence[str] = ("item_id",),
    arrays: Sequence[str] = ("input_ids", "attention_mask", "labels"),
    side: str = "right",
) -> DataFrame:
    """One row per batch holding rectangular ``array<array<int>>`` columns.

    Bounded by the batch size; ``keep`` columns become arrays in row order, and
    ``arrays`` names the id arrays wanted.
    """
    grouped = df.groupBy(*batch).agg(
        F.array_sort(F.collect_list(F.struct(order, *keep, *arrays))).alias("_rows"),
        F.max(F.size(arrays[0])).alias("width"),
    )

    def padded(name: str) -> Column:
        fill = _fills(pad_id)[name]
        return F.transform(F.col(f"_rows.{name}"), lambda r: _pad(r, fill, F.col("width"), side))

    return grouped.select(
        *batch,
        "width",
        *(F.col(f"_rows.{c}").alias(c) for c in keep),
        *(padded(c).alias(c) for c in arrays),
    )
