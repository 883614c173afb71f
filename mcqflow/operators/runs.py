"""Run records: step losses, periodic evaluations, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def mean_loss(steps: DataFrame, all_micro: bool = False) -> DataFrame:
    """``run, train_loss, train_steps``: the mean over workers of each step's loss,
    then the mean over steps.

    Only the last micro-batch of a step, the one at the accumulation boundary,
    counts; ``all_micro`` uses them all. Each level folds inside the tasks
    before its exchange, so neither a hot run nor a hot step lands on one task.
    """
    per_micro = steps.groupBy("run", "step", "micro").agg(
        F.sum("loss").alias("s"), F.count("loss").alias("n")
    )
    grouped = per_micro.groupBy("run", "step")
    if all_micro:
        per_step = grouped.agg((F.sum("s") / F.sum("n")).alias("loss"))
    else:
        per_step = grouped.agg(F.max_by(F.struct("s", "n"), "micro").alias("last")).select(
            "run", "step", (F.col("last.s") / F.col("last.n")).alias("loss")
        )
    return per_step.groupBy("run").agg(
        F.avg("loss").alias("train_loss"), F.count(F.lit(1)).alias("train_steps")
    )


def interval_loss(steps: DataFrame, every: int = 10) -> DataFrame:
    """Mean loss per logging interval of ``every`` steps: interval 0 holds steps 1..every."""
    interval = F.floor((F.col("step") - 1) / every).cast("bigint").alias("interval")
    return steps.groupBy("run", interval).agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("records")
    )


def last_evaluation(evals: DataFrame) -> DataFrame:
    """The newest evaluation of each run, its metrics prefixed ``last_``; of equal steps the one
    with the larger metrics, in column order."""
    metrics = [c for c in evals.columns if c not in ("run", "step")]
    newest = evals.groupBy("run").agg(F.max(F.struct("step", *metrics)).alias("e"))
    return newest.select(
        "run", F.col("e.step").alias("last_step"), *(F.col(f"e.{m}").alias(f"last_{m}") for m in metrics)
    )


def train_record(
    samples: DataFrame, steps: DataFrame, evals: DataFrame | None = None, all_micro: bool = False
) -> DataFrame:
    """One row per run: loss, steps, samples and the last evaluation.

    ``samples`` is ``(run, train_samples)``. A run without steps has loss 0.0.
    """
    record = samples.join(mean_loss(steps, all_micro), "run", "left").select(
        "run",
        F.coalesce("train_loss", F.lit(0.0)).alias("train_loss"),
        F.coalesce("train_steps", F.lit(0)).cast("bigint").alias("train_steps"),
        F.col("train_samples").cast("bigint").alias("train_samples"),
    )
    if evals is None:
        return record
    return record.join(last_evaluation(evals).drop("last_step"), "run", "left")


def checkpoint_steps(checkpoints: DataFrame) -> DataFrame:
    """Rows whose path ends in ``checkpoint-<n>``, with that number as ``step``; a number that
    is no bigint names no checkpoint."""
    number = F.regexp_extract("path", r"(?:^|/)checkpoint-([0-9]+)/?\z", 1)
    return checkpoints.withColumn("_n", number).where("_n <> ''").select(
        "*", F.col("_n").try_cast("bigint").alias("step")
    ).drop("_n").where("step IS NOT NULL")


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint with the largest step number of each run."""
    return (
        checkpoint_steps(checkpoints)
        .groupBy("run")
        .agg(F.max(F.struct("step", "path")).alias("c"))
        .select("run", "c.step", "c.path")
    )


def kept_checkpoints(checkpoints: DataFrame, keep: int = 2) -> DataFrame:
    """The newest ``keep`` checkpoints of each run.

    Spark applies the rank limit inside each task before the exchange, so a run
    with very many checkpoints sends ``keep`` rows per task.
    """
    newest = W.partitionBy("run").orderBy(F.desc("step"), F.desc("path"))
    ranked = checkpoint_steps(checkpoints).withColumn("age", F.row_number().over(newest))
    return ranked.where(F.col("age") <= keep)
