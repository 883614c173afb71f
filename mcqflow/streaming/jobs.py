"""Preparation and scoring of rows that arrive as a stream.

The row-wise functions of this library hold no state: ``prepare_sft`` and
``eval_prompts`` take a streaming table as they are. Here are the stateful
counterparts and the sinks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from mcqflow.functions.answers import is_correct, parse_letter
from mcqflow.operators.accuracy import overall_accuracy, subject_accuracy


def score_arriving(outputs: DataFrame, gold: DataFrame) -> DataFrame:
    """Streaming outputs ``(item_id, output_text, ts)`` against a static gold table.

    The letter is parsed before the join, so texts are not exchanged.
    """
    parsed = outputs.select("item_id", "ts", parse_letter(F.col("output_text")).alias("pred"))
    known = gold.select("item_id", "gold", "subject")
    return parsed.join(known, "item_id").withColumn("correct", is_correct(F.col("pred"), F.col("gold")))


def first_arrivals(scored: DataFrame, interval: str | None = None, delay: str | None = None) -> DataFrame:
    """The first arrival of each item: the smallest ``ts``, of equal ones the smallest letter, and a
    letter before none.

    An aggregate, folded inside each task, so the result depends neither on the order nor on the
    batches in which rows arrive. Without ``interval`` the state is a row for each item of the gold
    table (``update`` or ``complete`` mode, count over the stored snapshot). With it, and ``delay``,
    an item counts once for each interval and closed intervals can be appended and freed.
    """
    rows = scored if delay is None else scored.withWatermark("ts", delay)
    keys = ["item_id"] if interval is None else ["item_id", F.window("ts", interval).alias("w")]
    first = F.min(F.struct("ts", F.col("pred").isNull().alias("none"), "pred", "gold", "subject", "correct")).alias("f")
    fields = [F.col(f"f.{c}") for c in ("ts", "pred", "gold", "subject", "correct")]
    start = [] if interval is None else [F.col("w.start").alias("start")]
    return rows.groupBy(*keys).agg(first).select("item_id", *start, *fields)


def score_awaited(
    asked: DataFrame, outputs: DataFrame, wait: str, delay: str | None = None, keys: Sequence[str] = ("item_id",)
) -> DataFrame:
    """Prompts ``(keys, gold, subject, asked_at)`` beside the outputs ``(keys, output_text, ts)`` that come for them
    from ``asked_at`` until ``wait`` later, both of them streams, or both tables.

    Each output in time gives a row. A prompt without one gives a row without a letter, which is
    wrong; on streams it is appended when the watermarks, ``delay`` behind the latest row of both,
    pass the end of its wait, and both sides' rows are freed by then. A null key never meets an output.
    The letter is parsed before the join, so texts are neither exchanged nor kept.
    """
    parsed = outputs.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "ts", parse_letter(F.col("output_text")).alias("pred"))
    prompts = asked.select(*keys, "gold", "subject", "asked_at")
    if delay is not None:
        prompts, parsed = prompts.withWatermark("asked_at", delay), parsed.withWatermark("ts", delay)
    in_time = F.col("ts").between(F.col("asked_at"), F.col("asked_at") + F.expr(f"INTERVAL {wait}"))
    for k in keys:
        in_time = in_time & (F.col(k) == F.col(f"_of_{k}"))
    joined = prompts.join(parsed, in_time, "left_outer")
    return joined.select(
        *keys, "asked_at", "ts", "gold", "subject", "pred", is_correct(F.col("pred"), F.col("gold")).alias("correct")
    )


def running_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy per subject of everything so far (``update`` or ``complete`` mode)."""
    return subject_accuracy(scored)


def interval_accuracy(
    scored: DataFrame, interval: str, delay: str | None = None, by: Sequence[str] = ("subject",)
) -> DataFrame:
    """Accuracy per tumbling interval of ``ts``. With ``delay`` closed intervals can be
    appended and their state freed; rows later than that are dropped."""
    rows = scored if delay is None else scored.withWatermark("ts", delay)
    spans = rows.withColumn("w", F.window("ts", interval))
    return overall_accuracy(spans, ["w", *by]).select(
        F.col("w.start").alias("start"), *by, "correct", "total", "acc"
    )


def running_loss(steps: DataFrame, interval: str, delay: str | None = None) -> DataFrame:
    """Mean loss per run and tumbling interval of ``ts``."""
    rows = steps if delay is None else steps.withWatermark("ts", delay)
    return rows.groupBy("run", F.window("ts", interval).alias("w")).agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("records")
    ).select("run", F.col("w.start").alias("start"), "loss", "records")


def append_to(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append finished rows to a parquet table, then stop at the end of what is there."""
    writer = stream.writeStream.format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (
        writer.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def snapshot_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the whole current result of a streaming aggregation as a parquet table, partitioned
    by ``version``: a new folder for each micro-batch, so that readers never see one missing.
    A repeated micro-batch writes its own version again. ``read_snapshot`` reads the newest.
    """

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return (
        stream.writeStream.foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest version of a snapshot; only its folder is read."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("version", LongType())])).parquet(path)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).drop("version")
