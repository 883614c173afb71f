"""Streams give what the batch form gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mcqflow import fixtures as fx
from mcqflow.catalogue import queries
from mcqflow.functions.tokens import ByteCodec
from mcqflow.operators.runs import interval_loss
from mcqflow.plans.prepare import prepare_sft
from mcqflow.sources.shared import shared_folder
from mcqflow.streaming import jobs

BYTES = ByteCodec()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def as_stream(spark, df, files=3):
    path = shared_folder(spark) + "/in"
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_preparation(spark, folder):
    items = fx.questions(spark, folder)
    out = shared_folder(spark)
    rows_in = prepare_sft(as_stream(spark, items), BYTES)
    jobs.append_to(rows_in, out + "/rows", out + "/state").awaitTermination()
    assert rows(spark.read.parquet(out + "/rows"), "item_id") == rows(prepare_sft(items, BYTES), "item_id")


def test_running_accuracy_and_repeats(spark):
    times = spark.range(60).select(
        (F.col("id") % 20).alias("item_id"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.concat(F.lit("("), F.when(F.col("id") % 2 == 0, "A").otherwise("B"), F.lit(")")).alias("output_text"),
    )
    gold = spark.range(20).select(
        F.col("id").alias("item_id"), F.lit("A").alias("gold"), (F.col("id") % 3).cast("string").alias("subject")
    )

    def settle(stream):
        out = shared_folder(spark)
        jobs.snapshot_to(stream, out + "/result", out + "/state").awaitTermination()
        return jobs.read_snapshot(spark, out + "/result", stream.schema)

    batch = jobs.score_arriving(times, gold)
    scored = jobs.score_arriving(as_stream(spark, times), gold)
    assert rows(settle(jobs.running_accuracy(scored)), "subject") == rows(jobs.running_accuracy(batch), "subject")
    got = settle(jobs.interval_accuracy(scored, "10 minutes"))
    assert rows(got, "start", "subject") == rows(jobs.interval_accuracy(batch, "10 minutes"), "start", "subject")
    expected = rows(jobs.first_arrivals(batch), "item_id")
    for records in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        once = settle(jobs.first_arrivals(jobs.score_arriving(as_stream(spark, times), gold)))
        assert rows(once, "item_id") == expected
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r[0], r[1].timestamp()) for r in expected] == [(i, 60.0 * i) for i in range(20)]


def test_first_arrival_is_defined_for_ties(spark):
    at = F.timestamp_seconds(F.lit(5))
    data = spark.createDataFrame([(1, "C"), (1, None), (1, "B"), (2, None), (2, "D")], "item_id bigint, pred string")
    scored = data.select("item_id", at.alias("ts"), "pred", F.lit("B").alias("gold"), F.lit("s").alias("subject"), (F.col("pred") == "B").alias("correct"))
    assert [(r[0], r[2]) for r in rows(jobs.first_arrivals(scored), "item_id")] == [(1, "B"), (2, "D")]
    by_hour = jobs.first_arrivals(scored.unionByName(scored.withColumn("ts", F.timestamp_seconds(F.lit(4000)))), "1 hour")
    assert by_hour.count() == 4


def test_closed_intervals_are_appended(spark):
    steps = spark.range(100).select(
        F.lit("r").alias("run"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("loss")
    )
    out = shared_folder(spark)
    stream = jobs.running_loss(as_stream(spark, steps, 1), "10 minutes", "1 minute")
    jobs.append_to(stream, out + "/rows", out + "/state").awaitTermination()
    closed = rows(spark.read.parquet(out + "/rows"), "start")
    assert closed == rows(jobs.running_loss(steps, "10 minutes"), "start")[: len(closed)] and len(closed) >= 9


def test_interval_loss_batch_twin(spark):
    log = spark.range(40).select(
        F.lit("r").alias("run"), (F.col("id") + 1).alias("step"), F.col("id").cast("double").alias("loss")
    )
    assert rows(interval_loss(log, 10).select("interval", "loss", "records"), "interval") == [
        (i, 10 * i + 4.5, 10) for i in range(4)
    ]


def test_outputs_that_never_come_are_wrong(spark):
    """Two streams in several batches append what the batch form gives, but for prompts still waiting."""
    asked = spark.range(60).select(
        (F.col("id") % 25).alias("item_id"),
        F.lit("A").alias("gold"),
        (F.col("id") % 3).cast("string").alias("subject"),
        F.timestamp_seconds(F.col("id") * 60 + 10**9).alias("asked_at"),
    )
    outputs = spark.range(0, 60, 3).select(
        (F.col("id") % 25).alias("item_id"),
        F.when(F.col("id") % 2 == 0, "(A)").otherwise("B").alias("output_text"),
        F.timestamp_seconds(F.col("id") * 60 + 90 + 10**9).alias("ts"),
    )
    columns = ["item_id", "asked_at", "ts", "gold", "subject", "pred", "correct"]
    every = [tuple(r) for r in jobs.score_awaited(asked, outputs, "5 MINUTES").select(columns).collect()]
    out = shared_folder(spark)
    # Rows come in any order within the delay, so nothing is late.
    stream = jobs.score_awaited(as_stream(spark, asked), as_stream(spark, outputs), "5 MINUTES", "2 hours")
    jobs.append_to(stream, out + "/rows", out + "/state").awaitTermination()
    early = [tuple(r) for r in spark.read.schema(stream.schema).parquet(out + "/rows").select(columns).collect()]
    assert sorted(early, key=repr) == sorted((r for r in every if r[2] is not None), key=repr)
    stream = jobs.score_awaited(as_stream(spark, asked, 1), as_stream(spark, outputs, 1), "5 MINUTES", "10 minutes")
    jobs.append_to(stream, out + "/rows2", out + "/state2").awaitTermination()
    late = [tuple(r) for r in spark.read.schema(stream.schema).parquet(out + "/rows2").select(columns).collect()]
    mark = 10**9 + 57 * 60 + 90 - 600  # ten minutes before the latest row of the slower stream
    due = [r for r in every if r[2] is not None or r[1].timestamp() + 300 < mark]
    assert sorted(late, key=repr) == sorted(due, key=repr) and len(early) < len(late) < len(every)
    assert not any(r[-1] for r in late if r[2] is None)


@pytest.fixture(scope="module")
def arrivals(spark):
    """Three parts in one small file, whose rows are spread, and events that answer them: one comes twice,
    one has no letter, one meets no part and one has no user."""
    out = shared_folder(spark)
    parts = [(k, f"part {k}", "Brand#11", kind) for k, kind in ((1, "x"), (2, "y"), (4, "y"))]
    names = "p_partkey bigint, p_name string, p_brand string, p_type string"
    spark.createDataFrame(parts, names).coalesce(1).write.parquet(out + "/part.parquet")
    hours = [(5, 0, 1, 10.0), (4, 1, 1, 10.0), (2, 0, 2, 10.0), (2, 0, 2, 10.0), (0, 2, 4, 90.0), (8, 3, 4, 10.0)]
    hours += [(1, 9, 3, 10.0), (3, 9, None, 10.0)]
    events = spark.createDataFrame(hours, "event_id bigint, hour bigint, user_id bigint, value double")
    ts = F.timestamp_seconds(F.col("hour") * 3600).alias("ts")
    events.select("event_id", ts, "user_id", "value").coalesce(1).write.parquet(out + "/events.parquet")
    return out


def test_accuracy_of_first_arrivals_with_spread_gold(spark, arrivals):
    got = queries.t2_deduplicated_accuracy(spark, arrivals)
    assert rows(got.select("subject", "correct", "total"), "subject") == [("x", 1, 1), ("y", 1, 2)]


def test_first_arrivals_with_spread_gold(spark, arrivals):
    got = rows(queries.t2_first_arrivals(spark, arrivals).select("item_id", "ts", "pred", "correct"), "item_id")
    assert got == [
        (1, "1970-01-01 00:00:00", "B", True),
        (2, "1970-01-01 00:00:00", "C", True),
        (4, "1970-01-01 02:00:00", None, False),
    ]


def test_interval_accuracy_with_spread_gold(spark, arrivals):
    """Only the first hour is closed: the latest row that meets a part is two hours past its end."""
    got = queries.t2_interval_accuracy(spark, arrivals).select("start", "subject", "correct", "total")
    assert rows(got, "subject") == [("1970-01-01 00:00:00", "x", 1, 1), ("1970-01-01 00:00:00", "y", 2, 2)]


def test_running_accuracy_with_spread_gold(spark, arrivals):
    """A row that comes twice counts twice."""
    got = queries.t2_running_accuracy(spark, arrivals)
    assert rows(got.select("subject", "correct", "total"), "subject") == [("x", 1, 2), ("y", 3, 4)]
