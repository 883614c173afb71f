"""The physical plans a large table depends on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mcqflow import fixtures as fx
from mcqflow.functions.tokens import ByteCodec
from mcqflow.operators import accuracy, batching, runs, vocabulary as vocab
from mcqflow.plans.evaluate import evaluate_first_token, evaluate_generated, evaluate_outputs
from mcqflow.plans.prepare import eval_prompts, prepare_sft, training_batches
from mcqflow.sources.shared import shared_folder
from mcqflow.sources.sinks import write_prepared

BYTES = ByteCodec()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")


@pytest.fixture(scope="module")
def items(spark, folder):
    return write_prepared(fx.questions(spark, folder), shared_folder(spark) + "/items", partition_by=())


def test_row_wise_jobs_do_not_shuffle(items):
    for df in (eval_prompts(items), prepare_sft(items, BYTES)):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_only_needed_columns_are_scanned(items):
    assert "ReadSchema: struct<item_id:bigint>" in plan(batching.shuffle_rows(items.select("item_id")))
    pruned = eval_prompts(items).select("gold")
    assert "split" not in plan(pruned).split("ReadSchema")[1]


def test_evaluations_exchange_only_counts(items):
    for outcome in (
        evaluate_generated(items, fx.text_model()),
        evaluate_first_token(items, fx.first_token_model(), BYTES),
    ):
        assert exchanges(outcome.subjects) == 1
        assert "partial_sum" in plan(outcome.subjects)


def test_stored_outputs_shuffle_each_side_once(spark, folder, items):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        subjects = evaluate_outputs(items, fx.outputs(spark, folder, "base")).subjects
        assert exchanges(subjects) == 3  # gold, outputs, counts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_are_made_in_two_exchanges_of_text(items):
    text = plan(training_batches(items, BYTES, 8))
    below = text[text.index("Exchange") :]
    assert "input_ids" not in below


def test_retention_ranks_before_the_exchange(spark, folder):
    assert "WindowGroupLimit" in plan(runs.kept_checkpoints(fx.checkpoints(spark, folder)))


def test_inline_vocabulary_needs_no_exchange(spark, folder):
    docs = fx.table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "text")
    table = write_prepared(
        vocab.build_vocabulary(docs, "text", 500), shared_folder(spark) + "/vocabulary", partition_by=()
    )
    codec = vocab.VocabularyCodec.load(table)
    assert "Exchange" not in plan(docs.select(codec.encode(F.col("text"))))
    joined = vocab.encode_by_join(docs, table, "text", codec.unk_id)
    assert exchanges(joined) == 1  # the texts; not the tokens


def test_vectors_are_reduced_before_the_exchange(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = accuracy.score_long_logits(fx.vector_labels(spark, folder), fx.vector_scores(spark, folder))
        for line in plan(scored).split("\n"):
            if "Sort [" in line or "SortMergeJoin" in line:
                assert "logits" not in line and "embedding" not in line
        assert "array_max" in plan(scored)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
