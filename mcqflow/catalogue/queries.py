"""The queries: each takes ``(spark, folder)`` and reads whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType

from mcqflow import fixtures as fx
from mcqflow.functions.answers import answer_letter, is_correct, parse_letter
from mcqflow.functions.chat import CHATML
from mcqflow.functions.labels import argmax, first_supervised, mask_prompt, token_at
from mcqflow.functions.prompts import build_prompt, simple_exam
from mcqflow.functions.tokens import ByteCodec, attention_mask, cut_prompt, truncate
from mcqflow.operators import accuracy, alignment, batching, dialogue, runs
from mcqflow.operators.contract import check_mcq, split_mcq
from mcqflow.operators.numbering import row_index
from mcqflow.operators.predict import PluginCodec, numeric_predictor, run_predictor
from mcqflow.operators.selection import exact_batches
from mcqflow.operators.subwords import SubwordCodec, train_merges
from mcqflow.operators.vocabulary import (
    VocabularyCodec,
    build_vocabulary,
    decode_by_join,
    encode_by_join,
    special_ids,
)
from mcqflow.plans.evaluate import (
    evaluate,
    evaluate_first_token,
    evaluate_first_token_batched,
    evaluate_generated,
    evaluate_outputs,
    score_runs,
)
from mcqflow.plans.prepare import eval_prompts, prepare_sft, training_batches
from mcqflow.sources.shared import shared_folder
from mcqflow.sources.sinks import write_prepared, write_record, write_subjects
from mcqflow.sources.splits import count_splits, first_items, read_split, read_splits
from mcqflow.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

BYTES = ByteCodec()
VOCABULARY_SIZE = 5000
MERGES = 64
SHORT = 300  # some prompts reach this many bytes, some do not

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def digest(ids: str | Column, name: str = "ids") -> list[Column]:
    """An id array as count, sum and digest."""
    col = F.col(ids) if isinstance(ids, str) else ids
    total = F.aggregate(col, F.lit(0).cast("bigint"), lambda a, x: a + x)
    # As JSON, since a join would make a string of every id; no id is null.
    joined = F.replace(F.btrim(F.to_json(col), F.lit("[]")), F.lit(","), F.lit(" "))
    return [
        F.size(col).cast("bigint").alias(f"{name}_n"),
        total.alias(f"{name}_sum"),
        F.md5(joined).alias(f"{name}_md5"),
    ]


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Both runs' outputs aligned with gold and flagged."""
    return score_runs(fx.questions(spark, folder), fx.outputs(spark, folder), fx.RUNS)


def tokens(spark: SparkSession, folder: str, max_seq_len: int = 1024, **options: object) -> DataFrame:
    return prepare_sft(fx.questions(spark, folder), BYTES, max_seq_len, **options)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = fx.table(spark, folder, "documents")
    return fx.spread(docs.select(F.col("doc_id").alias("item_id"), "text", "source"), "item_id")


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return build_vocabulary(documents(spark, folder), "text", VOCABULARY_SIZE)


def stored_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary as users have it: built once, stored, loaded for every encoding."""
    path = shared_folder(spark) + "/vocabulary"
    return write_prepared(vocabulary(spark, folder), path, partition_by=())


@functools.cache
def _merges_path(application: str, folder: str) -> str:
    spark = SparkSession.active()
    path = shared_folder(spark) + "/merges"
    write_prepared(train_merges(documents(spark, folder), "text", MERGES), path, partition_by=())
    return path


def stored_merges(spark: SparkSession, folder: str) -> DataFrame:
    """Merges trained once in a session, on all documents."""
    return spark.read.parquet(_merges_path(spark.sparkContext.applicationId, folder))


# --- sources and sinks -------------------------------------------------------


def _stored_splits(spark: SparkSession, folder: str) -> str:
    path = shared_folder(spark) + "/splits"
    write_prepared(fx.questions(spark, folder), path)
    return path


@query
def s1_read_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_split(spark, _stored_splits(spark, folder), "validation")
    return rows.select("item_id", "question", "subject", "answer", "split")


@query
def s2_read_splits(spark: SparkSession, folder: str) -> DataFrame:
    train, evaluation = read_splits(spark, _stored_splits(spark, folder))
    return train.select("item_id", "split").unionByName(evaluation.select("item_id", "split"))


def _broken(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of which some break the row contract in one of seven ways."""
    key = F.col("item_id")
    return fx.questions(spark, folder).withColumns(
        {
            "item_id": F.when(key % 31 != 0, key),
            "question": F.when(key % 17 != 0, F.col("question")),
            "answer": F.when(key % 11 == 0, "7").when(key % 23 != 0, F.col("answer")),
            "choices": F.when(key % 13 == 0, F.slice("choices", 1, 3))
            .when(key % 19 == 0, F.transform("choices", lambda c: F.when(~c.endswith("1"), c)))
            .when(key % 29 != 0, F.col("choices")),
        }
    )


@query
def s3_row_contract(spark: SparkSession, folder: str) -> DataFrame:
    return check_mcq(_broken(spark, folder)).select("item_id", "invalid_reason")


@query
def s3_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    valid, bad = split_mcq(_broken(spark, folder))
    kept = valid.select(F.lit("valid").alias("outcome"))
    held = bad.select(F.col("invalid_reason").alias("outcome"))
    return kept.unionByName(held).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def s4_prepared_table(spark: SparkSession, folder: str) -> DataFrame:
    prompts = eval_prompts(fx.questions(spark, folder), keep=("item_id", "split"))
    stored = write_prepared(prompts, shared_folder(spark) + "/prompts")
    return stored.select("item_id", "split", "gold", "subject", F.md5("prompt_text").alias("prompt_md5"))


@query
def s5_result_json(spark: SparkSession, folder: str) -> DataFrame:
    outcome = evaluate_outputs(fx.questions(spark, folder), fx.outputs(spark, folder, "base"))
    path = shared_folder(spark)
    write_record(outcome.record, path + "/record")
    write_subjects(outcome.subjects, path + "/subjects")
    schema = "metric string, overall_acc double, n bigint, per_subject map<string,double>"
    record = spark.read.schema(schema).json(path + "/record")
    subjects = spark.read.parquet(path + "/subjects")
    entries = record.select("metric", "overall_acc", "n", F.explode("per_subject").alias("subject", "acc"))
    return entries.join(subjects.select("subject", "correct", "total"), "subject")


@query
def s6_count_splits(spark: SparkSession, folder: str) -> DataFrame:
    return count_splits(fx.questions(spark, folder))


# --- projections -------------------------------------------------------------


@query
def p1_answer_letter(spark: SparkSession, folder: str) -> DataFrame:
    return fx.questions(spark, folder).select("item_id", answer_letter(F.col("answer")).alias("gold"))


@query
def p1_answer_or_null(spark: SparkSession, folder: str) -> DataFrame:
    answer = answer_letter(F.col("answer"), "null")
    return _broken(spark, folder).select("item_id", answer.alias("gold"))


@query
def p2_mcq_prompt(spark: SparkSession, folder: str) -> DataFrame:
    prompt = simple_exam(F.col("subject"), F.col("question"), F.col("choices"))
    return fx.questions(spark, folder).select("item_id", prompt.alias("prompt"))


@query
def p3_prompt_by_name(spark: SparkSession, folder: str) -> DataFrame:
    prompt = build_prompt("simple_exam", F.lit(""), F.col("question"), F.col("choices"))
    return fx.questions(spark, folder).select("item_id", prompt.alias("prompt"))


@query
def p4_chat_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return fx.questions(spark, folder).select(
        "item_id",
        CHATML.prompt(F.col("question")).alias("plain"),
        CHATML.prompt(F.col("question"), enable_thinking=True).alias("thinking"),
    )


@query
def p5_chat_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    gold = answer_letter(F.col("answer"))
    return fx.questions(spark, folder).select(
        "item_id", CHATML.dialogue(F.col("question"), gold).alias("dialogue")
    )


@query
def p6_render_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    rows = dialogue.render_dialogues(fx.messages(spark, folder))
    return rows.select("conv_id", F.col("turns").cast("bigint").alias("turns"), "text")


@query
def p6_shifted_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turn numbers far apart change nothing but their order; the text ends for generation."""
    far = fx.messages(spark, folder).withColumn("turn", F.col("turn") * 700 + 1023)
    rows = dialogue.render_dialogues(far, generation=True)
    return rows.select("conv_id", F.col("turns").cast("bigint").alias("turns"), "text")


@query
def p6_turn_offsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = dialogue.render_turns(fx.messages(spark, folder))
    return rows.select("conv_id", "turn", F.md5("text").alias("text_md5"), "offset")


def _broken_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.messages(spark, folder)
    return rows.withColumns(
        {
            "text": F.when((F.col("conv_id") + F.col("turn")) % 11 != 0, F.col("text")),
            "role": F.when((F.col("conv_id") + F.col("turn")) % 13 != 0, F.col("role")),
        }
    )


@query
def p6_null_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with a turn that lacks its role or text go to quarantine as a whole."""
    good, bad = dialogue.split_messages(_broken_messages(spark, folder))
    kept = dialogue.render_dialogues(good).select("conv_id", F.lit("rendered").alias("outcome"), F.col("turns").cast("bigint").alias("n"))
    held = bad.groupBy("conv_id", F.coalesce("invalid_reason", F.lit("held")).alias("outcome"))
    return kept.unionByName(held.agg(F.count(F.lit(1)).alias("n")))


@query
def p6_message_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows = dialogue.assemble_messages(fx.messages(spark, folder))
    return rows.select(
        "conv_id",
        F.array_join("messages.role", ",").alias("roles"),
        F.md5(CHATML.messages(F.col("messages"))).alias("text_md5"),
    )


@query
def p7_byte_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = BYTES.encode(F.col("text"))
    return documents(spark, folder).select("item_id", ids.alias("ids")).select("item_id", *digest("ids"))


@query
def p7v_vocabulary_ids(spark: SparkSession, folder: str) -> DataFrame:
    codec = VocabularyCodec.load(stored_vocabulary(spark, folder))
    docs = documents(spark, folder)
    return docs.select("item_id", codec.encode(F.col("text")).alias("ids")).select("item_id", *digest("ids"))


@query
def j2_vocabulary_join(spark: SparkSession, folder: str) -> DataFrame:
    table = stored_vocabulary(spark, folder)
    ids = encode_by_join(documents(spark, folder), table, "text", unk_id=VOCABULARY_SIZE, out="ids")
    return ids.select("item_id", *digest("ids"))


@query
def v1_subword_merges(spark: SparkSession, folder: str) -> DataFrame:
    return stored_merges(spark, folder)


@query
def p7_subword_ids(spark: SparkSession, folder: str) -> DataFrame:
    codec = SubwordCodec.load(stored_merges(spark, folder))
    docs = documents(spark, folder)
    return docs.select("item_id", codec.encode(F.col("text")).alias("ids")).select("item_id", *digest("ids"))


@query
def p12_subword_rows(spark: SparkSession, folder: str) -> DataFrame:
    codec = SubwordCodec.load(stored_merges(spark, folder))
    rows = prepare_sft(fx.questions(spark, folder), codec, SHORT)
    return rows.select("item_id", *digest("input_ids", "ids"), *digest("labels", "labels"))


@query
def p15_decode_subwords(spark: SparkSession, folder: str) -> DataFrame:
    codec = SubwordCodec.load(stored_merges(spark, folder))
    ids = documents(spark, folder).select("item_id", codec.encode(F.col("text")).alias("ids"))
    ended = F.concat("ids", F.array(F.lit(codec.eos_id)))
    return ids.select("item_id", F.md5(codec.decode(ended)).alias("text_md5"))


@query
def v1_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary(spark, folder)


@query
def v2_special_ids(spark: SparkSession, folder: str) -> DataFrame:
    return special_ids(vocabulary(spark, folder))


@query
def p8_truncate(spark: SparkSession, folder: str) -> DataFrame:
    ids = truncate(BYTES.encode(F.col("text")), 1024)
    early = BYTES.encode(F.col("text"), 1024)
    rows = documents(spark, folder).select("item_id", ids.alias("ids"), early.alias("early"))
    return rows.select("item_id", *digest("ids"), (F.col("ids") == F.col("early")).alias("same"))


@query
def p9_attention_mask(spark: SparkSession, folder: str) -> DataFrame:
    ids = BYTES.encode(F.col("text"))
    rows = documents(spark, folder).select("item_id", attention_mask(ids).alias("mask"))
    return rows.select("item_id", *digest("mask", "mask"))


@query
def p10_prompt_mask(spark: SparkSession, folder: str) -> DataFrame:
    labels = mask_prompt(BYTES.encode(F.col("question")), (F.col("item_id") % 50).cast("int"))
    rows = fx.questions(spark, folder).select("item_id", labels.alias("labels"))
    return rows.select("item_id", *digest("labels", "labels"))


@query
def p11_assistant_mask(spark: SparkSession, folder: str) -> DataFrame:
    rows = dialogue.supervise_dialogues(fx.messages(spark, folder), BYTES)
    return rows.select("conv_id", *digest("input_ids"), *digest("labels", "labels"))


@query
def p11_limited_mask(spark: SparkSession, folder: str) -> DataFrame:
    rows = dialogue.supervise_dialogues(fx.messages(spark, folder), BYTES, max_seq_len=SHORT)
    return rows.select("conv_id", *digest("input_ids"), *digest("labels", "labels"))


@query
def p12_produced_columns(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder).select("item_id", F.size("labels").cast("bigint").alias("length"))


@query
def p13_null_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Every row is kept; what can't be built is null."""
    rows = eval_prompts(_broken(spark, folder), on_invalid="null")
    return rows.select("item_id", F.md5("prompt_text").alias("prompt_md5"), "gold")


@query
def p13_eval_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return eval_prompts(fx.questions(spark, folder))


def _generated(spark: SparkSession, folder: str) -> DataFrame:
    prompt = BYTES.encode(CHATML.prompt(F.col("question")))
    answer = BYTES.encode(F.concat(F.lit("Answer "), answer_letter(F.col("answer"))))
    rows = fx.questions(spark, folder).select("item_id", prompt.alias("prompt"), answer.alias("answer"))
    return rows.select(
        "item_id",
        F.size("prompt").alias("prompt_len"),
        F.concat("prompt", "answer", F.array(F.lit(BYTES.eos_id))).alias("ids"),
    )


@query
def p14_cut_prompt(spark: SparkSession, folder: str) -> DataFrame:
    suffix = cut_prompt(F.col("ids"), F.col("prompt_len"))
    return _generated(spark, folder).select("item_id", suffix.alias("ids")).select("item_id", *digest("ids"))


@query
def p15_decode_bytes(spark: SparkSession, folder: str) -> DataFrame:
    suffix = cut_prompt(F.col("ids"), F.col("prompt_len"))
    return _generated(spark, folder).select("item_id", BYTES.decode(suffix).alias("text"))


@query
def p15_decode_documents(spark: SparkSession, folder: str) -> DataFrame:
    ended = F.concat(BYTES.encode(F.col("text")), F.array(F.lit(BYTES.eos_id)))
    return documents(spark, folder).select("item_id", F.md5(BYTES.decode(ended)).alias("text_md5"))


@query
def p15_decode_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    codec = VocabularyCodec.load(stored_vocabulary(spark, folder))
    text = codec.decode(codec.encode(F.col("text")))
    return documents(spark, folder).select("item_id", F.md5(text).alias("text_md5"))


@query
def p15_decode_by_join(spark: SparkSession, folder: str) -> DataFrame:
    table = stored_vocabulary(spark, folder)
    codec = VocabularyCodec.load(table)
    ids = documents(spark, folder).select("item_id", codec.encode(F.col("text")).alias("input_ids"))
    return decode_by_join(ids, table).select("item_id", F.md5("text").alias("text_md5"))


@query
def p16_parse_letter(spark: SparkSession, folder: str) -> DataFrame:
    return fx.outputs(spark, folder).select("run", "item_id", parse_letter(F.col("output_text")).alias("pred"))


@query
def p17_correct(spark: SparkSession, folder: str) -> DataFrame:
    gold = eval_prompts(fx.questions(spark, folder)).drop("prompt_text")
    both = alignment.for_runs(gold, fx.RUNS)
    aligned = alignment.align_outputs(both, fx.outputs(spark, folder), ("run", "item_id"))
    return accuracy.score_letters(aligned).select("run", "item_id", "pred", "correct")


@query
def p17_scored_runs(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("run", "item_id", "pred", "correct")


@query
def p18_first_supervised(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.vector_labels(spark, folder)
    return rows.select("item_id", first_supervised(F.col("labels")).cast("bigint").alias("pos"))


@query
def p19_argmax(spark: SparkSession, folder: str) -> DataFrame:
    scores = fx.vector_scores(spark, folder)
    return scores.select("item_id", argmax(F.col("logits")).cast("bigint").alias("best"))


@query
def p20_first_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens(spark, folder)
    shifted = F.concat(F.slice("input_ids", 2, F.size("input_ids")), F.array(F.lit(0)))
    at = first_supervised(F.col("labels"))
    return rows.select(
        "item_id",
        token_at(F.col("labels"), at).cast("bigint").alias("gold_token"),
        token_at(shifted, at).cast("bigint").alias("pred_token"),
    )


# --- filters -----------------------------------------------------------------


@query
def f1_supervised_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder, SHORT, supervised_only=True).select("item_id")


@query
def f1_supervised_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy.supervised_rows(fx.vector_labels(spark, folder)).select("item_id", "subject")


@query
def f2_first_items(spark: SparkSession, folder: str) -> DataFrame:
    return first_items(fx.questions(spark, folder).select("item_id", "question"), 1000)


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    manifest = batching.training_manifest(
        documents(spark, folder), batch_size=2, world=2, accumulation=4, epochs=2
    )
    return batching.step_table(manifest)


@query
def f3_due_steps(spark: SparkSession, folder: str) -> DataFrame:
    return batching.due_steps(_steps(spark, folder), 10).select("epoch", "step", "items")


@query
def f3_epoch_ends(spark: SparkSession, folder: str) -> DataFrame:
    return batching.due_steps(_steps(spark, folder)).select("epoch", "step", "items")


# --- order, batches, padding -------------------------------------------------


@query
def b1_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    items = documents(spark, folder).select("item_id")
    return batching.shuffle_rows(items, epochs=2).select("epoch", "item_id", F.col("position").cast("bigint"))


@query
def b1_permuted_rows(spark: SparkSession, folder: str) -> DataFrame:
    items = documents(spark, folder).select("item_id")
    return batching.permuted_rows(items, epochs=2).select("epoch", "item_id", "position")


@query
def b1_permuted_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Ids with gaps."""
    items = documents(spark, folder).select((F.col("item_id") * 3 + F.col("item_id") % 2).alias("item_id"))
    return batching.permuted_rows(items, seed=7).select("epoch", "item_id", "position")


@query
def b2_exact_batches(spark: SparkSession, folder: str) -> DataFrame:
    return exact_batches(documents(spark, folder).select("item_id"), 8)


@query
def b3_permuted_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = training_batches(fx.questions(spark, folder), BYTES, batch_size=8, epochs=2, order="computed")
    return rows.select("epoch", "batch_id", "slot", "item_id", *digest("input_ids", "input_ids"), *digest("labels", "labels"))


@query
def b2_batches(spark: SparkSession, folder: str) -> DataFrame:
    return batching.consecutive_batches(documents(spark, folder).select("item_id"), 8)


@query
def b3_pad(spark: SparkSession, folder: str) -> DataFrame:
    rows = training_batches(fx.questions(spark, folder), BYTES, batch_size=8)
    return rows.select(
        "batch_id",
        "item_id",
        *digest("input_ids"),
        *digest("attention_mask", "mask"),
        *digest("labels", "labels"),
    )


@query
def b3_quarantine_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of the rows that keep the contract: all but the last are full."""
    rows = training_batches(_broken(spark, folder), BYTES, batch_size=8, on_invalid="quarantine")
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("least"))


def _null_keys(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return docs.select(
        F.when(F.col("item_id") % 97 != 0, F.col("item_id")).alias("item_id"),
        F.when(F.col("item_id") % 5 != 0, F.col("source")).alias("g"),
    )


@query
def b1_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a key or a group are numbered like others."""
    shuffled = batching.shuffle_rows(_null_keys(spark, folder))
    grouped = row_index(_null_keys(spark, folder), out="n", within=["g"])
    a = shuffled.agg(F.count(F.lit(1)).alias("n"), F.max("position").cast("bigint").alias("last"))
    per = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("n").cast("bigint").alias("last"))
    return a.select(F.lit("all").alias("g"), "n", "last").unionByName(per)


@query
def b3_collate(spark: SparkSession, folder: str) -> DataFrame:
    numbered = batching.consecutive_batches(fx.questions(spark, folder), 8)
    rows = prepare_sft(numbered, BYTES, keep=("item_id", "batch_id", "slot"))
    batches = batching.collate_batches(rows, BYTES.pad_id)
    return batches.select(
        "batch_id",
        F.col("width").cast("bigint").alias("width"),
        F.array_join(F.col("item_id").cast("array<string>"), " ").alias("items"),
        *digest(F.flatten("input_ids")),
        *digest(F.flatten("labels"), "labels"),
    )


@query
def b4_manifest(spark: SparkSession, folder: str) -> DataFrame:
    manifest = batching.training_manifest(
        documents(spark, folder), batch_size=2, world=2, accumulation=4, epochs=2
    )
    return manifest.select("epoch", "step", "rank", "micro", "batch_id", "item_id")


@query
def b4_fractional_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """An epoch and a half: the second one stops at the total number of steps."""
    manifest = batching.training_manifest(
        documents(spark, folder), batch_size=2, world=2, accumulation=4, epochs=1.5
    )
    return manifest.select("epoch", "step", "rank", "micro", "batch_id", "item_id")


@query
def b5_step_totals(spark: SparkSession, folder: str) -> DataFrame:
    return batching.step_totals(
        documents(spark, folder), batch_size=2, accumulation=4, world=2, epochs=1.5
    )


@query
def b6_sorted_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy.sort_subjects(accuracy.subject_accuracy(scored(spark, folder), ["run"]), ["run"])


# --- joins -------------------------------------------------------------------


@query
def j1_align(spark: SparkSession, folder: str) -> DataFrame:
    gold = eval_prompts(fx.questions(spark, folder)).select("item_id", "gold", "subject")
    both = alignment.for_runs(gold, fx.RUNS)
    return alignment.align_outputs(both, fx.outputs(spark, folder), ("run", "item_id"))


@query
def j1_missing_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Items without an output count as wrong."""
    gold = alignment.for_runs(eval_prompts(fx.questions(spark, folder)).drop("prompt_text"), fx.RUNS)
    answered = fx.outputs(spark, folder).where(F.col("output_text") != "")
    aligned = alignment.align_outputs(gold, answered, ("run", "item_id"))
    return accuracy.subject_accuracy(accuracy.score_letters(aligned), ["run"])


@query
def j2_salted_join(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary taken for one that is too large to broadcast."""
    table = stored_vocabulary(spark, folder)
    ids = encode_by_join(documents(spark, folder), table, "text", VOCABULARY_SIZE, out="ids", max_broadcast=0)
    return ids.select("item_id", *digest("ids"))


@query
def j3_compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy.compare_runs(scored(spark, folder), "base", "tuned")


@query
def j3_compare_results(spark: SparkSession, folder: str) -> DataFrame:
    items = fx.questions(spark, folder)
    tables = [evaluate_outputs(items, fx.outputs(spark, folder, run)).subjects for run in fx.RUNS]
    return accuracy.compare_results(*tables)


# --- aggregations ------------------------------------------------------------


@query
def a1_overall_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy.overall_accuracy(scored(spark, folder), ["run"])


@query
def a2_subject_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy.subject_accuracy(scored(spark, folder), ["run"])


@query
def a2_class_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as gold classes: is the quality flag the opposite of toxicity, by source?"""
    labels = fx.table(spark, folder, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic")
    flagged = labels.select("item_id", is_correct(F.col("quality"), 1 - F.col("toxic")).alias("correct"))
    docs = documents(spark, folder).select("item_id", F.col("source").alias("subject"))
    return accuracy.subject_accuracy(flagged.join(docs, "item_id"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy.score_long_logits(fx.vector_labels(spark, folder), fx.vector_scores(spark, folder))


@query
def a3_first_token(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy.first_token_metric(_vectors(spark, folder))


@query
def a3_repeated_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores that come twice count once; ``shift`` reads the position before."""
    scores = fx.vector_scores(spark, folder)
    earlier = scores.withColumn("pos", F.col("pos") - 1)
    repeated = earlier.unionByName(earlier).unionByName(scores.withColumn("pos", F.col("pos") + 7))
    return accuracy.first_token_metric(accuracy.score_long_logits(fx.vector_labels(spark, folder), repeated, shift=1))


@query
def a4_first_token_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy.first_token_metric(_vectors(spark, folder), ["subject"])


@query
def a5_merge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of four workers, summed."""
    named = scored(spark, folder).withColumn("subject", accuracy.subject_or_blank(F.col("subject")))
    shards = accuracy.count_correct(named.withColumn("rank", F.col("item_id") % 4), ["rank", "run", "subject"])
    return accuracy.with_accuracy(accuracy.merge_counts(shards, ["run", "subject"]))


@query
def a5_distinct_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    repeated = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("item_id") % 3).cast("int"))))
    return accuracy.overall_accuracy(accuracy.distinct_items(repeated, by=["run"]), ["run"])


@query
def a6_result_record(spark: SparkSession, folder: str) -> DataFrame:
    subjects = accuracy.subject_accuracy(scored(spark, folder).where(F.col("run") == "tuned"))
    record = accuracy.result_record(subjects, "generate")
    return record.select("metric", "overall_acc", "n", F.explode("per_subject").alias("subject", "acc"))


@query
def a6_result_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A row per user, who stands for a subject: more of them than a record takes."""
    flagged = fx.table(spark, folder, "events").select((F.col("value") < 50).alias("correct"), F.col("user_id").cast("string").alias("subject"))
    return accuracy.result_rows(accuracy.subject_accuracy(flagged), "generate")


@query
def a7_mean_loss(spark: SparkSession, folder: str) -> DataFrame:
    return runs.mean_loss(fx.step_log(spark, folder)).withColumn("train_loss", F.round("train_loss", 9))


@query
def a7_mean_loss_all_micro(spark: SparkSession, folder: str) -> DataFrame:
    means = runs.mean_loss(fx.step_log(spark, folder), all_micro=True)
    return means.withColumn("train_loss", F.round("train_loss", 9))


@query
def a8_last_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return runs.last_evaluation(fx.eval_log(spark, folder))


@query
def a8_train_record(spark: SparkSession, folder: str) -> DataFrame:
    steps = fx.step_log(spark, folder)
    events = fx.table(spark, folder, "events").groupBy(F.col("event_type").alias("run"))
    samples = events.agg(F.count(F.lit(1)).alias("train_samples"))
    record = runs.train_record(samples, steps, fx.eval_log(spark, folder))
    return record.withColumn("train_loss", F.round("train_loss", 9))


@query
def a9_interval_loss(spark: SparkSession, folder: str) -> DataFrame:
    return runs.interval_loss(fx.step_log(spark, folder), 10).withColumn("loss", F.round("loss", 9))


@query
def w1_latest_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return runs.latest_checkpoint(fx.checkpoints(spark, folder))


@query
def w2_kept_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    kept = runs.kept_checkpoints(fx.checkpoints(spark, folder), 2)
    return kept.select("run", "path", "step", F.col("age").cast("bigint").alias("age"))


# --- streams -----------------------------------------------------------------


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = fx.table(spark, folder, name).schema
    # A pattern, because a stream takes a plain path for a folder and the table may be a file.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


@query
def t1_prepare_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare_sft(fx.as_questions(_stream(spark, folder, "part")), BYTES)
    path = shared_folder(spark)
    jobs.append_to(rows, path + "/rows", path + "/state").awaitTermination()
    stored = spark.read.schema(rows.schema).parquet(path + "/rows")
    return stored.select("item_id", *digest("input_ids"), *digest("labels", "labels"))


def _arriving(spark: SparkSession, folder: str, streaming: bool) -> DataFrame:
    """Events as outputs that arrive: its id picks the letter, its user the gold item."""
    events = (_stream if streaming else fx.table)(spark, folder, "events")
    letter = F.translate((F.col("event_id") % 4).cast("string"), "0123", "ABCD")
    text = F.when(F.col("value") < 50, F.concat(F.lit("It is "), letter)).otherwise("none")
    return events.select(
        F.col("event_id").alias("arrival_id"),
        F.col("user_id").alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        text.alias("output_text"),
    )


def _arrived(spark: SparkSession, folder: str) -> DataFrame:
    gold = eval_prompts(fx.questions(spark, folder)).drop("prompt_text")
    return jobs.score_arriving(_arriving(spark, folder, True), gold)


def _snapshot(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path = shared_folder(spark)
    jobs.snapshot_to(stream, path + "/result", path + "/state").awaitTermination()
    return jobs.read_snapshot(spark, path + "/result", stream.schema)


def _closed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream with a watermark appends by its end."""
    path = shared_folder(spark)
    jobs.append_to(stream, path + "/rows", path + "/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/rows")


@query
def t2_running_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _snapshot(spark, jobs.running_accuracy(_arrived(spark, folder)))


@query
def t2_interval_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals that are closed: no row for them can come within the delay."""
    rows = _closed(spark, jobs.interval_accuracy(_arrived(spark, folder), "1 hour", "2 hours"))
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query
def t2_first_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Every item repeats; its first arrival is kept."""
    first = _snapshot(spark, jobs.first_arrivals(_arrived(spark, folder)))
    return first.select("item_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "pred", "correct")


@query
def t2_deduplicated_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    first = _snapshot(spark, jobs.first_arrivals(_arrived(spark, folder)))
    return accuracy.subject_accuracy(first)


def _asked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Streams of prompts and of outputs: events of even and of odd ids, by user."""
    events = _stream(spark, folder, "events")
    letter = F.translate((F.floor(F.col("event_id") / 2) % 4).cast("string"), "0123", "ABCD")
    at = F.col("ts").cast("timestamp")
    even = F.col("event_id") % 2 == 0
    asked = events.where(even).select(
        F.col("user_id").alias("item_id"), letter.alias("gold"), F.col("event_type").alias("subject"), at.alias("asked_at")
    )
    answered = events.where(~even).select(F.col("user_id").alias("item_id"), letter.alias("output_text"), at.alias("ts"))
    return asked, answered


@query
def j1_awaited_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """An outer join of two streams: what nobody answered within a day is wrong once the watermark says so."""
    rows = _closed(spark, jobs.score_awaited(*_asked(spark, folder), "1 DAY", "2 hours"))
    when = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("asked_at", "ts")}
    return rows.withColumns(when)


@query
def t3_running_loss(spark: SparkSession, folder: str) -> DataFrame:
    steps = _stream(spark, folder, "events").select(
        F.col("event_type").alias("run"), F.col("value").alias("loss"), F.col("ts").cast("timestamp").alias("ts")
    )
    rows = _closed(spark, jobs.running_loss(steps, "1 hour", "2 hours"))
    return rows.select(
        "run",
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.round("loss", 9).alias("loss"),
        "records",
    )


# --- plug-ins and whole jobs -------------------------------------------------


@query
def u1_tokenizer_plugin(spark: SparkSession, folder: str) -> DataFrame:
    codec = PluginCodec(fx.byte_tokenizer(), eos_id=256, load_decoder=fx.byte_detokenizer())
    ids = codec.encode(F.col("text"))
    rows = documents(spark, folder).select("item_id", ids.alias("ids"))
    return rows.select("item_id", *digest("ids"), F.md5(codec.decode(F.col("ids"))).alias("text_md5"))


@query
def u2_text_predictor(spark: SparkSession, folder: str) -> DataFrame:
    prompts = eval_prompts(fx.questions(spark, folder)).select("item_id", "prompt_text")
    return run_predictor(prompts, fx.text_model(), "prompt_text", "output_text").drop("prompt_text")


@query
def u2_numeric_predictor(spark: SparkSession, folder: str) -> DataFrame:
    best = numeric_predictor(fx.vector_model(), IntegerType(), batch_size=64, input_shapes=[[64]])
    scores = fx.vector_scores(spark, folder)
    return scores.select("item_id", best(F.col("logits")).cast("bigint").alias("best"))


@query
def u3_metric_by_name(spark: SparkSession, folder: str) -> DataFrame:
    items = fx.questions(spark, folder)
    models = {"generate": fx.id_model(BYTES.eos_id), "first_token": fx.first_token_model()}
    records = [evaluate(name, items, load, BYTES).record for name, load in models.items()]
    return records[0].unionByName(records[1]).select("metric", "overall_acc", "n")


@query
def e1_prepare_sft(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens(spark, folder, SHORT, keep_subject=True, flag_mismatch=True)
    return rows.select(
        "item_id",
        "subject",
        *digest("input_ids"),
        *digest("attention_mask", "mask"),
        *digest("labels", "labels"),
        "prefix_mismatch",
    )


@query
def e2_generated_text(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate_generated(fx.questions(spark, folder), fx.text_model()).subjects


@query
def e2_generated_ids(spark: SparkSession, folder: str) -> DataFrame:
    outcome = evaluate_generated(
        fx.questions(spark, folder),
        fx.id_model(BYTES.eos_id),
        BYTES,
        outputs_path=shared_folder(spark) + "/outputs",
    )
    return outcome.record.select("metric", "overall_acc", "n", F.explode("per_subject").alias("subject", "acc"))


@query
def e2_stored_outputs(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate_outputs(fx.questions(spark, folder), fx.outputs(spark, folder, "tuned")).subjects


@query
def e3_first_token(spark: SparkSession, folder: str) -> DataFrame:
    items = fx.questions(spark, folder)
    return evaluate_first_token(items, fx.first_token_model(), BYTES, max_seq_len=SHORT).subjects


@query
def e3_first_token_batched(spark: SparkSession, folder: str) -> DataFrame:
    items = fx.questions(spark, folder)
    outcome = evaluate_first_token_batched(items, fx.first_token_model(), BYTES, max_seq_len=SHORT)
    return outcome.subjects
