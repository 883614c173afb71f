"""Table operators on small fixtures, against plain Python where the rule is simple."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mcqflow import fixtures as fx
from mcqflow.functions.chat import CHATML
from mcqflow.functions.tokens import ByteCodec
from mcqflow.operators import accuracy, alignment, batching, dialogue, numbering, runs, vocabulary as vocab
from mcqflow.operators.contract import check_mcq, enforce_mcq, split_mcq
from mcqflow.operators.predict import PluginCodec, run_predictor
from mcqflow.plans.evaluate import (
    evaluate,
    evaluate_first_token,
    evaluate_first_token_batched,
    evaluate_generated,
    evaluate_outputs,
)
from mcqflow.plans.prepare import eval_prompts, prepare_sft, training_batches
from mcqflow.sources import sinks, splits
from mcqflow.sources.shared import shared_folder

BYTES = ByteCodec()
FOUR = ["w", "x", "y", "z"]
MESSAGE = "conv_id bigint, turn bigint, role string, text string"
MCQ = "item_id bigint, question string, choices array<string>, subject string, answer string"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- contract ----------------------------------------------------------------


@pytest.fixture
def mixed(spark):
    return spark.createDataFrame(
        [
            (0, "q", FOUR, "s", "A"),
            (1, None, FOUR, None, "A"),
            (2, "q", None, "s", "A"),
            (3, "q", FOUR[:3], "s", "A"),
            (4, "q", ["w", None, "y", "z"], "s", "A"),
            (5, "q", FOUR, "s", None),
            (6, "q", FOUR, "s", "9"),
            (7, "q", [*FOUR, None], "", "3"),
            (None, "q", FOUR, "s", "A"),
        ],
        MCQ,
    )


def test_contract_reasons(mixed):
    assert [r[1] for r in rows(check_mcq(mixed).select("item_id", "invalid_reason"), "item_id")] == [
        "missing item_id",
        None,
        "missing question",
        "missing choices",
        "fewer than four choices",
        "null choice",
        "missing answer",
        "invalid answer",
        None,
    ]
    valid, bad = split_mcq(mixed)
    assert [r.item_id for r in valid.orderBy("item_id").collect()] == [0, 7]
    assert bad.count() == 7 and bad.where("invalid_reason is null").count() == 0
    assert enforce_mcq(mixed, "quarantine").count() == 2
    assert enforce_mcq(mixed, "null").count() == 9
    prompts = eval_prompts(mixed, on_invalid="null")
    assert prompts.where("prompt_text is null").count() == 4 and prompts.count() == 9
    batches = training_batches(mixed, BYTES, 2, on_invalid="quarantine")
    assert [r["count"] for r in batches.groupBy("batch_id").count().collect()] == [2]


def test_contract_raises_even_when_columns_are_pruned(mixed):
    with pytest.raises(PySparkException, match="invalid row"):
        enforce_mcq(mixed).select("item_id").collect()


def test_contract_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        check_mcq(spark.range(1))
    frame = spark.createDataFrame([("q", FOUR, True)], "question string, choices array<string>, answer boolean")
    with pytest.raises(ValueError, match="item_id"):  # the key is part of the contract
        check_mcq(frame)
    out = check_mcq(frame.withColumn("item_id", F.lit(1))).first()
    assert out.subject is None and out.invalid_reason is None and out.answer == 1


# --- numbering and batches ----------------------------------------------------


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_row_index_is_the_global_rank(spark, parts):
    keys = [5, 1, 10**15, 7, 3, -4, 2**60, 2**60 + 1, 2**60 + 2, 8]
    keys += [10**12 + i for i in range(200)]  # a cluster far from the rest
    df = spark.createDataFrame([(k,) for k in keys], "item_id bigint").repartition(parts)
    got = rows(numbering.row_index(df), "item_id")
    assert got == [(k, i) for i, k in enumerate(sorted(keys))]


def test_row_index_inside_groups(spark):
    data = [("hot" if i % 3 else "cold", i * 7 % 101) for i in range(101)]
    df = spark.createDataFrame(data, "g string, item_id bigint")
    got = {(r.g, r.item_id): r.n for r in numbering.row_index(df, out="n", within=["g"]).collect()}
    for g in ("hot", "cold"):
        ids = sorted(i for h, i in data if h == g)
        assert [got[g, i] for i in ids] == list(range(len(ids)))


def test_row_index_of_nothing(spark):
    assert numbering.row_index(spark.range(0).withColumnRenamed("id", "item_id")).count() == 0
    one = spark.range(1).withColumnRenamed("id", "item_id")
    assert rows(numbering.row_index(one), "item_id") == [(0, 0)]


@pytest.mark.parametrize("parts", [1, 16])
def test_shuffle_is_a_stable_permutation(spark, parts):
    df = spark.range(300).withColumnRenamed("id", "item_id").repartition(parts)
    got = batching.shuffle_rows(df, seed=7, epochs=2)
    for epoch in (0, 1):
        key = {i: hashlib.md5(f"7:{epoch}:{i}".encode()).hexdigest() for i in range(300)}
        expected = sorted(range(300), key=key.get)
        here = rows(got.where(F.col("epoch") == epoch).select("position", "item_id"), "position")
        assert here == list(enumerate(expected))


def test_manifest_covers_every_item_once_per_epoch(spark):
    df = spark.range(103).withColumnRenamed("id", "item_id")
    m = batching.training_manifest(df, batch_size=4, world=3, accumulation=2, epochs=2)
    assert m.groupBy("epoch", "item_id").count().where("count <> 1").count() == 0
    batches = m.groupBy("epoch", "batch_id").count().where("epoch = 0").orderBy("batch_id").collect()
    assert [b["count"] for b in batches] == [4] * 25 + [3]
    steps = batching.step_table(m)
    per_epoch = math.ceil(math.ceil(26 / 3) / 2)
    assert [r.step for r in steps.orderBy("step").collect()] == list(range(1, 2 * per_epoch + 1))
    assert rows(batching.due_steps(steps).select("step"), "step") == [(per_epoch,), (2 * per_epoch,)]
    assert rows(batching.due_steps(steps, 4).select("step"), "step") == [(4,), (8,)]
    assert batching.due_steps(steps, 0).count() == 0


def test_step_totals(spark):
    total = batching.step_totals(spark.range(10), accumulation=4, epochs=1.5).first()
    assert (total.batches, total.steps_per_epoch, total.total_steps, total.warmup_steps) == (10, 3, 4, 0)
    assert batching.step_totals(spark.range(0)).first().total_steps == 0


@pytest.fixture
def unpadded(spark):
    data = [
        (0, 0, 0, [5, 6], [1, 1], [-100, 6]),
        (0, 1, 1, [1, 2, 3, 4], [1] * 4, [-100, 2, 3, 4]),
        (1, 0, 2, [9], [1], [9]),
    ]
    return spark.createDataFrame(
        data, "batch_id bigint, slot int, item_id bigint, input_ids array<int>, attention_mask array<int>, labels array<int>"
    )


def test_padding(unpadded):
    right = rows(batching.pad_batches(unpadded, 6).drop("batch_id", "slot"), "item_id")
    assert right[0] == (0, [5, 6, 6, 6], [1, 1, 0, 0], [-100, 6, -100, -100])
    assert right[2] == (2, [9], [1], [9])
    left = rows(batching.pad_batches(unpadded, 6, side="left").drop("batch_id", "slot"), "item_id")
    assert left[0] == (0, [6, 6, 5, 6], [0, 0, 1, 1], [-100, -100, -100, 6])
    with pytest.raises(ValueError, match="side"):
        batching.pad_batches(unpadded, 0, side="top")


def test_collated_batches(unpadded):
    first = batching.collate_batches(unpadded, 0).orderBy("batch_id").first()
    assert first.width == 4 and first.item_id == [0, 1]
    assert first.input_ids == [[5, 6, 0, 0], [1, 2, 3, 4]]
    assert first.labels == [[-100, 6, -100, -100], [-100, 2, 3, 4]]


def test_training_batches(spark, folder):
    items = fx.questions(spark, folder)
    got = training_batches(items, BYTES, batch_size=8, epochs=2).cache()
    assert got.groupBy("epoch", "item_id").count().where("count <> 1").count() == 0
    same = "size(input_ids) = size(attention_mask) and size(input_ids) = size(labels)"
    assert got.where(f"not ({same})").count() == 0
    widths = got.groupBy("epoch", "batch_id").agg(F.count_distinct(F.size("input_ids")).alias("w"), F.count("*").alias("n"))
    assert widths.where("w <> 1 or n > 8").count() == 0
    text = got.where("exists(labels, x -> x <> -100 and x not between 0 and 255)")
    assert text.count() == 0
    got.unpersist()


# --- conversations -------------------------------------------------------------


def test_conversations_are_whole_whatever_their_turn_numbers(spark):
    data = [(1, 1000 + 7 * t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(10)]
    df = spark.createDataFrame(data, MESSAGE).repartition(4)
    whole = dialogue.render_dialogues(df).collect()
    assert [w.turns for w in whole] == [10]
    turns = dialogue.render_turns(df).orderBy("turn").collect()
    assert "".join(t.text for t in turns) == whole[0].text
    assert all(whole[0].text[t.offset :].startswith(t.text) for t in turns)
    full = dialogue.supervise_dialogues(df, BYTES).first()
    for limit in (1, 30, 31, 100, 10_000):
        cut = dialogue.supervise_dialogues(df, BYTES, max_seq_len=limit).first()
        assert cut.input_ids == full.input_ids[:limit] and cut.labels == full.labels[:limit]
    ended = dialogue.render_dialogues(df, generation=True).first().text
    assert ended.startswith(whole[0].text) and ended.endswith("</think>\n\n")
    assert bytes(full.input_ids).decode() == whole[0].text
    taught = bytes(x for x in full.labels if x != -100).decode()
    assert taught == "".join(f"t{t}<|im_end|>\n" for t in range(1, 10, 2))


def test_bad_messages_are_refused_or_held(spark):
    data = [(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "c"), (3, 0, "user", None), (None, 0, "user", "d")]
    df = spark.createDataFrame(data, MESSAGE)
    for build in (dialogue.render_dialogues, dialogue.assemble_messages, dialogue.render_turns):
        with pytest.raises(PySparkException, match="invalid message"):
            build(df).collect()
        assert [r.conv_id for r in build(df, on_invalid="quarantine").collect()] == [2]
    good, bad = dialogue.split_messages(df)
    assert good.count() == 1
    assert sorted((str(r.conv_id), str(r.invalid_reason)) for r in bad.collect()) == [
        ("1", "None"), ("1", "missing role"), ("3", "missing text"), ("None", "missing conv_id"),
    ]
    nulls = df.groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("m"))
    texts = {r.conv_id: r.t for r in nulls.select("conv_id", CHATML.messages(F.col("m")).alias("t")).collect()}
    assert texts[1] is None and texts[2] == "<|im_start|>user\nc<|im_end|>\n"


def test_null_keys_are_numbered(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "x"), (4, None)], "item_id bigint, g string")
    assert sorted(r.position for r in batching.shuffle_rows(df).collect()) == [0, 1, 2, 3]
    got = {(r.g, r.item_id): r.n for r in numbering.row_index(df, out="n", within=["g"]).collect()}
    assert got == {("x", None): 0, ("x", 1): 1, (None, 2): 0, (None, 4): 1}
    got = numbering.text_index(df.select("g", F.col("item_id").cast("string").alias("k")), "k", "n", ["g"])
    assert {(r.g, r.k): r.n for r in got.collect()} == {("x", None): 0, ("x", "1"): 1, (None, "2"): 0, (None, "4"): 1}


def test_texts_without_an_item_stay_apart(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "b"), (None, "b"), (1, "a")], "item_id bigint, text string")
    table = vocab.build_vocabulary(df, "text", 10).cache()
    assert rows(table.select("token", "id", "n"), "id") == [("b", 0, 3), ("a", 1, 2)]
    for most in (0, 100):
        ids = vocab.encode_by_join(df, table, "text", 9, max_broadcast=most)
        assert sorted((str(r.item_id), r.input_ids) for r in ids.collect()) == [
            ("1", [1]), ("None", [0]), ("None", [0]), ("None", [1, 0]),
        ]
        back = vocab.decode_by_join(ids, table, max_broadcast=most)
        assert sorted((str(r.item_id), r.text) for r in back.collect()) == [
            ("1", "a"), ("None", "a b"), ("None", "b"), ("None", "b"),
        ]
    assert "TakeOrdered" not in vocab.build_vocabulary(df, "text", 2)._jdf.queryExecution().executedPlan().toString()


def test_dialogue_mask_agrees_with_prompt_mask(spark):
    """A two-turn conversation is the single-question case."""
    df = spark.createDataFrame(
        [(0, 0, "user", "Q?"), (0, 1, "assistant", "B")], "conv_id bigint, turn bigint, role string, text string"
    )
    row = dialogue.supervise_dialogues(df, BYTES).first()
    assert bytes(x for x in row.labels if x != -100).decode() == "B<|im_end|>\n"
    assert row.labels.index(ord("B")) == len(row.labels) - len("B<|im_end|>\n")


# --- vocabulary ----------------------------------------------------------------

TEXTS = ["the cat the dog", "the end, 42!", "", "naïve café ½ 中文", "the " * 50, "new words only"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "item_id bigint, text string").repartition(3)


def test_vocabulary_order_and_special_ids(texts):
    table = rows(vocab.build_vocabulary(texts, "text", 3), "id")
    assert table == [("the", 0, 53), ("!", 1, 1), (",", 2, 1)]
    assert vocab.build_vocabulary(texts, "text", 100, min_count=2).count() == 1
    special = vocab.special_ids(vocab.build_vocabulary(texts, "text", 3)).first()
    assert tuple(special) == (3, 3, 4, 4)
    assert vocab.special_ids(vocab.build_vocabulary(texts, "text", 3), pad_id=0).first().pad_id == 0


@pytest.mark.parametrize("max_broadcast", [1000, 1])
def test_vocabulary_paths_agree(texts, max_broadcast):
    """Inline constant, broadcast join and salted join give the same ids and text."""
    table = vocab.build_vocabulary(texts, "text", 12).cache()
    codec = vocab.VocabularyCodec.load(table)
    inline = rows(texts.select("item_id", codec.encode(F.col("text"))), "item_id")
    joined = vocab.encode_by_join(texts, table, "text", codec.unk_id, max_broadcast=max_broadcast, salts=5)
    assert rows(joined, "item_id") == inline
    known = {r.token: r.id for r in table.collect()}
    assert inline[1][1] == [known.get(t, 12) for t in ("the", "end", ",", "42", "!")]
    assert inline[2][1] == []
    counts = rows(texts.select("item_id", codec.count(F.col("text"), 20)), "item_id")
    assert [c[1] for c in counts] == [min(20, len(i[1])) for i in inline]
    decoded = rows(texts.select("item_id", codec.decode(codec.encode(F.col("text")))), "item_id")
    back = vocab.decode_by_join(joined, table, max_broadcast=max_broadcast, salts=5)
    assert rows(back, "item_id") == decoded
    cut = vocab.encode_by_join(texts, table, "text", codec.unk_id, max_len=2, max_broadcast=max_broadcast)
    assert [r[1] for r in rows(cut, "item_id")] == [i[1][:2] for i in inline]


def test_rows_of_an_item_are_joined_by_position(spark):
    """Rows that share an item are one, its tokens by position and then by id; the same from both joins."""
    data = [(1, "a b c"), (1, "c c c d"), (2, None), (2, "a"), (3, ""), (3, None), (None, "b"), (None, None), (4, "x " * 25_000)]
    df = spark.createDataFrame(data, "item_id bigint, text string").coalesce(1)
    table = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, id int")
    want = {("1", (0, 2, 1, 2, 2, 2, 9)), ("2", (0,)), ("3", ()), ("None", (1,)), ("None", ()), ("4", (9,) * 25_000)}
    texts = {("1", "a c b c c c"), ("2", "a"), ("3", ""), ("None", "b"), ("None", ""), ("4", "")}
    for most in (0, 100):
        ids = vocab.encode_by_join(df, table, "text", 9, max_broadcast=most)
        assert {(str(r.item_id), tuple(r.input_ids)) for r in ids.collect()} == want
        back = vocab.decode_by_join(ids, table, max_broadcast=most)
        assert {(str(r.item_id), r.text) for r in back.collect()} == texts


def test_equal_tokens_of_a_text_are_joined_once(spark):
    df = spark.createDataFrame([(1, "a b a a"), (2, ""), (3, None)], "item_id bigint, text string").coalesce(1)
    found = vocab._places(vocab._keyed(df, "item_id"), "item_id", vocab.pieces(F.col("text"))).collect()
    assert sorted((r.item_id, str(r.token), r["at"]) for r in found) == [
        (1, "a", [0, 2, 3]), (1, "b", [1]), (2, "None", []), (3, "None", []),
    ]


def test_joined_ids_are_not_sorted_token_by_token(spark):
    """Where the vocabulary is broadcast, what is exchanged and grouped is arrays."""
    df = spark.range(10).select(F.col("id").alias("item_id"), F.lit("a b").alias("text"))
    table = spark.createDataFrame([("a", 0)], "token string, id int")
    ids = vocab.encode_by_join(df, table, "text", 9)
    for made in (ids, vocab.decode_by_join(df.select("item_id", F.array(F.lit(0)).alias("input_ids")), table)):
        text = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in text[text.index("Exchange hashpartitioning") :]


def test_vocabulary_size_is_checked(texts):
    table = vocab.build_vocabulary(texts, "text", 12)
    with pytest.raises(ValueError, match="encode_by_join"):
        vocab.VocabularyCodec.load(table, max_tokens=5)
    with pytest.raises(ValueError, match="ids must be"):
        vocab.VocabularyCodec.load(table.withColumn("id", F.col("id") + 1))


# --- alignment and accuracy ------------------------------------------------------


def test_alignment(spark):
    gold = spark.createDataFrame([(1, "A"), (2, "B")], "item_id bigint, gold string")
    outs = spark.createDataFrame([("r", 1, "A"), ("s", 1, "B"), ("s", 2, "B"), ("s", 9, "C")], "run string, item_id bigint, output_text string")
    keys = ("run", "item_id")
    both = alignment.align_outputs(alignment.for_runs(gold, ["r", "s"]), outs, keys)
    scored = accuracy.score_letters(both)
    flags = rows(scored.select("run", "item_id", "pred", "correct"), "run", "item_id")
    assert flags == [("r", 1, "A", True), ("r", 2, None, False), ("s", 1, "B", False), ("s", 2, "B", True)]
    twice = outs.union(outs.where("run = 's'"))
    with pytest.raises(PySparkException, match="more than one output"):
        alignment.align_outputs(gold, twice, keys=("item_id",)).collect()
    least = alignment.unique_outputs(twice.select("item_id", "output_text"), on_duplicate="least")
    assert rows(least, "item_id") == [(1, "A"), (2, "B"), (9, "C")]
    wide = alignment.unique_outputs(outs.withColumn("extra", F.lit(1)), keys)
    assert wide.columns == ["run", "item_id", "output_text", "extra"]


FLAGS = [("a", True), ("a", False), ("b", False), (None, True), ("", True), ("a", True)]


@pytest.fixture
def flags(spark):
    return spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(FLAGS)], "item_id bigint, subject string, correct boolean")


def test_accuracy_tables_and_record(flags):
    assert tuple(accuracy.overall_accuracy(flags).first()) == (4, 6, 4 / 6)
    per = accuracy.subject_accuracy(flags)
    assert [tuple(r) for r in accuracy.sort_subjects(per).collect()] == [
        ("", 2, 2, 1.0), ("a", 2, 3, 2 / 3), ("b", 0, 1, 0.0),
    ]
    record = accuracy.result_record(per, "generate").first()
    assert (record.metric, record.overall_acc, record.n) == ("generate", 4 / 6, 6)
    assert list(record.per_subject.items()) == [("", 1.0), ("a", 2 / 3), ("b", 0.0)]
    with pytest.raises(PySparkException, match="too many subjects"):
        accuracy.result_record(per, "generate", max_subjects=2).collect()
    empty = flags.where("item_id < 0")
    assert tuple(accuracy.overall_accuracy(empty).first()) == (0, 0, 0.0)
    blank = accuracy.result_record(accuracy.subject_accuracy(empty), "generate").first()
    assert (blank.overall_acc, blank.n, blank.per_subject) == (0.0, 0, {})


def test_counts_merge_and_repeats_fold(flags):
    shards = accuracy.count_correct(flags.withColumn("rank", F.col("item_id") % 2), ["rank"])
    assert tuple(accuracy.merge_counts(shards).first()) == (4, 6)
    doubled = flags.union(flags).union(flags.where("item_id = 0"))
    assert tuple(accuracy.overall_accuracy(accuracy.distinct_items(doubled)).first()) == (4, 6, 4 / 6)


def test_run_comparison_matches_the_join(spark):
    data = [("base", "a", True), ("base", "b", False), ("tuned", "a", False), ("tuned", "c", True), ("x", "d", True)]
    df = spark.createDataFrame(data, "run string, subject string, correct boolean")
    tables = [accuracy.subject_accuracy(df.where(F.col("run") == r)) for r in ("base", "tuned")]
    joined = accuracy.compare_results(*tables)
    direct = accuracy.compare_runs(df, "base", "tuned").select(joined.columns)
    assert rows(direct, "subject") == rows(joined, "subject")
    assert rows(direct, "subject")[0] == ("a", 1, 1, 1.0, 0, 1, 0.0, -1.0)


def test_first_token_metric(spark):
    data = [(0, "s", [-100, -100, 7, 8], [0, 0, 7, 0]), (1, "s", [-100, -100], [1, 1]), (2, "t", [5, 6], [4, 6])]
    df = spark.createDataFrame(data, "item_id bigint, subject string, labels array<int>, pred_ids array<int>")
    scored = accuracy.score_first_tokens(df)
    assert tuple(accuracy.first_token_metric(scored).first()) == (0.5, 2, 1)
    assert tuple(accuracy.first_token_metric(scored.where("item_id < 0")).first()) == (0.0, 0, 0)
    assert rows(accuracy.first_token_metric(scored, ["subject"]), "subject") == [("s", 1.0, 1, 1), ("t", 0.0, 1, 0)]
    shifted = accuracy.score_first_tokens(df, shift=1)
    assert rows(shifted.select("item_id", "pos", "pred_token"), "item_id") == [(0, 1, 0), (2, -1, None)]


def test_scores_in_rows_and_in_a_long_table_agree(spark):
    data = [(0, [-100, 1], [[0.1, 0.9], [0.2, 0.8]]), (1, [0, 1], [[0.1, 0.9], [0.0, 1.0]]), (2, [-100], [[1.0, 0.0]])]
    df = spark.createDataFrame(data, "item_id bigint, labels array<int>, logits array<array<float>>")
    wide = accuracy.score_first_tokens(df)
    long = df.select("item_id", F.posexplode("logits").alias("pos", "logits"))
    both = accuracy.score_long_logits(df.drop("logits"), long)
    columns = ["item_id", "pos", "gold_token", "pred_token", "correct"]
    assert rows(both.select(columns), "item_id") == rows(wide.select(columns), "item_id")


# --- run records ------------------------------------------------------------------


def test_mean_loss(spark):
    log = [("r", 1, 0, 0, 4.0), ("r", 1, 0, 1, 2.0), ("r", 2, 0, 0, 6.0), ("r", 2, 0, 1, 4.0)]
    df = spark.createDataFrame(log, "run string, step bigint, rank int, micro int, loss double")
    assert rows(runs.mean_loss(df), "run") == [("r", 3.0, 2)]
    assert rows(runs.mean_loss(df, all_micro=True), "run") == [("r", 4.0, 2)]
    short = df.where("not (step = 2 and micro = 1)")  # an epoch may end inside a group
    assert rows(runs.mean_loss(short), "run") == [("r", 4.0, 2)]
    ranks = df.unionByName(df.withColumn("rank", F.lit(1)).withColumn("loss", F.col("loss") + 2))
    assert rows(runs.mean_loss(ranks), "run") == [("r", 4.0, 2)]
    assert rows(runs.interval_loss(df, 1), "interval") == [("r", 0, 3.0, 2), ("r", 1, 5.0, 2)]
    samples = spark.createDataFrame([("r", 9), ("idle", 5)], "run string, train_samples bigint")
    evals = spark.createDataFrame([("r", 1, 0.1, 5), ("r", 2, 0.3, 6)], "run string, step bigint, first_token_acc double, eval_samples bigint")
    record = runs.train_record(samples, df, evals)
    assert rows(record, "run") == [("idle", 0.0, 0, 5, None, None), ("r", 3.0, 2, 9, 0.3, 6)]


def test_checkpoints(spark):
    paths = ["o/checkpoint-9", "o/checkpoint-10", "o/checkpoint-2/", "o/checkpoint-x", "o/final", "checkpoint-3"]
    df = spark.createDataFrame([("r", p) for p in paths], "run string, path string")
    assert rows(runs.latest_checkpoint(df), "run") == [("r", 10, "o/checkpoint-10")]
    kept = runs.kept_checkpoints(df, 2)
    assert [r.step for r in kept.orderBy("age").collect()] == [10, 9]


# --- plug-ins and whole jobs ---------------------------------------------------------


def test_plugin_codec_over_arrow(spark):
    """Nulls, empty texts and lists, over several batches."""

    def load():
        return lambda texts: [[ord(c) for c in t] for t in texts]

    def load_decoder():
        return lambda lists: ["".join(map(chr, ids)) for ids in lists]

    codec = PluginCodec(load, eos_id=0, load_decoder=load_decoder)
    texts = [None, "", "ab", None, "é日", "x" * 500, ""]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
        ids = df.withColumn("ids", codec.encode(F.col("t")))
        rows = ids.select("i", "ids", codec.decode(F.concat("ids", F.array(F.lit(0)))).alias("back"), codec.count(F.col("t"), 3).alias("n")).orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.ids for r in rows] == [None if t is None else [ord(c) for c in t] for t in texts]
    assert [r.back for r in rows] == texts
    assert [r.n for r in rows if texts[r.i] is not None] == [min(3, len(t)) for t in texts if t is not None]


def test_plugin_codec_gets_bounded_slices_of_a_batch(spark):
    """Of an Arrow batch of 3 MB a tokenizer sees a megabyte at a time, or one longer text."""

    def load():
        def tokenize(texts):
            assert len(texts) <= 1 or sum(map(len, texts)) <= 1 << 20
            return [list(t.encode()) for t in texts]

        return tokenize

    def load_decoder():
        def detokenize(lists):
            assert len(lists) <= 1 or sum(map(len, lists)) <= 1 << 20
            return [bytes(ids).decode() for ids in lists]

        return detokenize

    codec = PluginCodec(load, eos_id=256, load_decoder=load_decoder)
    size = F.when(F.col("id") == 7, 1_500_000).when(F.col("id") % 50 != 0, 10_000)
    df = spark.range(150, numPartitions=1).select("id", F.repeat(F.lit("x"), size.cast("int")).alias("t"))
    ids = df.withColumn("ids", codec.encode(F.col("t")))
    rows = ids.select("id", F.size("ids").alias("n"), (codec.decode(F.col("ids")) == F.col("t")).alias("same")).collect()
    for r in rows:
        want = 1_500_000 if r.id == 7 else 10_000 if r.id % 50 else None
        assert (r.n, r.same) == ((want, True) if want else (-1 if r.n == -1 else None, None))
    assert len(rows) == 150


def test_plugin_codec_equals_the_built_in_one(spark, folder):
    plug = PluginCodec(fx.byte_tokenizer(), eos_id=256)
    items = fx.questions(spark, folder)
    a = prepare_sft(items, plug, 300)
    b = prepare_sft(items, BYTES, 300)
    assert rows(a, "item_id") == rows(b, "item_id")
    with pytest.raises(ValueError, match="no decoder"):
        plug.decode(F.lit(None))


def test_prefix_mismatch_is_flagged(spark):
    """A tokenizer that merges across the prompt's end makes the count wrong."""

    def merging():
        def tokenize(texts):
            return [[len(t) % 7] + list(t.encode()) for t in texts]

        return tokenize

    df = spark.createDataFrame([(0, "q", FOUR, "s", "A")], MCQ)
    assert prepare_sft(df, PluginCodec(merging_loader(merging), 256), flag_mismatch=True).first().prefix_mismatch
    assert not prepare_sft(df, BYTES, flag_mismatch=True).first().prefix_mismatch


def merging_loader(load):
    return load


def test_prepare_labels(spark, folder):
    out = prepare_sft(fx.questions(spark, folder), BYTES)
    assert out.columns == ["item_id", "input_ids", "attention_mask", "labels"]
    bad = "exists(zip_with(input_ids, labels, (i, l) -> l <> -100 and l <> i), x -> x)"
    assert out.where(bad).count() == 0
    everything = prepare_sft(fx.questions(spark, folder), BYTES, 50)
    assert everything.where("exists(labels, x -> x <> -100)").count() == 0
    assert prepare_sft(fx.questions(spark, folder), BYTES, 50, supervised_only=True).count() == 0


def test_predictor_passes_options_and_batches(spark):
    def load():
        def model(texts, tag):
            return [f"{tag}{len(texts)}{t}" for t in texts]

        return model

    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "item_id bigint, prompt string").coalesce(1)
    got = rows(run_predictor(df, load, "prompt", "out", batch_size=2, tag="x"), "item_id")
    assert [g[2] for g in got] == ["x2p0", "x2p1", "x2p2", "x2p3", "x1p4"]


def test_evaluations(spark, folder):
    items = fx.questions(spark, folder)
    with pytest.raises(ValueError, match="metric must be"):
        evaluate("perplexity", items, fx.text_model())
    stored = evaluate_outputs(items, fx.outputs(spark, folder, "base"))
    assert stored.record.first().n == 200
    text = evaluate_generated(items, fx.text_model()).record.first()
    ids = evaluate("generate", items, fx.id_model(256), BYTES).record.first()
    assert (text.n, text.overall_acc, text.per_subject) == (ids.n, ids.overall_acc, ids.per_subject)
    for limit in (300, 1024):
        a = evaluate_first_token(items, fx.first_token_model(), BYTES, max_seq_len=limit)
        b = evaluate_first_token_batched(items, fx.first_token_model(), BYTES, max_seq_len=limit)
        assert rows(a.scored, "item_id") == rows(b.scored, "item_id")
        assert a.record.first() == b.record.first()
    assert a.record.first().n == 200


def test_first_token_from_score_vectors(spark, folder):
    """A model that returns scores [rows, width, tokens] is reduced at one position."""

    def load():
        import numpy as np

        def predict(ids, mask):
            out = np.zeros((*ids.shape, 260), dtype=np.float32)
            letters = 65 + mask.sum(axis=1) % 4
            for row, letter in enumerate(letters):
                out[row, :, letter] = 1.0
            return out

        return predict

    items = fx.questions(spark, folder)
    a = evaluate_first_token(items, load, BYTES).record.first()
    assert a == evaluate_first_token(items, fx.first_token_model(), BYTES).record.first()


# --- sources and sinks ------------------------------------------------------------------


def test_splits_prune_and_count(spark, folder):
    items = fx.questions(spark, folder)
    path = shared_folder(spark) + "/splits"
    sinks.write_prepared(items, path)
    train, held = splits.read_splits(spark, path)
    assert (train.count(), held.count()) == (180, 20)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert rows(splits.count_splits(items), "split") == [("auxiliary_train", 180), ("validation", 20)]
    assert splits.first_items(items, 7).count() == 7 and splits.first_items(items, None).count() == 200
    with pytest.raises(ValueError, match="fmt"):
        splits.read_split(spark, path, "x", "xml")


def test_record_is_one_utf8_json_line(spark, flags):
    named = flags.withColumn("subject", F.lit("zoölogy"))
    record = accuracy.result_record(accuracy.subject_accuracy(named), "generate")
    path = shared_folder(spark) + "/record"
    sinks.write_record(record, path)
    with pytest.raises(ValueError, match="no record"):
        sinks.write_record(record.union(record), path + "-more", max_rows=1)
    files = [f for f in Path(path.removeprefix("file:")).glob("*.json") if f.stat().st_size]
    text = files[0].read_text(encoding="utf-8")
    assert len(files) == 1 and "zoölogy" in text
    assert json.loads(text) == {"metric": "generate", "overall_acc": 4 / 6, "n": 6, "per_subject": {"zoölogy": 4 / 6}}


@pytest.mark.parametrize("n", [0, 3, 4, 10, 11, 30, 57, 58, 100])
def test_first_items_without_a_sort(spark, n):
    """Three null keys, ties, and a rank inside them."""
    keys = [None] * 3 + [5] * 7 + list(range(6, 40)) + [99] * 14
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "item_id bigint, row int").repartition(3)
    got = splits.first_items(df, n, most_sorted=-1)
    assert got.columns == ["item_id", "row"]
    rows = got.collect()
    assert sorted((r.item_id is not None, r.item_id or 0) for r in rows) == [(k is not None, k or 0) for k in keys[:n]]
    assert len({r.row for r in rows}) == len(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan
