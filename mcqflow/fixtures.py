"""Inputs of this library derived from general tables, for the query catalogue and tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mcqflow.operators.numbering import row_index

RUNS = ("base", "tuned")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small file's rows over all cores, before heavy expressions. For plain scans only:
    asking for the partitions of a plan with an exchange would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    # Not deterministic, so that no filter is pushed below the exchange, into the few tasks of the scan.
    # The id of a row would do the same, but no plan that a stream meets may hold it.
    return df.repartition(cores, key).where(F.spark_partition_id() >= 0)


def _digit(digest: Column, at: int) -> Column:
    """Value 0-15 of one hex digit of a digest."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(digest, at, 1)) - 1


def as_questions(part: DataFrame) -> DataFrame:
    """Parts as four-option questions about their brand number; the answer comes as a
    digit, a letter or a padded letter, and every fiftieth subject is null."""
    key = F.col("p_partkey")
    slot = (key % 4).cast("int")
    brand = F.substring_index("p_brand", "#", -1).cast("int")
    options = [
        F.concat(F.lit("Brand#"), (F.pmod(brand - 1 + (i - slot) * 7, F.lit(25)) + 1).cast("string"))
        for i in range(4)
    ]
    letter = F.translate(slot.cast("string"), "0123", "ABCD")
    answer = F.when(key % 3 == 0, slot.cast("string")).when(key % 3 == 1, letter)
    return part.select(
        key.alias("item_id"),
        F.concat(F.lit("Which brand is the "), F.col("p_name"), F.lit(", part "), key.cast("string"), F.lit("?")).alias("question"),
        F.array(*options).alias("choices"),
        F.when(key % 50 != 0, F.col("p_type")).alias("subject"),
        answer.otherwise(F.concat(F.lit(" "), letter, F.lit("\t"))).alias("answer"),
        F.when(key % 10 == 0, "validation").otherwise("auxiliary_train").alias("split"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return as_questions(spread(table(spark, folder, "part"), "p_partkey"))


def answer_texts(items: DataFrame, runs: Sequence[str] = RUNS) -> DataFrame:
    """``(run, item_id, output_text)``: for each part a sentence in one of six forms.
    The tuned run is right more often. Chosen by digest, so stable under any plan."""
    key = F.col("p_partkey")
    each = items.select(key.alias("item_id"), F.explode(F.array(*map(F.lit, runs))).alias("run"))
    digest = F.md5(F.concat("run", F.lit(":"), F.col("item_id").cast("string")))
    lucky = F.when(F.col("run") == "tuned", 12).otherwise(7)
    right = F.col("item_id") % 4
    pick = F.when(_digit(digest, 1) < lucky, right).otherwise(_digit(digest, 2) % 4)
    letter = F.translate(pick.cast("string"), "0123", "ABCD")
    form = _digit(digest, 3) % 6
    text = (
        F.when(form == 0, F.concat(letter, F.lit(".")))
        .when(form == 1, F.concat(F.lit("The answer is "), letter, F.lit(".")))
        .when(form == 2, F.concat(F.lower(letter), F.lit(")")))
        .when(form == 3, F.concat(F.lit("("), letter, F.lit(")")))
        .when(form == 4, F.lit("Because"))
        .otherwise("")
    )
    return each.select("run", "item_id", text.alias("output_text"))


def outputs(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    items = table(spark, folder, "part").select("p_partkey")
    rows = answer_texts(items, RUNS if run is None else (run,))
    return rows if run is None else rows.drop("run")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")


def step_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as step losses of five runs: two ranks, two micro-batches a step."""
    rows = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("run"), F.col("value").alias("loss")
    )
    n = F.col("n")
    return row_index(rows, "event_id", "n", within=["run"]).select(
        "run",
        (F.floor(n / 4) + 1).cast("bigint").alias("step"),
        (n % 2).cast("int").alias("rank"),
        (F.floor(n / 2) % 2).cast("int").alias("micro"),
        "loss",
    )


def eval_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as periodic evaluations: one per event, its id the step."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("step"),
        F.col("value").alias("first_token_acc"),
        F.col("user_id").alias("eval_samples"),
    )


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Events as checkpoint folders of one run per user."""
    user = F.col("user_id").cast("string")
    return table(spark, folder, "events").select(
        user.alias("run"),
        F.concat(F.lit("out/"), user, F.lit("/checkpoint-"), F.col("event_id").cast("string")).alias("path"),
    )


def vector_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as one item's score vector each, at the position of its only label."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        (F.col("vec_id") % 3).cast("int").alias("pos"),
        F.col("embedding").alias("logits"),
    )


def vector_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels for ``vector_scores``: the class sits after 0-2 ignored positions. Every
    seventh item has no supervised label at all."""
    at = (F.col("vec_id") % 3).cast("int")
    value = F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("label"))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.concat(F.lit("g"), (F.col("label") % 4).cast("string")).alias("subject"),
        F.concat(F.array_repeat(F.lit(-100), at), F.array(value.cast("int"), value.cast("int"))).alias("labels"),
    )


# --- stand-ins for the user's tokenizer and models ---------------------------


def text_model() -> Callable[..., Sequence[str]]:
    """Answers with the letter picked by the prompt's byte length."""

    def load() -> Any:
        def answer(prompts: list[str], **_: Any) -> list[str]:
            return [f"Answer: {'ABCD'[len(p.encode()) % 4]}" for p in prompts]

        return answer

    return load


def id_model(eos_id: int) -> Callable[..., Any]:
    """The same over ids: returns the prompt, the answer's bytes and an end id."""

    def load() -> Any:
        def answer(prompts: list[Any], max_new_tokens: int, **_: Any) -> list[Any]:
            made = []
            for ids in prompts:
                text = f"({'ABCD'[len(ids) % 4]})".encode()
                made.append(np.concatenate([ids, [*text[: max_new_tokens - 1], eos_id]]))
            return made

        return answer

    return load


def first_token_model() -> Callable[..., Any]:
    """Predicts, at every position of a row, the letter picked by the row's length."""

    def load() -> Any:
        def predict(input_ids: Any, attention_mask: Any) -> Any:
            letters = 65 + attention_mask.sum(axis=1) % 4
            return letters[:, None].repeat(input_ids.shape[1], axis=1)

        return predict

    return load


def byte_tokenizer() -> Callable[..., Any]:
    def load() -> Any:
        def tokenize(texts: list[str]) -> list[list[int]]:
            return [list(t.encode()) for t in texts]

        return tokenize

    return load


def byte_detokenizer() -> Callable[..., Any]:
    def load() -> Any:
        def detokenize(lists: list[list[int]]) -> list[str]:
            return [bytes(ids).decode("utf-8", "replace") for ids in lists]

        return detokenize

    return load


def vector_model() -> Callable[..., Any]:
    def load() -> Any:
        def best(scores: Any) -> Any:
            return scores.argmax(axis=1)

        return best

    return load
