"""Accuracy: counts that merge, per-subject tables, the result record, run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mcqflow.functions.answers import is_correct, parse_letter
from mcqflow.functions.labels import argmax, first_supervised, has_supervision, token_at
from mcqflow.operators.alignment import unique_outputs
from mcqflow.operators.keyfilter import KeyFilter

# A record's subject map is one row; more subjects than this belong in the table.
MAX_RECORD_SUBJECTS = 100_000


def subject_or_blank(subject: Column) -> Column:
    return F.coalesce(subject, F.lit(""))


def ratio(correct: Column, total: Column) -> Column:
    """Share of correct rows; 0.0 of nothing."""
    return F.coalesce(F.try_divide(correct, total), F.lit(0.0))


def score_letters(df: DataFrame, text: str = "output_text", gold: str = "gold") -> DataFrame:
    """Add the parsed letter ``pred`` and the flag ``correct``."""
    return df.withColumn("pred", parse_letter(F.col(text))).withColumn(
        "correct", is_correct(F.col("pred"), F.col(gold))
    )


def count_correct(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``correct`` and ``total`` counts of flagged rows, overall or by group.

    Spark counts inside each task first, so a group of any size sends one row
    per task over the exchange.
    """
    flags = F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0)).cast("bigint")
    return df.groupBy(*by).agg(flags.alias("correct"), F.count(F.lit(1)).alias("total"))


def merge_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum counts made by shards, workers or earlier jobs."""
    total = {c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("correct", "total")}
    return counts.groupBy(*by).agg(*total.values())


def with_accuracy(counts: DataFrame) -> DataFrame:
    return counts.withColumn("acc", ratio(F.col("correct"), F.col("total")))


def distinct_items(df: DataFrame, item: str = "item_id", by: Sequence[str] = ()) -> DataFrame:
    """One flagged row per item, where workers may have repeated some to even out.

    Repeats agree on ``correct``; copies are folded before the exchange.
    """
    return df.groupBy(item, *by).agg(F.max("correct").alias("correct"))


def overall_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``correct, total, acc`` over all rows, or per ``by`` group."""
    return with_accuracy(count_correct(df, by))


def subject_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``correct, total, acc`` per subject; a null subject is the empty one."""
    named = df.withColumn("subject", subject_or_blank(F.col("subject")))
    return overall_accuracy(named, [*by, "subject"])


def sort_subjects(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows in subject order."""
    return table.orderBy(*by, "subject")


def result_record(
    subjects: DataFrame, metric: str, max_subjects: int = MAX_RECORD_SUBJECTS
) -> DataFrame:
    """The one-row result: metric name, overall accuracy, count and subject map.

    Made from the per-subject counts, so the scored rows are read once. The map
    holds one entry per subject in name order. More than ``max_subjects`` is an
    error rather than a cut map; ``result_rows`` has no such bound.
    """
    held = subjects.select("subject", "correct", "total").orderBy("subject").limit(max_subjects + 1)
    entries = F.array_sort(
        F.collect_list(F.struct("subject", ratio(F.col("correct"), F.col("total")).alias("acc")))
    )
    correct, total = F.sum("correct"), F.coalesce(F.sum("total"), F.lit(0))
    fail = F.raise_error(F.lit("too many subjects for one record")).cast("boolean")
    fits = F.when(F.col("_subjects") <= max_subjects, F.lit(True)).otherwise(fail)
    return (
        held.agg(
            F.lit(metric).alias("metric"),
            ratio(correct, total).alias("overall_acc"),
            total.cast("bigint").alias("n"),
            F.map_from_entries(entries).alias("per_subject"),
            F.count(F.lit(1)).alias("_subjects"),
        )
        .where(fits)
        .drop("_subjects")
    )


def result_rows(subjects: DataFrame, metric: str) -> DataFrame:
    """The result in long form, ``metric, overall_acc, n, subject, acc``: a row per subject, however many
    there are. The totals are a scalar subquery, so the subjects stay where they are."""
    correct, total = F.sum("correct"), F.coalesce(F.sum("total"), F.lit(0))
    acc = ratio(F.col("correct"), F.col("total"))
    return subjects.select(
        F.lit(metric).alias("metric"),
        subjects.agg(ratio(correct, total)).scalar().alias("overall_acc"),
        subjects.agg(total.cast("bigint")).scalar().alias("n"),
        "subject",
        acc.alias("acc"),
    )


def compare_results(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Two per-subject tables side by side; a subject may be in either alone."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("subject", *(F.col(c).alias(f"{name}_{c}") for c in ("correct", "total", "acc")))

    joined = side(base, "base").join(side(tuned, "tuned"), "subject", "full")
    return joined.withColumn("delta", F.col("tuned_acc") - F.col("base_acc"))


def compare_runs(df: DataFrame, base: str, tuned: str) -> DataFrame:
    """``compare_results`` straight from scored rows that carry a ``run``: one scan,
    one aggregation, no join."""

    def side(run: str, name: str) -> list[Column]:
        mine = F.col("run") == run
        n = F.count(F.when(mine, F.lit(1)))
        hits = F.sum(F.when(mine, F.col("correct").cast("bigint")))
        seen = F.when(n > 0, n)
        return [
            hits.alias(f"{name}_correct"),
            seen.alias(f"{name}_total"),
            F.try_divide(hits, seen).alias(f"{name}_acc"),
        ]

    subject = subject_or_blank(F.col("subject")).alias("subject")
    both = df.where(F.col("run").isin(base, tuned)).groupBy(subject)
    return both.agg(*side(base, "base"), *side(tuned, "tuned")).withColumn(
        "delta", F.col("tuned_acc") - F.col("base_acc")
    )


# --- first supervised token -------------------------------------------------


def supervised_rows(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Rows with at least one supervised label; the others leave both counts."""
    return df.where(has_supervision(F.col(labels)))


def first_tokens(df: DataFrame, shift: int = 0) -> DataFrame:
    """Replace ``labels`` by ``pos`` (first supervised position less ``shift``) and
    the ``gold_token`` found at that first position; unsupervised rows go.

    ``shift=1`` reads the score one position earlier, where a causal model
    predicts the token; 0 compares at the same position.
    """
    at = first_supervised(F.col("labels"))
    return (
        df.withColumn("_at", at)
        .where(F.col("_at").isNotNull())
        .withColumn("gold_token", token_at(F.col("labels"), F.col("_at")))
        .withColumn("pos", F.col("_at") - shift)
        .drop("_at", "labels")
    )


def score_first_tokens(df: DataFrame, shift: int = 0) -> DataFrame:
    """Flag rows that hold ``labels`` and predicted ids ``pred_ids``, or the score
    vectors ``logits`` of every position (only the one needed is reduced)."""
    rows = first_tokens(df, shift)
    if "pred_ids" in df.columns:
        pred = token_at(F.col("pred_ids"), F.col("pos"))
    else:
        pred = argmax(F.get(F.col("logits"), F.col("pos")))
    return rows.withColumn("pred_token", pred).withColumn(
        "correct", is_correct(F.col("pred_token"), F.col("gold_token"))
    )


def score_long_logits(
    tokens: DataFrame, scores: DataFrame, shift: int = 0, item: str = "item_id"
) -> DataFrame:
    """As ``score_first_tokens`` with scores in a long table ``(item, pos, logits)``.

    Only vectors at an ``(item, pos)`` that is scored are reduced: a Bloom filter of those, of
    bounded size, is made by an aggregate and tested where the scores are read. The few others it
    lets pass meet no gold row in the join. A vector becomes one id where it is read; what
    crosses the exchange is ``(item, pos, id)``, never a vector. Repeated scores of one
    position are an error if they differ. The rows of ``tokens`` are counted when this is called.
    """
    gold = first_tokens(tokens, shift)
    needed = KeyFilter.of(gold, [item, "pos"], tokens.count())
    picks = scores.where(needed.may_hold()).select(item, "pos", argmax(F.col("logits")).alias("pred_token"))
    picks = unique_outputs(picks.distinct(), [item, "pos"])
    return gold.join(picks, [item, "pos"], "left").withColumn(
        "correct", is_correct(F.col("pred_token"), F.col("gold_token"))
    )


def first_token_metric(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``first_token_acc`` and ``eval_samples`` of flagged rows."""
    return overall_accuracy(df, by).select(
        *by, F.col("acc").alias("first_token_acc"), F.col("total").alias("eval_samples"), "correct"
    )
