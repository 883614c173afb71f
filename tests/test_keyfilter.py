"""The Bloom filter of keys, and scores that it keeps from being reduced."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mcqflow.operators import accuracy, keyfilter
from mcqflow.operators.keyfilter import KeyFilter, word_count


def test_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(3000).select((F.col("id") * 7).alias("item"), (F.col("id") % 5).cast("int").alias("pos"))
    others = spark.range(20_000).select((F.col("id") * 7 + 3).alias("item"), (F.col("id") % 5).cast("int").alias("pos"))
    needed = KeyFilter.of(keys, ["item", "pos"], 3000)
    assert keys.where(~needed.may_hold()).count() == 0
    assert others.where(needed.may_hold()).count() < 1000
    wide = keys.select(F.col("item").cast("decimal(20,0)").alias("item"), F.col("pos").cast("bigint").alias("pos"))
    assert wide.where(~needed.may_hold()).count() == 0
    none = KeyFilter.of(keys.limit(0), ["item", "pos"], 0)
    assert others.where(none.may_hold()).count() == 0


def test_size_is_bounded():
    assert [word_count(n) for n in (0, 1, 6, 1000, 10**12)] == [1, 1, 2, 256, keyfilter.MAX_WORDS]


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_only_needed_vectors_are_reduced(spark, monkeypatch, most):
    """With a filter that is too small nothing is lost."""
    monkeypatch.setattr(keyfilter, "MAX_WORDS", most)
    tokens = spark.createDataFrame([(i, [-100] * (i % 7) + [i % 3, 1]) for i in range(200)] + [(900, [-100])], "item_id bigint, labels array<int>")
    made = [(i, p, [0.0 if t != i % 3 else 1.0 for t in range(3)]) for i in range(220) for p in range(9)]
    scores = spark.createDataFrame(made, "item_id bigint, pos int, logits array<double>")
    scored = accuracy.score_long_logits(tokens, scores)
    assert scored.count() == 200 and scored.where("correct").count() == 200
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan
    reads = [line for line in plan.splitlines() if "logits" in line and "Project" in line]
    assert reads and "Filter" in plan.split(reads[0])[1].splitlines()[1]
    passed = KeyFilter.of(accuracy.first_tokens(tokens), ["item_id", "pos"], 201).may_hold()
    reduced = scores.where(passed).count()
    assert reduced == len(made) if most == 1 else reduced < 300
