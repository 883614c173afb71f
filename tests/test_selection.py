"""Computed permutations, order statistics and exact batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mcqflow import fixtures as fx
from mcqflow.functions.permutation import permuted, sides
from mcqflow.functions.tokens import ByteCodec
from mcqflow.operators import batching, selection
from mcqflow.operators.predict import first_token_ordered_predictor
from mcqflow.plans.evaluate import evaluate_first_token, evaluate_first_token_batched
from mcqflow.plans.prepare import training_batches

BYTES = ByteCodec()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 101, 1000])
def test_positions_are_a_permutation(spark, n):
    rows = spark.range(n).select(permuted(F.col("id"), n, F.lit("1:0")).alias("a"), permuted(F.col("id"), n, F.lit("1:1")).alias("b"))
    got = rows.collect()
    assert sorted(r.a for r in got) == sorted(r.b for r in got) == list(range(n))
    a, b = sides(n)
    assert n <= a * b < n + a or n < 2
    if n > 100:
        assert sum(r.a == i for i, r in enumerate(got)) < 10 and sum(r.a == r.b for r in got) < 10


def test_positions_are_spread_evenly(spark):
    """Neighbours and halves of the index meet no pattern: a chi-squared of position quarter by index quarter."""
    n = 20_000
    rows = spark.range(n).select((F.col("id") * 4 / n).cast("int").alias("i"), (permuted(F.col("id"), n, F.lit("k")) * 4 / n).cast("int").alias("p"))
    counts = [r["count"] for r in rows.groupBy("i", "p").count().collect()]
    expected = n / 16
    assert len(counts) == 16 and sum((c - expected) ** 2 / expected for c in counts) < 30  # 9 degrees of freedom


def test_permuted_rows(spark):
    dense = spark.range(50).select((F.col("id") - 7).alias("item_id"))
    gaps = spark.range(50).select((F.col("id") * F.col("id")).alias("item_id"))
    for df in (dense, gaps):
        rows = batching.permuted_rows(df, seed=3, epochs=2).collect()
        place = {i: k for k, i in enumerate(sorted({r.item_id for r in rows}))}
        assert sorted((r.epoch, r.position) for r in rows) == [(e, p) for e in range(2) for p in range(50)]
        same = {(r.epoch, place[r.item_id]): r.position for r in rows}
        if df is dense:
            first = same
    assert first == same  # only the rank decides
    assert batching.permuted_rows(dense.limit(0)).count() == 0
    with pytest.raises(ValueError):
        batching.permuted_rows(dense.union(spark.sql("select null")))


def test_computed_order_moves_texts_once_an_epoch(spark, folder):
    items = fx.as_questions(fx.table(spark, folder, "part"))
    rows = training_batches(items, BYTES, 8, epochs=2, order="computed")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "row_number" not in plan
    executed = rows._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1
    with pytest.raises(ValueError):
        training_batches(items, BYTES, order="none")


@pytest.mark.parametrize(
    "values",
    [[5], [3, 1, 2], list(range(-50, 50)), [7] * 20 + [9] * 5 + [-3], [-(2**63), 2**63 - 1, 0], "wide", "even"],
)
def test_order_statistics(spark, values):
    r = random.Random(1)
    made = {"wide": lambda: r.randint(-(2**63), 2**63 - 1), "even": lambda: r.randint(0, 10**6)}
    keys = [made[values]() for _ in range(2000)] if isinstance(values, str) else values
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k bigint")
    keys = sorted(keys)
    ranks = [len(keys) - 1, 0, len(keys) // 2, len(keys) // 3, len(keys) // 2]
    got = selection.order_statistics(df, "k", ranks)
    assert got == [(keys[i], sum(x < keys[i] for x in keys)) for i in ranks]
    assert selection.order_statistics(df, "k", []) == []
    with pytest.raises(ValueError):
        selection.order_statistics(df, "k", [len(keys)])


def test_bounds_below(values):
    bounds = [-5, 0, 7, 2**62]
    keys = [-6, -5, -1, 0, 6, 7, 2**62, 2**63 - 1, None]
    assert values(keys, "bigint", lambda x: selection.bounds_below(x, bounds)) == [0, 1, 1, 2, 2, 3, 4, 4, 0]
    assert values([1], "bigint", lambda x: selection.bounds_below(x, [])) == [0]


@pytest.mark.parametrize("size, partitions", [(8, 4), (1, 7), (300, 3), (7, 100)])
@pytest.mark.parametrize("kind", ["unique", "repeated", "nulls", "double"])
def test_exact_batches(spark, size, partitions, kind):
    r = random.Random(2)
    ids = r.sample(range(-1000, 100_000), 205)
    if kind == "repeated":
        ids = ids[:100] + [3] * 105
    if kind == "nulls":
        ids = ids[:180] + [None] * 25
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "item_id bigint, t string").repartition(3)
    if kind == "double":
        ids = [i / 2 for i in ids]
        df = spark.createDataFrame([(i, "t") for i in ids], "item_id double, t string")
    got = selection.exact_batches(df, size, partitions=partitions).select("*", F.spark_partition_id().alias("p")).collect()
    places = {}
    for i, key in enumerate(sorted(ids, key=lambda x: (x is not None, x or 0))):
        places.setdefault(key, []).append(i)
    found = {}
    for row in got:
        found.setdefault(row.item_id, []).append(row.batch_id * size + row.slot)
    assert {k: sorted(v) for k, v in found.items()} == places
    homes = {}
    for row in got:
        homes.setdefault(row.batch_id, set()).add(row.p)
    assert all(len(h) == 1 for h in homes.values())
    assert selection.exact_batches(df.limit(0), size).count() == 0


def test_model_sees_exact_batches(spark, monkeypatch):
    """Batches that Arrow chunks cut are put together again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [(i, i // 5, [i] * (i % 4 + 1), None if i % 7 == 0 else 0) for i in range(23)]
        df = spark.createDataFrame(data, "item_id bigint, batch_id bigint, input_ids array<int>, pos int").coalesce(1)

        def load():
            import numpy as np

            # The sum of the whole batch, so that its members are visible in each prediction.
            return lambda ids, mask: np.full(ids.shape, (ids * mask).max())

        rows = first_token_ordered_predictor(df, load, 99).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.item_id: r.pred_token for r in rows} == {i: min(i // 5 * 5 + 4, 22) for i in range(23) if i % 7}


def test_batched_evaluation_moves_texts_once(spark, folder):
    items = fx.as_questions(fx.table(spark, folder, "part"))
    batched = evaluate_first_token_batched(items, fx.first_token_model(), BYTES, max_seq_len=300)
    plan = batched.scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    one = evaluate_first_token(items, fx.first_token_model(), BYTES, max_seq_len=300)
    assert sorted(map(tuple, batched.subjects.collect())) == sorted(map(tuple, one.subjects.collect()))
