"""Global row numbers without a one-task window.

``row_number()`` over an un-partitioned window sorts the whole table in one
task. Here rows go to order-preserving buckets; each bucket is numbered by its
own task, and a prefix sum over the bucket sizes adds the offsets. The result
equals the global ``row_number() - 1`` exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

MAX_BUCKETS = 65536
QUANTILE_ERROR = 1 / 16384
TEXT_BUCKETS = 64

# The offset table has a row per group and bucket. It is broadcast only when the
# caller knows the number of groups and the product stays within this.
BROADCAST_ROWS = 1_000_000


def _number(
    df: DataFrame,
    bucket: str,
    buckets: int,
    order: Sequence[str],
    within: Sequence[str],
    groups: int | None,
    out: str,
) -> DataFrame:
    # The bucket leads: sorting compares the first key cheaply, and groups are few.
    keys = [bucket, *within]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    if not within:
        groups = 1
    if groups is not None and groups * buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    # Otherwise Spark picks the join from measured sizes; the rows are hashed by
    # the same keys either way, for the window below.
    here = W.partitionBy(*keys).orderBy(*order)
    rank = F.row_number().over(here) - 1
    return _join_offsets(df, offsets, keys).withColumn(out, F.col("_offset") + rank).drop(bucket, "_offset")


def _join_offsets(df: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A null key is a group like any other, so the join must not lose it."""
    named = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return df.join(named, same).drop(*(f"_of_{k}" for k in keys))


def default_buckets(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(4 * partitions, MAX_BUCKETS))


def quantile_buckets(df: DataFrame, key: str, out: str, buckets: int) -> DataFrame:
    """Add ``out``: an order-preserving bucket of the numeric column ``key``.

    Runs one job over ``key`` alone for the approximate quantiles, so clustered
    or sparse keys still spread evenly. The boundaries are constants of the
    plan: a task that is run again assigns the same buckets.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    # A coarser error keeps the summaries small however many buckets there are.
    cuts = df.select(F.col(key).cast("double").alias(key)).approxQuantile(
        key, probabilities, max(1 / (4 * buckets), QUANTILE_ERROR)
    )
    inner = sorted(set(cuts))
    if not inner:
        return df.withColumn(out, F.lit(0))
    # Null keys come first, as they do in the order inside a bucket.
    keyed = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    splits = [float("-inf"), *inner, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_key", outputCol=out).transform(keyed)
    return placed.withColumn(out, F.col(out).cast("int")).drop("_key")


def row_index(
    df: DataFrame,
    key: str = "item_id",
    out: str = "row_index",
    within: Sequence[str] = (),
    groups: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """0-based position of each row in the order of the unique numeric ``key``,
    over the whole table or inside each ``within`` group.

    A large group is spread over many buckets, so no group is sorted by one task.
    ``groups`` is an upper bound on the number of groups, where one is known.
    """
    buckets = buckets or default_buckets(df)
    bucketed = quantile_buckets(df, key, "_bucket", buckets)
    return _number(bucketed, "_bucket", buckets, [key], within, groups, out)


def hashed_index(
    df: DataFrame,
    key: Column,
    out: str = "row_index",
    within: Sequence[str] = (),
    groups: int | None = None,
    hex_digits: int = 4,
) -> DataFrame:
    """As ``row_index`` for a key that is a hex digest: its leading digits are the bucket.

    Four digits make 65,536 even buckets, so a bucket of a hundred billion rows is
    some 1.5 million.
    """
    if not 1 <= hex_digits <= 4:
        raise ValueError("hex_digits must be 1 to 4")
    keyed = df.withColumn("_key", key)
    bucketed = keyed.withColumn("_bucket", F.substring("_key", 1, hex_digits))
    return _number(
        bucketed, "_bucket", 16**hex_digits, ["_key"], within, groups, out
    ).drop("_key")


def text_index(df: DataFrame, key: str, out: str = "row_index", within: Sequence[str] = ()) -> DataFrame:
    """As ``row_index`` for a unique string ``key``. Bucket bounds are read off the keys with the
    smallest hashes, a few for each bucket; they only decide how even the buckets are."""
    some = df.select(key).orderBy(F.xxhash64(key)).limit(8 * TEXT_BUCKETS).collect()
    keys = sorted(r[0] for r in some if r[0] is not None)
    bounds = keys[:: max(1, len(keys) // TEXT_BUCKETS)] or [""]
    cuts = F.array(*(F.lit(b) for b in bounds))
    bucket = F.size(F.filter(cuts, lambda b: b <= F.coalesce(F.col(key), F.lit(""))))
    return _number(df.withColumn("_bucket", bucket), "_bucket", len(bounds) + 1, [key], within, None, out)


def running_sum(df: DataFrame, value: str, key: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` over the rows before each row in the order of the unique numeric ``key``,
    inside each ``within`` group. A large group is spread over many buckets."""
    rows = quantile_buckets(df, key, "_bucket", default_buckets(df))
    keys = ["_bucket", *within]
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    here = W.partitionBy(*keys).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(here), F.lit(0))
    return _join_offsets(rows, offsets, keys).withColumn(out, F.col("_offset") + inside).drop("_bucket", "_offset")
