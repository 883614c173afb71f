"""Exact order statistics of a key, and batches whose bounds are exact.

``order_statistics`` narrows each rank down by histograms of the key's bits, some at a time,
over the key column alone. ``exact_batches`` takes the keys at multiples of the batch size as
bounds of partitions: rows are moved once, to a partition that starts with a batch, and
sorted there, and their number is the partition's rank plus their place in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from mcqflow.operators.batching import consecutive_batches, with_batch

FIRST_BITS = 16  # in the first pass, of one histogram
DIGIT_BITS = 12
MAX_PARTITIONS = 65_536
_SIGN = -(1 << 63)
_ROW_BITS = 33  # monotonically_increasing_id() holds the row of a partition in so many bits


def _unsigned(key: Column) -> Column:
    """The key with its sign flipped: bits that sort as the key does."""
    return key.cast("bigint").bitwiseXOR(F.lit(_SIGN))


def order_statistics(df: DataFrame, key: str, ranks: Sequence[int]) -> list[tuple[int, int]]:
    """``(value, before)`` for each 0-based rank of the integer ``key``: the key there, and how many
    rows have a smaller one. Null keys are not counted.

    The first pass counts ``FIRST_BITS`` bits. A later one counts the next ``DIGIT_BITS`` bits of the keys that agree with some wanted key so
    far, so its histogram has a row for each of those and digit, however many rows there are,
    and the driver sees one row for each rank. Bits that all keys share are skipped.
    """
    keys = df.select(F.col(key).cast("bigint").alias("key")).where("key is not null")
    if not ranks:
        return []
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if min(ranks) < 0 or max(ranks) >= n:
        raise ValueError(f"ranks must be 0 to {n - 1}")
    return _narrowed(keys, low, high, ranks)


def _narrowed(keys: DataFrame, low: int, high: int, ranks: Sequence[int]) -> list[tuple[int, int]]:
    """``order_statistics`` of the column ``key`` between two values."""
    bits = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64
    spark, most = keys.sparkSession, FIRST_BITS
    # Of each rank: its place, the leading bits known so far, the rank among keys that share them, and the rows before those.
    shared = _signed((low & _MASK ^ 1 << 63) >> bits)
    found = [(i, shared, rank, 0) for i, rank in enumerate(ranks)]
    while bits:
        width, most = min(most, bits), DIGIT_BITS
        bits -= width
        wanted = spark.createDataFrame(found, "i int, parent bigint, rank bigint, before bigint")
        u = _unsigned(F.col("key"))
        parent = _shifted(u, bits + width).alias("parent")
        digit = _shifted(u, bits).bitwiseAND(F.lit((1 << width) - 1)).alias("digit")
        seen = keys.select(parent, digit).join(F.broadcast(wanted.select("parent").distinct()), "parent", "left_semi")
        counts = seen.groupBy("parent", "digit").agg(F.count(F.lit(1)).alias("n"))
        earlier = W.partitionBy("parent").orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
        bins = counts.withColumn("below", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        here = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))
        rows = bins.join(F.broadcast(wanted), "parent").where(here).collect()
        found = [
            (r.i, _signed((r.parent & _MASK) << width | r.digit), r["rank"] - r.below, r.before + r.below) for r in rows
        ]
    found.sort()
    return [(_signed((prefix & _MASK) ^ 1 << 63), before) for _, prefix, _, before in found]


_MASK = (1 << 64) - 1


def _signed(bits: int) -> int:
    bits &= _MASK
    return bits - (1 << 64) if bits >> 63 else bits


def _shifted(u: Column, bits: int) -> Column:
    """The leading bits; a shift by the whole width leaves nothing."""
    return F.lit(0).cast("bigint") if bits >= 64 else F.shiftrightunsigned(u, bits)


def bounds_below(key: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds are at most ``key``, by halving; 0 for a null key."""
    table = F.array(*(F.lit(b).cast("bigint") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    state = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = F.get(table, mid) <= key
        return F.when(s["low"] >= s["high"], s).when(up, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), mid.alias("high"))
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    return F.when(key.isNull(), 0).otherwise(F.aggregate(steps, state, half, lambda s: s["low"]))


def exact_batches(
    df: DataFrame, batch_size: int, item: str = "item_id", partitions: int | None = None
) -> DataFrame:
    """Add ``batch_id`` and ``slot`` as ``consecutive_batches`` does. The rows of a batch stand one after
    the other, in one partition, in the order of ``item``.

    Counts and histograms of ``item`` are taken when this is called. The rows themselves cross one
    exchange. Where ids repeat, or are null, at a bound, no key separates the two sides, and
    the rows are numbered and moved by batch instead; so is a key that is no integer.
    """
    spark = df.sparkSession
    partitions = min(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_PARTITIONS)
    if not isinstance(df.schema[item].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return _moved(df, batch_size, item)
    rows, known, low, high = df.agg(F.count(F.lit(1)), F.count(item), F.min(item), F.max(item)).first()
    batches = -(-rows // batch_size)
    each = max(1, -(-batches // partitions)) * batch_size
    nulls = rows - known
    wanted = list(range(each, rows, each))
    if wanted and wanted[0] < nulls:
        return _moved(df, batch_size, item)
    keys = df.select(F.col(item).cast("bigint").alias("key")).where("key is not null")
    found = _narrowed(keys, low, high, [r - nulls for r in wanted]) if wanted else []
    if [before + nulls for _, before in found] != wanted:
        return _moved(df, batch_size, item)
    bounds = [value for value, _ in found]
    placed = df.withColumn("_part", bounds_below(F.col(item).cast("bigint"), bounds).cast("int"))
    moved = placed.repartitionById(len(bounds) + 1, "_part").sortWithinPartitions(item)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = moved.withColumn("_index", F.col("_part") * F.lit(each).cast("bigint") + row)
    return with_batch(numbered, "_index", batch_size).drop("_part", "_index")


def _moved(df: DataFrame, batch_size: int, item: str) -> DataFrame:
    batched = consecutive_batches(df, batch_size, item)
    return batched.repartition("batch_id").sortWithinPartitions("batch_id", "slot")
