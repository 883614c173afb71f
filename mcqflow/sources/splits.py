"""Reading dataset splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from mcqflow.operators.selection import order_statistics

TRAIN_SPLIT = "auxiliary_train"
EVAL_SPLIT = "validation"
FORMATS = ("parquet", "json", "orc")
MOST_SORTED = 10_000


def read_split(
    spark: SparkSession,
    path: str,
    split: str,
    fmt: str = "parquet",
    schema: StructType | None = None,
    config: str | None = None,
) -> DataFrame:
    """Rows of one split of a table partitioned by ``split``, or by ``config`` and ``split``;
    only its folder is read."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}, got {fmt!r}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.load(path).where(F.col("split") == split)
    return rows if config is None else rows.where(F.col("config") == config)


def read_splits(
    spark: SparkSession,
    path: str,
    train: str = TRAIN_SPLIT,
    evaluation: str = EVAL_SPLIT,
    fmt: str = "parquet",
    schema: StructType | None = None,
    config: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(train, evaluation) as lazy tables: one that is not used is never scanned."""
    return (
        read_split(spark, path, train, fmt, schema, config),
        read_split(spark, path, evaluation, fmt, schema, config),
    )


def count_splits(df: DataFrame) -> DataFrame:
    """``(split, n)``."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def first_items(df: DataFrame, n: int | None, by: str | Column = "item_id", most_sorted: int = MOST_SORTED) -> DataFrame:
    """The first ``n`` rows in ``by`` order, or all of them: a trial evaluation.

    Up to ``most_sorted`` rows are sorted in one task. More, by an integer, are those up to the key of
    that rank, which is found when this is called: a filter, so no task holds the rows.
    """
    if n is None:
        return df
    keyed = df.withColumn("_by", F.col(by) if isinstance(by, str) else by)
    integer = isinstance(keyed.schema["_by"].dataType, (ByteType, ShortType, IntegerType, LongType))
    if n <= most_sorted or not integer:
        return df.orderBy(by).limit(n)
    rows, known = keyed.agg(F.count(F.lit(1)), F.count("_by")).first()
    nulls = rows - known  # they come first
    if n >= rows:
        return df
    if n <= nulls:
        return keyed.where(F.col("_by").isNull()).limit(n).drop("_by")
    value, before = order_statistics(keyed, "_by", [n - nulls - 1])[0]
    ahead = keyed.where(F.col("_by").isNull() | (F.col("_by") < value))
    return ahead.union(keyed.where(F.col("_by") == value).limit(n - nulls - before)).drop("_by")
