"""Words, names and folders that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(column: str | Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text_of(column), SPACE), "")


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(start: Column, stop: Column) -> Column:
    """start, start + 1, ..., stop - 1; empty unless start < stop."""
    none = F.array().cast("array<int>")
    return F.when(start < stop, F.sequence(start.cast("int"), (stop - 1).cast("int"))).otherwise(none)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only where that is unset,
    as in tests, one in the warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder under the shared one."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that a lost executor costs no earlier step."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
