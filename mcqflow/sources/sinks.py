"""Writing prepared tables and result records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

MAX_RECORD_ROWS = 10_000


def write_prepared(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("split",),
    mode: str = "errorifexists",
    max_records_per_file: int = 0,
) -> DataFrame:
    """Write a prepared table as parquet and return it read back, so that what follows
    starts from the files and not from the work behind them."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_record(record: DataFrame, path: str, mode: str = "errorifexists", max_rows: int = MAX_RECORD_ROWS) -> None:
    """Write a result record (a row or a few) as one UTF-8 JSON lines file, committed whole.

    No more than ``max_rows`` are ever brought together: a larger table is refused before anything is written.
    """
    rows = record.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"over {max_rows} rows are no record: write them as a table")
    held = record.sparkSession.createDataFrame(rows, record.schema)
    held.coalesce(1).write.mode(mode).json(path)


def write_subjects(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the flat per-subject table."""
    table.write.mode(mode).parquet(path)
