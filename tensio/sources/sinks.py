"""Sinks: CSV with a header (no index), per-class CSV export, Parquet hand-over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row, ``"``-quoted fields as needed, values as they are (blanks at either end
    stay); the directory is created."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_class(df: DataFrame, path: str, col: str, value, mode: str = "overwrite") -> None:
    """Rows of one class only (e.g. the negative predictions)."""
    write_csv(df.filter(F.col(col) == F.lit(value)), path, mode)


def write_partitioned(df: DataFrame, path: str, *cols: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by ``cols`` (e.g. platform, predicted class) for pruned reads."""
    df.write.mode(mode).partitionBy(*cols).parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
