"""Reading the engine's tables and picking current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder, stored as <name>.parquet (a file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def instant(column: str | Column) -> Column:
    """Timestamp of an ISO 8601 string with or without zone and fraction; null where it can't be read."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast("timestamp")


def current_rows(df: DataFrame, key: str = "id", order: str = "indexed_at") -> DataFrame:
    """The row with the latest `order` for each `key`; among ties any one, as tying rows are identical.

    One shuffle by key of the columns that df has, so select columns first. Rows whose `order` can't be
    read as a time come after all others; a null key is a key like any other.
    """
    newest = Window.partitionBy(key).orderBy(instant(order).desc_nulls_last(), F.col(order).desc_nulls_last())
    return df.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank")
