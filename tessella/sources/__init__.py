"""Sources and sinks: tables of a data folder and whole files as binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import reach_workers


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder; only the columns and rows that a plan needs are read."""
    reach_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and content of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Writes Parquet, in folders by the values of partition_by."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def long_format(df: DataFrame, key: str, section: str) -> DataFrame:
    """(file_id, section, ordinal, name, value as text) of every column but the key; nulls are left out."""
    from tessella.operators.records import to_fields

    names = [c for c in df.columns if c != key]
    return to_fields(df, key, names).select(F.col(key).alias("file_id"), F.lit(section).alias("section"), "ordinal", "name", "value")
