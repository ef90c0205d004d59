"""Column functions on streams.

Every function of tessella.functions that is made of Spark builtins has no state, so it applies to a streaming DataFrame as
it does to a table. What counts over time keeps its state behind a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import bits


def with_columns(stream: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds stateless columns to a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("this DataFrame is no stream; use withColumns")
    return stream.withColumns(columns)


def width_counts(rows: DataFrame, time: str, value: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """begin, width and n: how many numbers of each width class each window of time has (E3 as a statistic).

    On a stream, state is kept for windows that may still get rows: those that end less than `late` before the newest time.
    Rows that come later are left out, as append and update sinks need; a table is counted whole.
    """
    kept = rows.withWatermark(time, late) if rows.isStreaming else rows
    counts = kept.groupBy(F.window(time, every).alias("w"), bits.width_class(F.col(value)).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("begin"), "width", "n")
