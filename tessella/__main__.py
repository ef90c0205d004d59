"""Command line over a folder of row tables (C10): info, verify, get and tree.

The folder holds Parquet tables: labels (file_id, ordinal, name, offset_bytes, size_bytes, child_count, and where known
hash, signature, key, wrap), fields (file_id, section, ordinal, name, value) and for verify files (file_id, content, magic).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import display
from tessella.operators import integrity, lookup
from tessella.sources import table


def lines_of(spark: SparkSession, command: str, folder: str, path: str | None = None) -> DataFrame:
    """The lines that a command prints, with the columns that order them: file_id, place, line."""
    if command == "get":
        found = lookup.get_field(table(spark, folder, "fields"), path or "")
        return found.select("file_id", F.lit("").alias("place"), F.coalesce("value", F.lit("")).alias("line"))
    if command == "tree":
        lines = lookup.tree_lines(table(spark, folder, "fields"))
        return lines.select("file_id", F.concat("section", F.lit("/"), F.lpad(F.col("ordinal").cast("string"), 10, "0")).alias("place"), F.concat("section", "line").alias("line"))
    labels = table(spark, folder, "labels")
    if command == "info":
        rows = lookup.section_info(labels, table(spark, folder, "fields"))
        size = display.byte_size(F.col("size_bytes"))
        line = F.concat_ws("  ", "name", F.concat(F.lit("at "), display.grouped_number(F.col("offset_bytes"))), size, F.concat(F.col("fields_found").cast("string"), F.lit(" fields")), F.when(F.col("notes") != "", F.col("notes")))
        return rows.select("file_id", F.lpad(F.col("ordinal").cast("string"), 10, "0").alias("place"), line.alias("line"))
    for name in ("hash", "signature"):
        labels = labels if name in labels.columns else labels.withColumn(name, F.lit(None).cast("string"))
    result = integrity.verify(table(spark, folder, "files"), labels)
    verdict = integrity.verdicts(result).select("file_id", F.lit("~").alias("place"), F.col("verdict").alias("line"))
    return result.select("file_id", F.col("check").alias("place"), F.concat_ws("  ", "status", "check").alias("line")).unionByName(verdict)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints the lines of a command; 1 where verify finds a file that isn't valid, or get no field."""
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=("info", "verify", "get", "tree"))
    parser.add_argument("folder")
    parser.add_argument("path", nargs="?", help="section.field, for get")
    given = parser.parse_args(arguments)
    if (given.command == "get") != (given.path is not None):
        parser.error("get takes a path, the others none")
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    found = bad = 0
    for row in lines_of(spark, given.command, given.folder, given.path).orderBy("file_id", "place").toLocalIterator():
        print(f"{row['file_id']}  {row['line']}")
        found += 1
        bad += given.command == "verify" and row["place"] == "~" and row["line"] == "INVALID"
    return int(bad > 0 or given.command == "get" and not found)


if __name__ == "__main__":
    raise SystemExit(main())
