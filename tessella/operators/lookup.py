"""Fields by path, section summaries and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.integrity import ALGORITHMS


def normal(name: Column) -> Column:
    """A name with blanks as underscores, as paths take both for the same."""
    return F.translate(name, " ", "_")


def get_field(fields: DataFrame, path: str) -> DataFrame:
    """file_id and value of section.field: the first of its name in each file; a section may have dots itself.

    fields: file_id, section, ordinal, name, value. Files without the field have no row. The filter reaches the scan.
    """
    section, dot, name = path.rpartition(".")
    if not (section and dot and name):
        raise ValueError("a path is section.field")
    found = fields.filter((normal(F.col("section")) == section.replace(" ", "_")) & (normal(F.col("name")) == name.replace(" ", "_")))
    return found.groupBy("file_id").agg(F.min_by("value", "ordinal").alias("value"))


def section_info(labels: DataFrame, fields: DataFrame) -> DataFrame:
    """One row for each section of each file: offset, size, fields declared and fields found, and notes on signature and encryption.

    labels: file_id, ordinal, name, offset_bytes, size_bytes, child_count, and where they are known signature, key and wrap: ids
    of ALGORITHMS, or null. A section is encrypted where it has both a wrap and a key of a cipher.
    """
    counts = fields.groupBy("file_id", F.col("section").alias("name")).agg(F.count(F.lit(1)).alias("fields_found"))
    rows = labels.join(counts, ["file_id", "name"], "left")
    id_of = lambda c: F.col(c) if c in labels.columns else F.lit(None).cast("string")

    def note(text: str, kind: str, ids: str, where: Column) -> list[Column]:
        return [F.when(where & (id_of(kind) == i), f"{text} {name}") for k, i, name, _ in ALGORITHMS if k == kind and i in ids]

    notes = F.concat_ws(", ", *note("Signed with", "signature", "epr", F.lit(True)), *note("Encrypted with", "key", "ca", id_of("wrap").isNotNull()))
    found = F.coalesce("fields_found", F.lit(0).cast("bigint")).alias("fields_found")
    return rows.select("file_id", "ordinal", "name", "offset_bytes", "size_bytes", "child_count", found, notes.alias("notes"))


def tree_line(name: Column, value: Column) -> Column:
    """A field as a line "  name: value" (C8)."""
    return F.concat(F.lit("  "), name, F.lit(": "), F.coalesce(value.cast("string"), F.lit("")))


def tree_lines(fields: DataFrame) -> DataFrame:
    """file_id, section, ordinal and the line of each field (C8); order by these to print them."""
    return fields.select("file_id", "section", "ordinal", tree_line(F.col("name"), F.col("value")).alias("line"))
