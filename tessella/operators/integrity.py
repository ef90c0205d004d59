"""Digests, their verification and the table of algorithms (V1, V3, V4, V8, V9).

Digests are SHA-2, which Spark has built in. Section hashes and file hashes are made and checked; signatures are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.algorithms import ALGORITHMS

def algorithms(spark: SparkSession) -> DataFrame:
    """The table of algorithms: kind, id, name, length (V9)."""
    return spark.createDataFrame(ALGORITHMS, "kind string, id string, name string, length int")


def is_known(kind: Column, id_: Column) -> Column:
    """Whether an algorithm is in the table (V9)."""
    return F.concat_ws("/", kind, id_).isin(*[f"{k}/{i}" for k, i, _, _ in ALGORITHMS])


def file_hash(content: Column, at: int | Column, size: int = 32) -> Column:
    """SHA-256 of a binary with `size` bytes from offset `at` read as zeros, as the place of the hash itself (V1)."""
    at = F.lit(at) if isinstance(at, int) else at
    head, tail = F.substring(content, F.lit(1), at), F.substring(content, at + size + 1, F.octet_length(content))
    return F.unhex(F.sha2(F.concat(head, F.lit(bytes(size)), tail), 256))


def file_hash_holds(content: Column, at: int | Column, size: int = 32) -> Column:
    """Whether the bytes at the hash's place are the file's hash (V3)."""
    place = F.lit(at) if isinstance(at, int) else at
    return F.substring(content, place + 1, F.lit(size)) == file_hash(content, at, size)


def section_hash(content: Column, offset: Column, size: Column) -> Column:
    """SHA-256 of a section's bytes, in hex (V4)."""
    return F.sha2(F.substring(content, offset + 1, size), 256)


def _status(content: Column, offset: Column, size: Column, digest: Column) -> Column:
    """PASS, FAIL or ABSENT by a section's hash; a section that goes beyond the content fails."""
    inside = (offset >= 0) & (size >= 0) & (offset.cast("bigint") + size <= F.octet_length(content))
    own = section_hash(content, offset.cast("int"), size.cast("int"))
    return F.when(digest.isNull(), "ABSENT").when(inside & (F.lower(digest) == own), "PASS").otherwise("FAIL")


def _hash_status() -> Column:
    return _status(*(F.col(c) for c in ("content", "offset_bytes", "size_bytes", "hash")))


def checks_in_file(content: Column, magic: Column, sections: Column) -> Column:
    """checks as an array of struct<check, status> of a file whose sections are an array, so its content is read in one place and not copied (V4, V8).

    sections: array<struct<name, offset_bytes, size_bytes, hash>>.
    """
    row = lambda check, status: F.struct(check.alias("check"), status.alias("status"))
    begins = F.coalesce(F.substring(content, F.lit(1), F.octet_length(magic)) == magic, F.lit(False))
    by_section = F.transform(sections, lambda s: row(F.concat(F.lit("section "), s["name"]), _status(content, s["offset_bytes"], s["size_bytes"], s["hash"])))
    return F.concat(F.array(row(F.lit("magic"), F.when(begins, "PASS").otherwise("FAIL"))), by_section)


def checks(sections: DataFrame) -> DataFrame:
    """file_id, check, status: PASS, FAIL or ABSENT for each section, and one row for the magic bytes (V8).

    sections: file_id, name, content, offset_bytes, size_bytes, hash (hex, may be null), magic (binary).
    """
    by_section = sections.select("file_id", F.concat(F.lit("section "), "name").alias("check"), _hash_status().alias("status"))
    magic = F.when(F.substring("content", F.lit(1), F.octet_length("magic")) == F.col("magic"), "PASS").otherwise("FAIL")
    by_file = sections.groupBy("file_id").agg(F.min(magic).alias("status")).select("file_id", F.lit("magic").alias("check"), "status")
    return by_section.unionByName(by_file)


def check_counts(result: DataFrame) -> DataFrame:
    """Checks that passed, failed and had nothing to check, for each file (V4, V8)."""
    return result.groupBy("file_id").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("ABSENT", "absent"))])


def verify(files: DataFrame, sections: DataFrame) -> DataFrame:
    """file_id, check, status: PASS, FAIL, WARN or ABSENT for magic and header of each file, then hash and signature of each section, and the token section (V8).

    files: file_id, content, magic (the bytes that a file must begin with). sections: file_id, name, offset_bytes, size_bytes,
    hash (hex, may be null), signature (null where there is none). A header is valid where each section has a name, an offset
    and a size, neither below zero. Files without a valid header have no rows but these two. Signatures and tokens are not
    checked, so their presence is a warning; a section without a signature has no row for it.
    """
    of_file = F.coalesce(F.substring("content", F.lit(1), F.octet_length("magic")) == F.col("magic"), F.lit(False))
    sound = F.coalesce((F.length("name") > 0) & (F.col("offset_bytes") >= 0) & (F.col("size_bytes") >= 0), F.lit(False))
    token = F.coalesce(F.col("name").isin("token_auth", "token auth"), F.lit(False))
    facts = sections.groupBy("file_id").agg(F.bool_and(sound).alias("sound"), F.bool_or(token).alias("token"))
    heads = files.select("file_id", "content", of_file.alias("good")).join(facts, "file_id", "left")
    heads = heads.withColumn("sound", F.coalesce("sound", F.lit(True)) & F.col("content").isNotNull())

    def row(check, status):
        return F.struct(check.alias("check"), status.alias("status"))

    passed = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    token_row = row(F.lit("token"), F.when(F.col("token"), "WARN").otherwise("ABSENT"))
    own = F.array(row(F.lit("magic"), passed(F.col("good"))), row(F.lit("header"), passed(F.col("sound"))), F.when(F.col("sound"), token_row))
    by_file = heads.select("file_id", F.inline(F.array_compact(own)))
    parts = sections.join(heads.filter("sound").select("file_id", "content"), "file_id")
    both = F.array(row(F.concat(F.lit("section "), "name"), _hash_status()), F.when(F.col("signature").isNotNull(), row(F.concat(F.lit("signature "), "name"), F.lit("WARN"))))
    return by_file.unionByName(parts.select("file_id", F.inline(F.array_compact(both))))


def verdicts(result: DataFrame) -> DataFrame:
    """file_id, errors, warnings and verdict of the rows of verify (V8)."""
    counts = result.groupBy("file_id").agg(F.count_if(F.col("status") == "FAIL").alias("errors"), F.count_if(F.col("status") == "WARN").alias("warnings"))
    verdict = F.when(F.col("errors") > 0, "INVALID").when(F.col("warnings") > 0, "VALID").otherwise("ALL CHECKS PASSED")
    return counts.withColumn("verdict", verdict)
