"""Helpers shared by the corpus operators: shared storage, Arrow passes, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import reach_workers

#: The white space of the text rules: space and the control characters 9 to 13.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word under the same rules, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; the session's settings are never changed.

    Where it is unset, a session on a local master takes a temporary folder. On a cluster that is an error: each executor
    would write to a disk of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessella-"))
    return _LOCAL[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which is deleted at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex[:12]}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def park(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, a lost executor costs nothing.

    Tables that no later plan reads can be given to forget; the others go when the driver ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than two for each core, or one for each 10,000 of its rows where that is more.

    For small rows that are parked: one file for each shuffle partition is thousands of tiny ones, and where Hadoop's native
    library is missing a local file system starts a process for the mode of every file.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // 10_000)))


def forget(*frames: DataFrame) -> None:
    """Deletes the parked tables that frames read, and which no later plan reads."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            if "/tessella/" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as BIGINT; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(column, rows: int = 256):
    """The texts of an Arrow column, null as empty, some rows at a time, so that a worker doesn't hold a whole batch twice."""
    for i in range(0, len(column), rows):
        for text in column.slice(i, rows).to_pylist():
            yield text or ""
