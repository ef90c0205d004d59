"""A corpus from raw documents to packed sequences: every stage reads what the one before kept, from Parquet.

Counted as part of the subpackage tessella.llm, which it needs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import reach_workers
from tessella.llm.common import forget, park, table
from tessella.llm.linededup import dedup_lines
from tessella.llm.mixing import mixed_documents
from tessella.llm.neardup import near_duplicates
from tessella.llm.packing import pack
from tessella.llm.queries import TOKENIZER
from tessella.llm.toxicity import score_toxicity, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer predicts to be toxic go."""
    docs = docs.select(*COLUMNS)
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one; documents that had nothing else go, those that were empty before stay."""
    cut = dedup_lines(docs.select(*COLUMNS))
    return _documents(cut.filter("n_dropped = 0 OR length(text) > 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the smallest doc_id, of its texts that of the smallest hash.

    A document is a doc_id with a text: of rows that repeat one stays, and of a doc_id with two texts each has its own group. Rows
    without a doc_id take part by their text, after all others in order. Those without words are linked with nothing: such rows
    with a doc_id stay once for each doc_id and text, such rows without one stay all.
    """
    reach_workers(spark)
    docs = docs.select(*COLUMNS)
    anonymous = F.col("doc_id").isNull()
    rank = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    keyed = docs.withColumn("key", F.struct(anonymous.alias("anonymous"), rank.alias("id"), F.xxhash64("text").alias("mark")))
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).filter("kept")
    kept = park(found.select(F.col("doc_id").alias("key"), (F.col("doc_id.anonymous") & (F.col("n_shingles") == 0)).alias("wordless")).distinct(), "kept-documents")
    rows = keyed.join(kept.filter("NOT wordless").select("key"), "key").dropDuplicates(["key"])
    nameless = keyed.filter(anonymous).join(kept.filter("wordless").select("key"), "key")
    return rows.select(*COLUMNS).unionByName(nameless.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: each document as many times as the mix takes it, one of a source in part."""
    reach_workers(spark)
    return _documents(mixed_documents(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; documents that the mix repeats are packed each time."""
    reach_workers(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER), size=2048, end_id=1, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The scorer is trained, the mix draws and the packer tokenizes: none of these is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next, then deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, park(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
