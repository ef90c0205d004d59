"""Bounded samples of labelled documents, for the trained scorers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


#: Bytes of text that a sample brings to the driver, at most.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int, limit_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int, float]]:
    """(text, label, weight) of at most `limit` labelled ids outside the held-out fold: half of each label where there are enough.

    Documents are chosen by a hash of the id, as long as their texts take limit_bytes together; one that doesn't fit is left
    out, so is the second and further row of an id. Weights restore the labels' shares among all labelled rows outside the
    fold. Rows with a null id or label are left out; of an id that is labelled twice the larger label counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(fold_of(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    half = limit // 2
    take = {y: min(count.get(y, 0), max(half, limit - min(half, count.get(1 - y, 0)))) for y in (0, 1)}
    chosen = None
    for y in (0, 1):
        own = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take[y])
        chosen = own if chosen is None else chosen.unionByName(own)
    # `limit` rows at most are broadcast
    sized = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(F.broadcast(chosen), "doc_id")
    one = sized.groupBy("doc_id", "y").agg(F.min(F.struct("mark", "bytes")).alias("of")).select("doc_id", "y", "of.mark", "of.bytes").orderBy(F.xxhash64("doc_id"), "doc_id")
    left, wanted = limit_bytes, []
    for r in one.collect():
        if r["bytes"] <= left:
            left -= r["bytes"]
            wanted.append((r["doc_id"], r["mark"], r["y"]))
    if not wanted:
        return []
    listed = docs.sparkSession.createDataFrame(wanted, T.StructType([docs.schema["doc_id"], T.StructField("mark", T.LongType()), T.StructField("y", T.IntegerType())]))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(F.broadcast(listed), ["doc_id", "mark"]).dropDuplicates(["doc_id"])
    rows = sorted(texts.select("doc_id", "text", "y").collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    got = {y: sum(r["y"] == y for r in rows) for y in (0, 1)}
    return [(r["text"] or "", r["y"], count[r["y"]] / got[r["y"]] * len(rows) / sum(count.values())) for r in rows]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last weight is the intercept."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    each = np.ones(len(y)) if weight is None else weight
    penalty = np.diag([ridge] * (a.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (each * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (each * (p - y)) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
