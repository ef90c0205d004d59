"""Exact top-k by inner product over a pivot-distance index (operator 6).

A vector x gets one more component sqrt(m - |x|^2), where m is the largest squared norm, and a query q gets 0. All indexed
vectors then lie on one sphere and |q - x|^2 = |q|^2 + m - 2 q.x, so the largest inner products are the nearest vectors,
and the triangle inequality holds for them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import forget, park

#: Vectors from which pivots are chosen, and their bytes, at most; pivots at least, where there are as many vectors.
SAMPLE_VECTORS = 8_192
SAMPLE_BYTES = 64 << 20
LEAST_PIVOTS = 16
#: Vectors of one annulus, at most, queries that meet an annulus in one group, about, and rows that are multiplied at once.
BLOCK = 2_048
QUERY_BLOCK = 4_096
TILE = 512
#: Annuli that a query expands in its first round, and the factor by which later rounds have more.
WIDTH = 4
GROWTH = 4
#: Part by which distances are widened against rounding.
SLACK = 1e-9


def quantize(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, or null where the vector or a component is null or not finite."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & fine, F.transform(wide, lambda x: F.floor(x * scale)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of dim integers; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if len(lengths) and lengths.min() == dim == lengths.max():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), dtype=np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows: exact in doubles where all sums stay below 2**53, else Python's integers."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors on the common sphere of squared radius top."""
    wide = x.astype(np.float64)
    return np.column_stack([wide, np.sqrt(np.maximum(top - (wide**2).sum(axis=1), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first pivots among the sample: each next one is the vector farthest from those before."""
    chosen = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(pivots, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _sortable(scores: np.ndarray) -> list[bytes]:
    """Whole numbers of any size as bytes that sort like them."""
    return [(int(s) + (1 << 191)).to_bytes(24, "big") for s in scores]


class PivotIndex:
    """All vectors, keyed by nearest pivot and distance to it, in annuli of at most BLOCK vectors.

    Rows are ordered by (pivot, distance, vec_id) in range partitions, so many copies of one vector are spread like other
    rows. Annuli are cut inside a partition and never span pivots. Pivots come from a bounded sample, chosen by a hash of
    the id, and grow with the square root of the number of vectors up to the sample's size; every vector is indexed. The
    index is written to the shared folder. What is shipped to workers is the pivots with the nearest and farthest vector
    of each, which the sample bounds.
    """

    def __init__(self, vectors: DataFrame, pivots: int | None = None, sample: int = SAMPLE_VECTORS, sample_bytes: int = SAMPLE_BYTES):
        """vectors: vec_id and v, an array of whole numbers that is nowhere null."""
        size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("top"), F.max(F.size("v")).alias("dim")).first()
        self.n, self.top, self.dim = facts["n"], float(facts["top"] or 0.0), int(facts["dim"] or 0)
        #: Inner products are at most `top`; beyond 62 bits they are ranked as bytes and no bound is taken from them.
        self.wide = self.top >= 2.0**62
        some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(sample, sample_bytes // (8 * max(1, self.dim))))).select("v").collect()
        points = _matrix(pa.array([r["v"] for r in some], pa.list_(pa.int64())), self.dim) if some else np.zeros((1, self.dim), dtype=np.int64)
        self.pivots = choose_pivots(_lifted(points, self.top), pivots or max(LEAST_PIVOTS, math.isqrt(self.n)))
        index, top, dim, points = self.pivots, self.top, self.dim, None

        def key(batches):
            for batch in batches:
                for part in (batch.slice(i, TILE) for i in range(0, batch.num_rows, TILE)):
                    away = _distances(_lifted(_matrix(part.column(1), dim), top), index)
                    near = away.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(away[np.arange(len(near)), near]), *part.columns], names=["pivot", "away", "vec_id", "v"])

        def cut(batches):
            block, rows, pivot = TaskContext.get().partitionId() << 32, 0, None
            for batch in batches:
                blocks = []
                for p in batch.column(0).to_pylist():
                    if p != pivot or rows == BLOCK:
                        block, rows, pivot = block + 1, 0, p
                    blocks.append(block)
                    rows += 1
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *batch.columns], names=["block", "pivot", "away", "vec_id", "v"])

        id_type = vectors.schema["vec_id"].dataType.simpleString()
        keyed = vectors.select("vec_id", "v").mapInArrow(key, f"pivot int, away double, vec_id {id_type}, v array<bigint>")
        dealt = keyed.repartitionByRange(max(1, -(-self.n // (8 * BLOCK))), "pivot", "away", "vec_id").sortWithinPartitions("pivot", "away", "vec_id")
        self.rows = park(dealt.mapInArrow(cut, f"block bigint, pivot int, away double, vec_id {id_type}, v array<bigint>"), "annuli")
        bounds = [F.min("away").alias("low"), F.max("away").alias("high")]
        self.annuli = park(self.rows.groupBy("block").agg(F.first("pivot").alias("pivot"), *bounds), "annulus-bounds")
        #: One row for each pivot that has vectors: its number, nearest and farthest vector.
        self.shells = np.array([tuple(r) for r in self.annuli.groupBy("pivot").agg(F.min("low"), F.max("high")).orderBy("pivot").collect()], dtype=np.float64).reshape(-1, 3)

    def top_k(self, queries: DataFrame, k: int, report: dict | None = None) -> DataFrame:
        """query_id, rank, vec_id, score of the k largest inner products of each query with vectors of other ids.

        queries: query_id and q. Each query meets the annulus that may hold the nearest vector; its k-th best distance
        then opens all annuli that the triangle inequality can't exclude. These are expanded in rising order of their
        least possible distance, WIDTH at first and GROWTH times as many in each round; after each round the k-th best
        distance is tighter, and a query stops where the next annulus is beyond it. Index rows are read for the pairs of
        annulus and block of queries that are in use. report: is given the numbers of queries, annuli, pairs and scanned pairs.
        """
        chunks = max(1, -(-queries.count() // QUERY_BLOCK))
        query_id, dim = queries.schema["query_id"].dataType.simpleString(), self.dim

        def norms(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((_matrix(batch.column(1), dim).astype(np.float64) ** 2).sum(axis=1), pa.float64())], names=["query_id", "q", "norm"])

        spots = queries.select("query_id", "q").dropDuplicates(["query_id", "q"]).mapInArrow(norms, f"query_id {query_id}, q array<bigint>, norm double")
        spots = spots.withColumn("query", F.struct("query_id", F.xxhash64("q").alias("mark"))).withColumn("chunk", F.pmod(F.xxhash64("query_id", "q"), F.lit(chunks)))
        spots = park(spots.select("query", "q", "norm", "chunk"), "queries")
        home = self._open(spots.select("query", "q", F.lit(None).cast("double").alias("reach")), nearest=True)
        home = park(home.groupBy("query").agg(F.min_by("block", F.struct("bound", "block")).alias("block")), "home")
        best = park(self._ranked(self._scan(home, spots, k), k), "best")
        reach = self._reach(spots, best, k)
        opened = self._open(spots.join(reach, "query").select("query", "q", "reach")).join(home.withColumnRenamed("block", "seen"), "query").filter("block <> seen")
        turn = F.row_number().over(Window.partitionBy("query").orderBy("bound", "block")).alias("turn")
        rest = park(opened.select("query", "block", "bound", turn), "expansion")
        done, width, scanned = 0, WIDTH, 0
        while True:
            live = rest.filter(F.col("turn") > done).join(self._reach(spots, best, k), "query").filter("reach IS NULL OR bound <= reach")
            if live.agg(F.max("turn")).first()[0] is None:
                break
            now = park(live.filter(F.col("turn") <= done + width).select("query", "block"), "round")
            scanned += now.count() if report is not None else 0
            old, best = best, park(self._ranked(best.select("query", "vec_id", "score").unionByName(self._scan(now, spots, k)), k), "best")
            forget(old, now)
            done, width = done + width, width * GROWTH
        if report is not None:
            counts = spots.count(), self.annuli.count()
            report |= {"queries": counts[0], "annuli": counts[1], "pairs": counts[0] * counts[1], "scanned": scanned + counts[0] * (counts[1] > 0)}
        forget(rest, home)
        return self._plain(best.select(F.col("query.query_id").alias("query_id"), "rank", "vec_id", "score"))

    def _plain(self, found: DataFrame) -> DataFrame:
        """Scores as BIGINT; where inner products need more bits, those beyond are shown as the nearest BIGINT."""
        if not self.wide:
            return found

        def narrow(batches):
            for batch in batches:
                scores = [max(-(2**63), min(2**63 - 1, int.from_bytes(s, "big") - (1 << 191))) for s in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.int64())], names=batch.schema.names)

        fields = found.schema.fields[:3]
        return found.mapInArrow(narrow, T.StructType([*fields, T.StructField("score", T.LongType())]))

    def _reach(self, spots: DataFrame, best: DataFrame, k: int) -> DataFrame:
        """query and reach: the distance of its k-th best vector, widened against rounding; null where fewer are found."""
        if self.wide:
            return spots.select("query", F.lit(None).cast("double").alias("reach"))
        last = best.filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
        far = F.when(F.col("least").isNotNull(), F.sqrt(F.greatest(F.col("norm") + self.top - 2 * F.col("least"), F.lit(0.0))))
        return spots.select("query", "norm").join(last, "query", "left").select("query", (far * (1 + SLACK) + 1e-3).alias("reach"))

    def _open(self, spots: DataFrame, nearest: bool = False) -> DataFrame:
        """query, block and bound, the least distance that the triangle inequality allows, of all annuli within reach.

        spots: query, q and reach. Pivots are judged first, against their nearest and farthest vector, then their annuli.
        nearest: only those of the pivot that may hold the nearest vector.
        """
        index, shells, dim = self.pivots, self.shells, self.dim
        kind = spots.schema["query"].dataType.simpleString()

        def judge(batches):
            numbers = shells[:, 0].astype(np.int64)
            for batch in batches:
                for part in (batch.slice(i, TILE) for i in range(0, batch.num_rows, TILE)):
                    q = _matrix(part.column(1), dim).astype(np.float64)
                    here = _distances(np.column_stack([q, np.zeros(len(q))]), index)[:, numbers]
                    bound = np.maximum(np.maximum(shells[:, 1] - here, here - shells[:, 2]), 0)
                    reach = np.array([np.inf if r is None else r for r in part.column(2).to_pylist()])
                    if nearest:
                        first = np.lexsort((here, bound), axis=1)[:, :1] if len(numbers) else np.zeros((len(q), 0), dtype=np.int64)
                        own = [f.tolist() for f in first]
                    else:
                        own = [np.flatnonzero(b <= r).tolist() for b, r in zip(bound, reach)]
                    spot = [[{"pivot": int(numbers[j]), "here": float(h[j])} for j in js] for js, h in zip(own, here)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(spot, pa.list_(pa.struct([("pivot", pa.int32()), ("here", pa.float64())])))], names=["query", "reach", "spots"])

        near = spots.select("query", "q", "reach").mapInArrow(judge, f"query {kind}, reach double, spots array<struct<pivot:int,here:double>>").select("query", "reach", F.inline("spots"))
        bound = F.greatest(F.col("low") - F.col("here"), F.col("here") - F.col("high"), F.lit(0.0))
        return near.join(self.annuli, "pivot").withColumn("bound", bound).filter("reach IS NULL OR bound <= reach").select("query", "block", "bound")

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _scan(self, pairs: DataFrame, spots: DataFrame, k: int) -> DataFrame:
        """The k best of each annulus for each query that meets it (pairs: query, block); a group is an annulus and a block of queries."""
        dim, wide = self.dim, self.wide
        met = pairs.join(spots.select("query", "q", "chunk"), "query")
        query, vec = met.schema["query"].dataType, self.rows.schema["vec_id"].dataType

        def scan(_, left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["query", "vec_id", "score"]
            own = left["query"].combine_chunks()
            kinds = [own.type, right["vec_id"].type, pa.binary() if wide else pa.int64()]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], t) for t in kinds], names=names)
            ids = right["vec_id"].to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
            vectors = _matrix(right["v"].take(pa.array(order)) if order != list(range(len(ids))) else right["v"], dim)
            ids, owners, q = [ids[i] for i in order], own.field("query_id").to_pylist(), _matrix(left["q"], dim)
            at, who, what = [], [], []
            for begin in range(0, len(owners), TILE):
                scores = _products(q[begin : begin + TILE], vectors)
                for i, row in enumerate(scores, begin):
                    least = np.partition(row, max(0, len(row) - k - 1))[max(0, len(row) - k - 1)] if len(row) > k + 1 else None
                    some = np.arange(len(row)) if least is None else np.flatnonzero(row >= least)
                    best = [j for j in some[np.argsort(-row[some], kind="stable")].tolist() if owners[i] is None or ids[j] != owners[i]][:k]
                    if least is not None and len(best) < k:  # copies of the query's id among the best
                        best = [j for j in np.argsort(-row, kind="stable").tolist() if owners[i] is None or ids[j] != owners[i]][:k]
                    at += [i] * len(best)
                    who += [ids[j] for j in best]
                    what += _sortable(row[best]) if wide else row[best].tolist()
            return pa.table([own.take(pa.array(at, pa.int64())), pa.array(who, kinds[1]), pa.array(what, kinds[2])], names=names)

        schema = T.StructType([T.StructField("query", query), T.StructField("vec_id", vec), T.StructField("score", T.BinaryType() if wide else T.LongType())])
        used = met.select(F.col("block").alias("in_block"), F.col("chunk").alias("in_chunk")).distinct()
        rows = self.rows.select("block", "vec_id", "v").join(used, F.col("block") == F.col("in_block")).select("block", F.col("in_chunk").alias("chunk"), "vec_id", "v")
        return met.select("query", "q", "chunk", "block").groupBy("block", "chunk").cogroup(rows.groupBy("block", "chunk")).applyInArrow(scan, schema)


def search(vectors: DataFrame, is_query: Column, scale: int = 1024, k: int = 10, report: dict | None = None) -> DataFrame:
    """The k rows of largest integer inner product for each query row, ties to the smaller id.

    vectors needs vec_id and embedding. Vectors that are null or hold null or non-finite components take no part; an empty
    vector scores 0 with all, a shorter one as if zeros followed. Rows with the query's own id are no candidates. Rows that
    repeat are candidates each, and one query. Components beyond 64 bits count as the largest of 64; inner products are
    ranked exactly at any size, and shown as the nearest BIGINT where they are beyond it. An empty table gives no rows.
    """
    fine = park(vectors.select("vec_id", quantize(F.col("embedding"), scale).alias("v")).filter("v IS NOT NULL"), "vectors")
    return PivotIndex(fine).top_k(fine.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), k, report)
