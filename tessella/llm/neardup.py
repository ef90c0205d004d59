"""Near-duplicate documents by min-max hashing (operator 5)."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import forget, park, texts_of
from tessella.llm.graph import components
from tessella.llm.words import mix64, shingle_sets, text_blocks

#: Permutations; each gives a minimum and a maximum, so a signature has twice as many values.
PERMUTATIONS = 64
#: Values in a band, from two permutations. A pair at similarity 0.75 shares none of the 32 bands with probability 5e-6 where sets are
#: large; in small ones minimum and maximum hang together: simulated, 9 of 120,000 pairs of 3 of 4 shingles share none, 1 of 60,000 of 6 of 8.
BAND = 4
BANDS = 2 * PERMUTATIONS // BAND
#: Sets of at most so many shingles are also keyed by all parts that a linked set may have in common with them, so such pairs are never missed.
SMALL_SET = 10
#: Pairs whose signatures agree in less than this share aren't compared in full: 5 standard deviations below 0.75. Small sets always are.
LEAST_AGREEMENT = 0.56
LEAST_VALUES = math.ceil(LEAST_AGREEMENT * 2 * PERMUTATIONS)
#: Size up to which one task compares all pairs of a group; larger groups are compared with their leader first. A member of a bucket
#: counts 1, one of a cluster 1 for each SET_UNIT shingles begun, so a group of long documents is large too.
BUCKET_BLOCK = 256
CLUSTER_BLOCK = 256
SET_UNIT = 4_096

_MULTIPLIERS = (mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SECOND = np.uint32(0x85EBCA6B)


def min_max(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a set's hashes under each permutation."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    high = np.zeros(PERMUTATIONS, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        v = np.multiply.outer(_MULTIPLIERS, x[i : i + 4096])
        v ^= v >> np.uint32(15)
        v *= _SECOND
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return low, high


def signature(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte of each value, and the keys of the bands: minimum and maximum of two permutations each."""
    values = np.column_stack([low, high]).reshape(-1)
    small = ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    pairs = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    bands = mix64(pairs[0::2] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, BANDS + 1, dtype=np.uint64))
    return small, mix64(bands ^ pairs[1::2]).view(np.int64)


class _Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> pa.RecordBatch:
        pairs = [(x, r) for x in self.up if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _whole_groups(batches, keys: int):
    """Batches that end where a group ends; groups are rows with equal values in the first `keys` columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(held.num_rows - 1, dtype=bool)
        for k in range(keys):
            own = np.asarray(held.column(k))
            change |= own[1:] != own[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield held.slice(0, int(cuts[-1]) + 1)
            held = held.slice(int(cuts[-1]) + 1)
    if held is not None and held.num_rows:
        yield held


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where groups begin in a batch, and its end."""
    change = np.ones(batch.num_rows + 1, dtype=bool)
    change[1:-1] = False
    for k in range(keys):
        own = np.asarray(batch.column(k))
        change[1:-1] |= own[1:] != own[:-1]
    return np.flatnonzero(change)


def _bytes_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def common_parts(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of all parts of a small set that leave out no more than a linked set may lack."""
    each = mix64(hashes ^ np.uint64(0x2545F4914F6CDD1D))
    n, total = len(each), each.sum(dtype=np.uint64)
    gone = range(n - -(-percent * n // 100) + 1)
    return mix64(np.concatenate([total - each[_combinations(n, k)].sum(axis=1, dtype=np.uint64) + np.uint64(n - k) for k in gone])).view(np.int64)


@functools.cache
def _combinations(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), dtype=np.int64).reshape(math.comb(n, k), k)


def sketches(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, text_hash, n_shingles, c1 and c2 (hashes of the set), sig and keys of every document; one pass, no shuffle."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for block in text_blocks(texts_of(batch.column(2))):
                for s in shingle_sets(block):
                    if len(s):
                        small, keys = signature(*min_max(s))
                        if len(s) <= SMALL_SET:
                            keys = np.concatenate([keys, common_parts(s, percent)])
                        c1, c2 = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                        rows.append((len(s), int(c1.astype(np.int64)), int(c2.astype(np.int64)), small.tobytes(), keys))
                    else:
                        rows.append((0, 0, 0, None, None))
            n, c1, c2, sig, keys = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, c1, c2)), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "c1", "c2", "sig", "keys"],
            )

    return base.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, c1 bigint, c2 bigint, sig binary, keys array<bigint>")


def _forest_row(key: int, forest: _Forest) -> pa.RecordBatch:
    edges = forest.edges()
    return pa.RecordBatch.from_arrays([pa.array([key] * edges.num_rows, pa.int64()), *edges.columns], names=["key", "a", "b"])


_EDGES = "key bigint, a bigint, b bigint"


def _likely_edges(members: DataFrame) -> DataFrame:
    """Links of a forest over the pairs of a small bucket whose signatures agree well; members: key, node, small, sig."""

    def run(batches):
        for batch in _whole_groups(batches, 1):
            starts = _starts(batch, 1)
            end = starts[1:][np.repeat(np.arange(len(starts) - 1), np.diff(starts))]
            node, small = np.asarray(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            sig = _bytes_matrix(batch.column(3), 2 * PERMUTATIONS)
            forest = _Forest()
            left = np.arange(len(node))
            for step in range(1, int(np.diff(starts).max())):
                left = left[left + step < end[left]]
                for k in range(0, len(left), 1 << 16):
                    x = left[k : k + (1 << 16)]
                    y = x + step
                    near = (np.count_nonzero(sig[x] == sig[y], axis=1) >= LEAST_VALUES) | small[x] & small[y]
                    for p, q in zip(node[x[near]].tolist(), node[y[near]].tolist()):
                        forest.join(p, q)
            yield _forest_row(0, forest)

    dealt = members.select("key", "node", "small", "sig").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, _EDGES)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least percent times the union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int(np.count_nonzero(a[at] == b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _compared(percent: int | None):
    """The function of a task that compares groups of rows (key, i, j, side, node, small, sig, shingles) and yields a forest of links.

    Rows of side 1 are compared with those of side 0, rows of side 2 with one another. Pairs whose signatures agree well are
    links themselves, or with percent are compared on full sets unless they already hang together.
    """

    def run(batches):
        for batch in _whole_groups(batches, 3):
            keys, side, node = (np.asarray(batch.column(k)) for k in (0, 3, 4))
            small, sig = batch.column(5).to_numpy(zero_copy_only=False), _bytes_matrix(batch.column(6), 2 * PERMUTATIONS)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in batch.column(7).to_pylist()] if percent else []
            starts = _starts(batch, 3).tolist()
            for begin, end in zip(starts[:-1], starts[1:]):
                forest, own = _Forest(), side[begin:end]
                for x in (np.flatnonzero(own > 0) + begin).tolist():
                    others = np.arange(x + 1, end) if side[x] == 2 else np.flatnonzero(own == 0) + begin
                    agree = np.count_nonzero(sig[others] == sig[x], axis=1)
                    some = np.flatnonzero(((agree >= LEAST_VALUES) | small[others] & small[x]) & (node[others] != node[x]))
                    for y in others[some[np.argsort(-agree[some], kind="stable")]].tolist():
                        p, q = int(node[x]), int(node[y])
                        if forest.root(p) != forest.root(q) and (not percent or _linked(sets[x], sets[y], percent)):
                            forest.join(p, q)
                yield _forest_row(int(keys[begin]), forest)

    return run


def _grouped(dealt: DataFrame, percent: int | None) -> DataFrame:
    rows = dealt.select("key", "i", "j", "side", "node", "small", "sig", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_compared(percent), _EDGES)


def _crossed(ids: DataFrame, some: DataFrame, block: int) -> DataFrame:
    """Deals all members of a group and some of them (key, node) to tasks (i, j) so that each of these meets each member once.

    Members come to as many tasks as the others fill, which for a leader is one.
    """
    counts = some.join(ids.select("key", "node", "weight"), ["key", "node"]).groupBy("key").agg(F.sum("weight").alias("some_size"))
    place, rows, columns = F.xxhash64("node"), F.ceil(F.col("some_size") / block), F.ceil(F.col("size") / block)
    told = ids.join(park(counts, "crossed"), "key")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    all_ = told.withColumn("i", spread(rows)).withColumn("j", F.pmod(place, columns)).withColumn("side", F.lit(0))
    chosen = told.join(some, ["key", "node"], "left_semi").withColumn("i", F.pmod(place, rows)).withColumn("j", spread(columns)).withColumn("side", F.lit(1))
    return all_.unionByName(chosen).select("key", "i", "j", "side", "node")


def _large_edges(ids: DataFrame, load, block: int, percent: int | None) -> DataFrame:
    """Links of the members of large groups; ids: key, node, leader, size, weight; load adds what is compared to dealt rows.

    Every member is compared with its group's leader: one pass, in which a member is sent once. Those that aren't linked to
    it, the loose ones, are then compared with all members, so no link is lost; where all are copies of the leader there are none.
    """
    led = park(_grouped(load(_crossed(ids, ids.filter("node = leader").select("key", "node"), block)), percent), "led")
    loose = ids.filter("node <> leader").join(led.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti").select("key", "node")
    loose = park(loose, "loose")
    return led if loose.isEmpty() else led.unionByName(_grouped(load(_crossed(ids, loose, block)), percent))


def _links(ids: DataFrame, load, block: int, percent: int | None, small_groups) -> DataFrame:
    """Links of all groups: small ones by small_groups, large ones by way of their leader. A forest for what a task compares."""
    zero = F.lit(0).cast("bigint")
    few, many = ids.filter(F.col("size") <= block), ids.filter(F.col("size") > block)
    edges = small_groups(load(few.select("key", zero.alias("i"), zero.alias("j"), F.lit(2).alias("side"), "node")))
    return (edges if many.isEmpty() else edges.unionByName(_large_edges(many, load, block, percent))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked where 100 times the intersection of their sets of 5-word shingles is at least `percent` times the
    union. Steps: documents with equal sets (128 bits of them) become one node; nodes that share a band of min-max values
    and agree in enough of their signatures, and small sets that share a part a link needs, make clusters; within clusters
    full sets are compared unless they already hang together; components of the links give component_id, the smallest
    doc_id reachable.

    Small groups are compared in one task. In large ones, buckets and clusters alike, every member is compared with the
    group's leader, and only those unlike it with the others, by blocks; no step emits more than a forest of links for what
    it compares. Documents without words are linked with nothing. Rows without a doc_id take no part: their component_id is
    null and they are kept. Rows that repeat get equal results. Of rows with one doc_id and different texts each has its own
    links; kept then only says that doc_id is the component's. Texts of any length are read whole; long ones make their
    cluster large. Columns but doc_id and text are not read. An empty table gives no rows.
    """
    all_docs = park(sketches(docs, percent), "sketches")
    known = all_docs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = known.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", F.col("of.doc_id").alias("doc_id"), F.col("of.text_hash").alias("text_hash"), "n", (F.col("n") <= SMALL_SET).alias("small"), "sig", "keys")
    nodes = park(nodes, "nodes")  # numbers are as they are written

    listed = nodes.select("node", F.explode("keys").alias("key"))
    shared = park(listed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).filter("size > 1"), "buckets")  # counted map-side
    placed = park(listed.join(shared, "key").withColumn("weight", F.lit(1).cast("bigint")), "bucket-members")
    signed = lambda dealt: dealt.join(nodes.select("node", "small", "sig"), "node").withColumn("shingles", F.lit(None).cast("binary"))
    clusters = park(components(_links(placed, signed, BUCKET_BLOCK, None, _likely_edges)), "clusters")

    weighed = clusters.join(nodes.select("node", "n"), "node").withColumn("weight", F.ceil(F.col("n") / SET_UNIT)).drop("n")
    weighed = park(weighed, "cluster-members")
    sizes = park(weighed.groupBy("component").agg(F.sum("weight").alias("size")), "cluster-sizes")  # as a table, so that the join may split a hot cluster
    ids = park(weighed.join(sizes, "component").select(F.col("component").alias("key"), "node", F.col("component").alias("leader"), "size", "weight"), "cluster-ids")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").filter("doc_id IS NOT NULL")

    def sets(batches):
        for batch in batches:
            made = [s.tobytes() for block in text_blocks(texts_of(batch.column(batch.num_columns - 1))) for s in shingle_sets(block)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])

    # Only the sets of cluster members are written; all comparisons read these, so the texts are moved once.
    of = ids.select("node").join(nodes.select("node", "doc_id", "text_hash", "small", "sig"), "node").join(texts, ["doc_id", "text_hash"])  # a row that repeats only repeats a comparison
    held = park(of.select("node", "small", "sig", "text").mapInArrow(sets, "node bigint, small boolean, sig binary, shingles binary"), "cluster-sets")
    links = components(_links(ids, lambda dealt: dealt.join(held, "node"), CLUSTER_BLOCK, percent, lambda rows: _grouped(rows, percent)))
    found = nodes.select("node", "c1", "c2", "doc_id").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = park(found, "found")
    smallest = park(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    forget(nodes, shared, placed, clusters, weighed, sizes, ids, held, links)
    by_set = found.join(smallest, "component").select("c1", "c2", "component_id")
    takes_part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = all_docs.select("doc_id", "n_shingles", *[F.when(takes_part, F.col(c)).alias(c) for c in ("c1", "c2")])
    rows = rows.join(by_set, ["c1", "c2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
