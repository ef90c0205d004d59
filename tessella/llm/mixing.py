"""Mixing sources to target weights by pivotal dependent rounding (operator 4)."""

from __future__ import annotations

import random
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, park, word_count

#: Documents and bytes of payload that a leaf of the reduction tree gets on average, and residuals that a node combines.
LEAF_ROWS = 512
LEAF_BYTES = 16 << 20
FAN_IN = 64
#: Sources are configuration: one row each may be brought to the driver, up to this number.
MAX_SOURCES = 1_000_000
#: Sources up to which their plan is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, cap: float) -> dict[str | None, float]:
    """Words to take from each source: `share` times all words by weight, none above `cap` times its own.

    Sources are ordered by code point, null last, and weighted by `weights` in turn. What a source can't hold is dealt to
    the others by weight, until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    limit = {name: cap * words for name, words in order}
    left, open_, out = share * sum(words for _, words in order), [name for name, _ in order], {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= limit[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = limit[s]
            left -= limit[s]
        open_ = [s for s in open_ if s not in out]
    return out


def pivot(sizes: list[int], shares: list[float], draw: random.Random) -> tuple[list[float], int | None]:
    """Rounds fractional copies to 0 or 1, one pair at a time; returns the shares and the place of the one left fractional.

    A pair moves words between its two documents until one share is 0 or 1; the sum of size times share stays, and each
    share keeps its value in expectation. The one that is still fractional meets the next document.
    """
    out, carry = list(shares), None
    for j, p in enumerate(shares):
        if not 0 < p < 1:
            continue
        if carry is None:
            carry = j
            continue
        a, b, p, q = sizes[carry], sizes[j], out[carry], out[j]
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        if draw.random() * (up + down) < down:
            p, q = (1.0, q - up / b) if a * (1 - p) <= b * q else (p + up / a, 0.0)
        else:
            p, q = (0.0, q + down / b) if a * p <= b * (1 - q) else (p - down / a, 1.0)
        p, q = (round(x) if abs(x - round(x)) < 1e-12 else x for x in (p, q))
        out[carry], out[j] = p, q
        carry = carry if 0 < p < 1 else j if 0 < q < 1 else None
    return out, carry


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, cut_last: bool = True, payload: Iterable[str] = ("doc_id",), carries_text: bool = False) -> DataFrame:
    """Chooses how many times each document goes into a mix that has `share` times all words, by source weights.

    Columns of the result: `payload` columns of docs, then source, size (words), source_size, target (of its source),
    copies and taken (words). Each document gets the whole copies that its source's ratio has and at most one more, so what
    is taken is at most `cap` times its size where cap is whole.

    The tree: documents of a source are dealt by hash to leaves, each leaf rounds its documents, longest first, to at
    most one fractional document; FAN_IN residuals meet in a node of the next level, up to one node for each source. Of its
    last residual as many words are taken as its share is, so a source's words differ from its target by less than one;
    without cut_last a draw rounds it, and they differ by its words at most. A hot source has more leaves, never a larger
    one. Draws depend on seed and node, and leaves are ordered by content, so reruns agree.

    docs needs doc_id, text and source. Null texts have size 0; documents of size 0 get the whole copies of their source.
    A null source is a source of its own, after all others. Rows that repeat are chosen each on their own; equal sizes are
    ordered by a hash of content. Texts of any length are counted whole. A payload may not be named as a column of the
    result. An empty table gives no rows. carries_text: the payload holds the texts, so leaves are bounded by their bytes too.
    """
    payload = list(payload)
    if clash := {"source", "size", "source_size", "target", "copies", "taken"} & {p.lower() for p in payload}:
        raise ValueError(f"payload named as a column of the result: {sorted(clash)}")
    carried = F.struct(*payload)
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)) if carries_text else F.lit(16)
    own = [carried.alias("payload"), "source", word_count(F.col("text")).alias("size"), bytes_.alias("bytes")]
    sized = docs.select(*own, F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed)).alias("mark"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = source_targets([(t["source"], t["words"]) for t in totals], weights, share, cap)
    plan = []
    for t in totals:
        ratio = min(cap, targets[t["source"]] / t["words"]) if t["words"] else 0.0
        whole = int(ratio)
        leaves = max(1, -(-t["rows"] // LEAF_ROWS), -(-t["bytes"] // LEAF_BYTES))
        plan.append((t["source"], t["words"], float(targets[t["source"]]), whole, ratio - whole, leaves))
    spark = docs.sparkSession
    plan_schema = "p_source string, source_size bigint, target double, whole int, fraction double, leaves bigint"
    planned = spark.createDataFrame(plan, plan_schema)
    planned = F.broadcast(planned) if len(plan) <= BROADCAST_SOURCES else planned
    items = sized.join(planned, sized["source"].eqNullSafe(planned["p_source"])).select(
        "payload", "source", "size", "mark", "source_size", "target", "whole",
        F.when(F.col("size") > 0, F.col("fraction")).otherwise(0.0).alias("part"),
        F.pmod("mark", "leaves").alias("node"), F.lit(False).alias("open"),
    )
    deepest, level = max([p[5] for p in plan], default=1), 0
    done = []
    while True:
        last = deepest == 1
        level_items = items if level == 0 else items.withColumn("node", F.floor(F.col("node") / FAN_IN))
        rounded = level_items.groupBy("source", "node").applyInArrow(_node(level, seed, last, cut_last), level_items.schema)
        if last:
            done.append(rounded)
            break
        rounded = park(rounded, f"mix-l{level}")
        done.append(rounded.filter(~F.col("open")))
        items, deepest, level = rounded.filter("open"), -(-deepest // FAN_IN), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(
        "payload.*", "source", "size", "source_size", "target",
        (F.col("whole") + F.floor("part").cast("int")).alias("copies"),
        (F.col("size") * F.col("whole") + F.round(F.col("size") * F.col("part"))).cast("bigint").alias("taken"),
    )


def _node(level: int, seed: int, last: bool, cut_last: bool):
    """The function of one node: rounds its rows and marks the residual, which the last level rounds too."""

    def run(table: pa.Table) -> pa.Table:
        sizes, marks = table["size"].to_pylist(), table["mark"].to_pylist()
        parts = table["part"].to_pylist()
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], marks[i]))
        draw = random.Random(f"{seed}/{level}/{table['source'][0]}/{table['node'][0]}")
        shares, carry = pivot([sizes[i] for i in order], [parts[i] for i in order], draw)
        is_open = [False] * len(sizes)
        if carry is not None:
            if last and not cut_last:
                shares[carry] = float(draw.random() < shares[carry])
            is_open[order[carry]] = not last
        for k, i in enumerate(order):
            parts[i] = float(shares[k])
        at = table.column_names.index
        table = table.set_column(at("part"), "part", pa.array(parts, pa.float64()))
        return table.set_column(at("open"), "open", pa.array(is_open, pa.bool_()))

    return run


def first_words(text: Column, words: Column) -> Column:
    """A text up to the end of its n-th word, with the white space before and between as it is."""
    parts = F.split(text, f"(?<={WORD[:-1]})(?=[{WORD[2:-2]}])", -1)  # cut behind each word
    return F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it was chosen, with the columns of docs.

    What mix takes beyond whole copies, which is part of one document of a source, is its first words.
    """
    chosen = mix(docs.select(F.struct("*").alias("whole_row"), "doc_id", "text", "source"), payload=("whole_row",), carries_text=True, **options)
    rest = (F.col("taken") - F.col("size") * F.col("copies")).alias("rest")
    parts = chosen.select("whole_row", "copies", rest)
    pieces = F.concat(F.array_repeat(F.lit(False), F.col("copies")), F.when(F.col("rest") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    each = parts.select("whole_row", "rest", F.explode(pieces).alias("cut"))
    start = first_words(F.col("whole_row.text"), F.col("rest"))
    return each.select(F.when(F.col("cut"), F.col("whole_row").withField("text", start)).otherwise(F.col("whole_row")).alias("r")).select("r.*")
