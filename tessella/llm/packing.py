"""Cost-balanced packing of tokenized documents into sequences (operator 3)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import texts_of
from tessella.llm.tokens import ids_cache

#: Sequences that are filled together. A window leaves less than one sequence of padding.
WINDOW_SEQUENCES = 1_024
#: Ids above this bit are the task's number, below it the sequence's number in the task.
TASK_SHIFT = 40


def attention_cost(n: int, quadratic: float) -> float:
    """Cost of one piece: linear in its tokens, and quadratic as attention stays inside a piece."""
    return n + quadratic * n * n


def balance(lengths: list[int], size: int, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Deals pieces to as few sequences as their tokens need; returns (piece, start in it, length) by sequence.

    Longest first, each piece goes to the cheapest of all sequences that still have room for it. Where none has room, the
    cheapest open sequence takes what fits and the rest goes on in the same way. Since the capacities add up to the tokens
    or more, nothing is left over.
    """
    total = sum(lengths)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(-(-total // size))]
    room = np.full(len(out), size)
    cost = np.zeros(len(out))  # infinite where a sequence is full
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[i]
        while left:
            k = int(cost.argmin())
            if room[k] < left:
                fitting = np.flatnonzero(room >= left)
                if len(fitting):
                    k = int(fitting[cost[fitting].argmin()])
            n = min(left, int(room[k]))
            out[k].append((i, start, n))
            start, left, room[k] = start + n, left - n, room[k] - n
            cost[k] = cost[k] + attention_cost(n, quadratic) if room[k] else np.inf
    return out


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, quadratic: float = 1 / 2048, keep_ids: bool = True) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens; one row for each piece.

    A document's ids are those of its text and end_id. Whole runs of `size` ids make sequences of their own; the rest is
    balanced by cost within windows of WINDOW_SEQUENCES sequences. Windows stay inside a task, so there is no shuffle, no
    hot key and at most one sequence's padding for each window; memory is a window's ids and the ids of one text. Sequences
    are numbered by task and place, so a task that runs again gives the same rows where its input has the same order, as a
    table that is scanned has. Behind a shuffle, which promises no order, park docs first.

    docs needs doc_id and text; other columns are not read. Null or empty texts are one piece, end_id alone. Texts of any
    length are cut into whole sequences as they come. Rows that repeat are packed each on their own, equal lengths in the
    order they come. An empty table gives no rows. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    keep_ids the ids as array<int>.
    """
    fields = [docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    names = [f.name for f in fields] + ["ids"] * keep_ids
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if keep_ids else []))

    def run(batches):
        cache = ids_cache(path)
        base, made = TaskContext.get().partitionId() << TASK_SHIFT, 0
        window: list[tuple[object, bytes, int, int]] = []  # doc_id, ids of the loose end, its start, doc_tokens
        held = 0
        kind = None

        def emit(rows):
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:7]]
            if keep_ids:
                arrays.append(pa.array([memoryview(b).cast("I").tolist() for b in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def close():
            nonlocal made
            rows = []
            for places in balance([len(w[1]) // 4 for w in window], size, quadratic):
                offset = 0
                for i, start, n in places:
                    doc, ids, first, tokens = window[i]
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, first + start, n, zlib.crc32(own), tokens, base + made, offset, own))
                    offset += n
                made += 1
            return rows

        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = b"".join(cache.parts(text)) + end_id.to_bytes(4, "little")
                tokens = len(ids) // 4
                whole = tokens // size * size
                rows = []
                for start in range(0, whole, size):
                    own = ids[4 * start : 4 * (start + size)]
                    rows.append((doc, start, size, zlib.crc32(own), tokens, base + made, 0, own))
                    made += 1
                if rows:
                    yield emit(rows)
                if tokens > whole:
                    window.append((doc, ids[4 * whole :], whole, tokens))
                    held += tokens - whole
                if held >= WINDOW_SEQUENCES * size:
                    yield emit(close())
                    window, held = [], 0
        if window:
            yield emit(close())

    return docs.select("doc_id", "text").mapInArrow(run, schema)
