"""Byte-level BPE in Spark workers: chunk caches, token counts (operator 7).

A chunk is what lies between two cut points of a text. A cut point is a single space with a character that isn't white
space on both sides: the byte-level pre-tokenizer never forms a pre-token over it, so chunks can be encoded one by one and
their ids joined. Texts that have other spaces at a cut (runs of blanks, blanks at line ends) are encoded in one piece.
"""

from __future__ import annotations

import heapq
import os
import struct
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import texts_of

#: Chunks longer than this many characters are encoded without being kept.
LONGEST_KEPT = 64
#: Entries that a worker keeps before it starts again with an empty second tier.
WORKER_ENTRIES = 300_000
#: Rows of the broadcast table and chunks that each task reports while the table is made.
FREQUENT_ENTRIES = 16_384
REPORTED_BY_TASK = 4_096


class Uncuttable(Exception):
    """A text has white space at a cut that isn't one single space."""


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Encodes as the tokenizer file does, without added special tokens; special strings in a text become their id."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.cuttable = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        self.fast = self._ranked(spec) if self.cuttable else None

    def _ranked(self, spec: dict):
        """The same vocabulary by merge ranks, where ids follow the merges; it encodes small strings much faster."""
        import tiktoken

        vocab, letters = spec["model"]["vocab"], _byte_letters()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged) or any(vocab.get(x, 1 << 30) >= merged[0] for x in letters):
            return None
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in self.specials}
        return tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special strings. Letters beyond Latin go to the file's own library, whose Unicode tables count."""
        if self.fast is not None and text.isascii() or self.fast is not None and max(text) < "ɐ":
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class ChunkCache(dict):
    """Two tiers: itself, filled from the frequent table and never emptied, and the worker's own misses, of bounded number.

    Values are what `measure` makes of the ids of a space and the chunk.
    """

    def __init__(self, enc: Encoder, measure, frequent: dict | None = None, misses: dict | None = None):
        super().__init__(frequent or {})
        self.enc, self.measure, self.misses = enc, measure, {} if misses is None else misses

    def __missing__(self, chunk: str):
        found = self.misses.get(chunk)
        if found is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise Uncuttable
            found = self.measure(self.enc.plain(" " + chunk))
            if len(chunk) <= LONGEST_KEPT:
                if len(self.misses) >= WORKER_ENTRIES:
                    self.misses.clear()
                self.misses[chunk] = found
        return found

    def parts(self, text: str):
        """Measures of the parts of a whole text, in order."""
        for special, number in self.enc.specials.items():
            if special in text:
                for i, piece in enumerate(text.split(special)):
                    if i:
                        yield self.measure([number])
                    yield from self.parts(piece)
                return
        if not text:
            return
        chunks = text.split(" ")
        try:
            if not self.enc.cuttable or len(chunks) == 1 or (chunks[0] and chunks[0][-1].isspace()) or not chunks[-1] or chunks[-1][0].isspace():
                raise Uncuttable
            middle = list(map(self.__getitem__, chunks[1:-1]))
        except Uncuttable:
            yield self.measure(self.enc.plain(text))
            return
        if chunks[0]:
            yield self.measure(self.enc.plain(chunks[0]))
        yield from middle
        yield self.measure(self.enc.plain(" " + chunks[-1]))


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


#: The second tier of each worker, by what is measured and the tokenizer's path; it outlives a task.
_MISSES: dict[tuple[str, str], dict] = {}


def ids_cache(path: str) -> ChunkCache:
    """The worker's cache from chunks to bytes of ids."""
    return ChunkCache(encoder(path), as_bytes, None, _MISSES.setdefault(("ids", path), {}))


def frequent_chunks(docs: DataFrame, entries: int = FREQUENT_ENTRIES, by_task: int = REPORTED_BY_TASK) -> list[str]:
    """The most frequent chunks of all texts. Every task counts its own texts and reports `by_task` chunks at most.

    Only these reports are shuffled, so what moves doesn't depend on the number of words. While a task counts, it keeps
    200,000 chunks at most and drops the rare ones; the table only saves time, so a chunk missed here costs no exactness.
    """

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                seen.update(c for c in text.split(" ") if 0 < len(c) <= LONGEST_KEPT)
                if len(seen) > 200_000:
                    seen = Counter(dict(heapq.nlargest(50_000, seen.items(), key=lambda x: x[1])))
        top = heapq.nlargest(by_task, seen.items(), key=lambda x: (x[1], x[0]))
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["chunk", "n"])

    reports = docs.select("text").mapInArrow(count, "chunk string, n bigint")
    best = reports.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(entries)
    return [r["chunk"] for r in best.collect()]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, frequent: list[str] | None = None) -> DataFrame:
    """Bytes and tokens of every text, without any shuffle of the texts' words.

    docs needs doc_id (any type) and text; other columns are not read. Null texts count as empty: 0 bytes, 0 tokens.
    Texts of any length are counted whole, a chunk at a time. Rows that repeat are counted each. An empty table gives no rows. `frequent` may bring an earlier list of chunks; otherwise one pass over all texts
    makes it. Its lengths are broadcast, FREQUENT_ENTRIES chunks of LONGEST_KEPT characters at most.
    """
    spark = docs.sparkSession
    enc = encoder(path)
    chunks = frequent_chunks(docs) if frequent is None else frequent
    lengths = {c: len(enc.plain(" " + c)) for c in chunks[:FREQUENT_ENTRIES] if not (c[0].isspace() or c[-1].isspace())}
    shared = spark.sparkContext.broadcast(lengths)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        cache = ChunkCache(encoder(path), len, shared.value, _MISSES.setdefault(("lengths", path), {}))
        for batch in batches:
            sizes, counts = [], []
            for text in texts_of(batch.column(1)):
                sizes.append(len(text.encode()))
                counts.append(sum(cache.parts(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
