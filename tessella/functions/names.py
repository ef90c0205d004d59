"""Names, phonetic keys, nearest words and text statistics (N1, G9-G11, X6-X7, R9's check)."""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# For each letter in its context (the letter before, itself, the two after it; a blank stands for what is
# beyond the text), the first rule that matches gives the sounds that are written. "=" writes the letter itself.
SOUNDS = (
    (" [AEIOU]..", "="), ("MB .", ""), (".B..", "B"),
    (".CH.", "X"), (".C[IEY].", "S"), (".C..", "K"),
    (".DG[EIY]", "J"), (".D..", "T"),
    (".GH.", ""), (".GN ", ""), (".G[IEY].", "J"), (".G..", "K"),
    ("[ AEIOU]H..", "H"), ("CK..", ""), (".K..", "K"),
    (".PH.", "F"), (".P..", "P"), (".Q..", "K"),
    (".SH.", "X"), (".SI[OA]", "X"), (".S..", "S"),
    (".TH.", "0"), (".TI[OA]", "X"), (".T..", "T"),
    (".V..", "F"), ("[ AEIOU][WY]..", "="), (".X..", "KS"), (".Z..", "S"), (".[FJLMNR]..", "="),
)


def is_valid_name(name: Column) -> Column:
    """Whether a name is dot-parted segments of [a-z][a-z0-9_]* without double, leading or trailing parts of . and _."""
    return name.rlike(r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*\z") & ~name.contains("__") & ~name.endswith("_")


#: Numbers of letters A to Z are 0 to 25; then any other byte, and what stands beyond a text.
_OTHER, _EDGE = 26, 27
#: Bytes of texts whose sounds a worker looks up at once.
SOUND_BYTES = 1 << 20


@functools.cache
def _sounds() -> tuple[np.ndarray, np.ndarray]:
    """The number of each byte, and the two bytes (0: none) that a letter makes by the numbers of the one before it, itself and the two behind it."""
    numbers = np.full(256, _OTHER, dtype=np.uint8)
    numbers[ord("A") : ord("Z") + 1] = range(26)
    table = np.zeros((28, 28, 28, 28, 2), dtype=np.uint8)
    for pattern, written in reversed(SOUNDS):
        around = [range(28) if t == "." else [_EDGE if c == " " else ord(c) - ord("A") for c in t.strip("[]")] for t in re.findall(r"\[[^\]]*\]|.", pattern)]
        for own in around[1]:
            text = chr(ord("A") + own) if written == "=" else written
            table[np.ix_(around[0], [own], around[2], around[3])] = list(text.ljust(2, "\0").encode())
    return numbers, table.reshape(-1, 2)


def _sounds_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the sounds of upper-case texts that stand one behind the other, and how many each has. No rule looks through a character that isn't a letter, so bytes do for characters."""
    numbers, table = _sounds()
    own = numbers[data]
    before, after, last = (np.full(len(own), _EDGE, dtype=np.uint8) for _ in range(3))
    before[1:], after[:-1], last[:-2] = own[:-1], own[1:], own[2:]
    sizes = np.diff(ends, prepend=0)
    full, two = ends[sizes > 0], ends[sizes > 1]
    before[(ends - sizes)[sizes > 0]] = after[full - 1] = last[full - 1] = _EDGE
    last[two - 2] = _EDGE
    at = ((before.astype(np.int32) * 28 + own) * 28 + after) * 28 + last
    written = table[at]
    counts = np.concatenate([[0], np.cumsum((written != 0).sum(axis=1))])
    return written[written != 0], counts[ends] - counts[ends - sizes]


@F.arrow_udf(T.StringType())
def _sound_texts(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    places = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    parts, begin = [], 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(places, places[begin] + SOUND_BYTES, side="right")) - 1)
        sounds, counts = _sounds_of(data[places[begin] : places[end]], places[begin + 1 : end + 1] - places[begin])
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        keys = pa.StringArray.from_buffers(end - begin, pa.py_buffer(offsets), pa.py_buffer(sounds))
        parts.append(pc.if_else(texts.slice(begin, end - begin).is_valid(), keys, pa.scalar(None, pa.string())))
        begin = end
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def phonetic_key(word: Column) -> Column:
    """The sounds of a text by SOUNDS (G10). It is upper-cased; characters without a rule are silent.

    A text is one unit: only its first letter has nothing before it and its last nothing behind it. A blank inside is a
    character as any other, so of "A A" only the first vowel is written. An Arrow pass: an expression would look at each
    letter's rules one by one.
    """
    return _sound_texts(F.upper(word))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(a, b)


def word_score(word: Column, entry: Column) -> Column:
    """Twice the distance of the phonetic keys and the distance of the spellings."""
    lower = F.lower(word)
    return edit_distance(phonetic_key(lower), phonetic_key(entry)) * 2 + edit_distance(lower, entry)


def nearest_word(words: DataFrame, column: str, dictionary: list[str]) -> DataFrame:
    """Adds nearest and score: the dictionary's entry of the least word_score, the first one where scores are equal.

    The dictionary is a parameter of the plan, so it should have thousands of entries at most; its phonetic keys are made
    once. Distinct words are scored once, then joined back, as columns repeat words. Null words have no nearest entry.
    """
    spark = words.sparkSession
    entries = spark.createDataFrame([(i, w) for i, w in enumerate(dictionary)], "ord int, entry string").withColumn("entry_key", phonetic_key(F.col("entry")))
    listed = entries.agg(F.collect_list(F.struct("ord", "entry", "entry_key")).alias("entries"))  # as long as the parameter
    distinct = words.select(F.col(column).alias("w")).filter("w IS NOT NULL").distinct().withColumn("low", F.lower("w")).withColumn("key", phonetic_key(F.col("low")))
    scores = F.transform("entries", lambda e: F.struct((F.levenshtein("key", e["entry_key"]) * 2 + F.levenshtein("low", e["entry"])).alias("score"), e["ord"].alias("ord"), e["entry"].alias("entry")))
    best = distinct.crossJoin(F.broadcast(listed)).select("w", F.array_min(scores).alias("best"))  # one row: the dictionary
    joined = words.join(best, words[column] == best["w"], "left")
    return joined.select(*[words[c] for c in words.columns], F.col("best.entry").alias("nearest"), F.col("best.score").alias("score"))


def is_ascii(text: Column) -> Column:
    """Whether a text is ASCII only (R9's check)."""
    return F.octet_length(text) == F.length(text)


def text_stats(text: Column) -> Column:
    """struct<chars, bytes, ascii_chars, wide_chars>."""
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.struct(
        F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), ascii_chars.alias("ascii_chars"), (F.length(text) - ascii_chars).alias("wide_chars")
    )


def compression_stats(text: Column, coded_bytes: Column) -> Column:
    """struct<chars, bytes, ascii_chars, wide_chars, coded_bytes, saved_bytes, saved_percent> of a text and its coded size.

    Null for a null text or size; an empty text saves 0 percent.
    """
    stats, size = text_stats(text), coded_bytes.cast("bigint")
    saved = stats["bytes"] - size
    percent = F.when(stats["bytes"] > 0, saved * 100 / stats["bytes"]).otherwise(0.0)
    own = [stats[n].alias(n) for n in ("chars", "bytes", "ascii_chars", "wide_chars")]
    return F.when(text.isNotNull() & size.isNotNull(), F.struct(*own, size.alias("coded_bytes"), saved.alias("saved_bytes"), percent.alias("saved_percent")))


#: Texts of a batch that a worker reads at once, and characters that it counts at once.
COUNTED_TEXTS, COUNTED_CHARS = 64, 1 << 20


def char_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """code (code point) and n for every character of a column.

    Each task counts its texts in arrays of code points and reports one row for each character it has seen, so what moves
    is bounded by the number of tasks and characters, not by the texts.
    """

    def count(batches):
        total = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            texts, held = [], 0
            for begin in range(0, batch.num_rows, COUNTED_TEXTS):
                for text in batch.column(0).slice(begin, COUNTED_TEXTS).to_pylist():
                    texts.append(text or "")
                    held += len(texts[-1])
                if held and (held >= COUNTED_CHARS or begin + COUNTED_TEXTS >= batch.num_rows):
                    seen = np.bincount(np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32))
                    total[: len(seen)] += seen
                    texts, held = [], 0
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(total[codes], pa.int64())], names=["code", "n"])

    return docs.select(column).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def code_lengths(counts: list[tuple[int, int]]) -> dict[int, int]:
    """Lengths of an optimal prefix code for (code point, count); equal weights are merged in order of their first code point."""
    heap = [(n, code, [code]) for code, n in counts]
    heapq.heapify(heap)
    lengths = {code: 0 for code, _ in counts}
    if len(heap) == 1:
        return {heap[0][1]: 1}
    while len(heap) > 1:
        n1, first1, codes1 = heapq.heappop(heap)
        n2, first2, codes2 = heapq.heappop(heap)
        for code in codes1 + codes2:
            lengths[code] += 1
        heapq.heappush(heap, (n1 + n2, min(first1, first2), codes1 + codes2))
    return lengths


def canonical_codes(lengths: dict[int, int]) -> dict[int, str]:
    """Canonical codes as bit strings: shorter codes first, then by code point."""
    out, code, before = {}, 0, 0
    for point, length in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= length - before
        out[point] = format(code, f"0{length}b")
        code, before = code + 1, length
    return out
