"""Document quality by a linear-chain conditional random field over lines (operator 8)."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import texts_of
from tessella.llm.samples import fold_of, labelled_sample, logistic
from tessella.llm.words import word_hashes, word_spans

#: Labelled documents that the field is fitted on, at most.
SAMPLE_DOCS = 4_000
#: Bytes of text whose features are made at once in a worker, and bytes that a line counts besides; a larger text is taken alone.
BLOCK_BYTES = 4 << 20
LINE_BYTES = 256
#: Lines whose own features are held at once, and lines beyond which a document's chain is walked by itself.
CHUNK_LINES = 1 << 15
LONG_CHAIN = 4_096

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)),
    "digit": b"0123456789",
    "stop": b".,;:?\"'()-",
    "bang": b"!",
    "bar": b"|<>{}[]=/\\_~`^",
    "sign": b"#$%&*+@",
}
_KIND_TABLES = [np.isin(np.arange(256), np.frombuffer(chars, dtype=np.uint8)) for chars in _KINDS.values()]
#: Shares of the kinds, words that repeat the one before, words, letters in a word, an empty line.
OWN = len(_KINDS) + 4
#: A line's own features, those of the lines before and after, whether it is the first or last, and a constant.
FEATURES = 3 * OWN + 3


def _own_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A line's own features and its length in bytes, for all lines of all texts."""
    data = np.frombuffer("\n".join(texts).encode() + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(np.float64)
    own = np.empty((len(starts), OWN))
    for k, table in enumerate(_KIND_TABLES):
        own[:, k] = np.add.reduceat(table[data], starts, dtype=np.int32) / np.maximum(length, 1)  # every line has its end, so no segment is empty
    begins, stops = word_spans(data)
    hashes = word_hashes(data, begins, stops)
    of = np.searchsorted(starts, begins, side="right") - 1
    words = np.bincount(of, minlength=len(starts)).astype(np.float64)
    again = np.zeros(len(of))
    if len(of) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    k = len(_KINDS)
    own[:, k] = np.bincount(of, weights=again, minlength=len(starts)) / np.maximum(words, 1)
    own[:, k + 1] = np.log1p(words) / 5
    own[:, k + 2] = np.minimum(length / np.maximum(words, 1), 40) / 20
    own[:, k + 3] = words == 0
    return own, length


def _edges(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is the first and the last of its text."""
    first, last = np.zeros(lines.sum(), dtype=bool), np.zeros(lines.sum(), dtype=bool)
    ends = np.cumsum(lines)
    last[ends - 1] = True
    first[ends - lines] = True
    return first, last


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, the number of lines of each text, and each line's length in bytes."""
    lines = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    own, length = _own_features(texts)
    first, last = _edges(lines)
    x = np.zeros((len(own), FEATURES))  # filled in place, as it is the largest thing that the driver holds
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN], x[:-1, 2 * OWN : 3 * OWN] = own[:-1], own[1:]
    x[first, OWN : 2 * OWN], x[last, 2 * OWN : 3 * OWN] = 0, 0
    x[:, -3], x[:, -2], x[:, -1] = first, last, 1
    return x, lines, length


def line_scores(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features times weights, with the numbers of lines and their lengths, but only CHUNK_LINES lines' features held at once."""
    lines = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    parts, lengths, at = [], [], weights[: 3 * OWN].reshape(3, OWN).T
    held: list[str] = []
    count = 0

    def take() -> None:
        own, length = _own_features(held)
        parts.append(own @ at)
        lengths.append(length)

    for text, n in zip(texts, lines.tolist()):
        pieces = [text] if n <= CHUNK_LINES else ["\n".join(rows) for rows in itertools.batched(text.split("\n"), CHUNK_LINES)]
        for piece in pieces:
            size = min(n, CHUNK_LINES)
            if held and count + size > CHUNK_LINES:
                take()
                held, count = [], 0
            held.append(piece)
            count += size
    if held:
        take()
    part, length = np.concatenate(parts), np.concatenate(lengths)
    first, last = _edges(lines)
    before, after = np.zeros(len(part)), np.zeros(len(part))
    before[1:], after[:-1] = part[:-1, 1], part[1:, 2]
    before[first], after[last] = 0, 0
    return part[:, 0] + before + after + first * weights[-3] + last * weights[-2] + weights[-1], lines, length


def _lanes(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents from long to short, and the first line of each: step t then works on a shrinking prefix of lanes."""
    order = np.argsort(-lines, kind="stable")
    return order, (np.cumsum(lines) - lines)[order]


def _chain(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over the lines of one document in plain numbers, which is faster for a long one by itself."""
    top = scores.max(axis=1)
    emit = np.exp(scores - top[:, None]).tolist()
    (a, b), (c, d) = np.exp(moves).tolist()
    forward, scale = [], []
    f, g = 1.0, 1.0
    for k, (x, y) in enumerate(emit):
        f, g = (f * a + g * c) * x if k else x, (f * b + g * d) * y if k else y
        s = f + g
        f, g = f / s, g / s
        forward.append((f, g))
        scale.append(s)
    own, counts = [None] * len(emit), [0.0] * 4
    p, q = 1.0, 1.0
    own[-1] = forward[-1]
    for k in range(len(emit) - 2, -1, -1):
        x, y = emit[k + 1][0] * p / scale[k + 1], emit[k + 1][1] * q / scale[k + 1]
        f, g = forward[k]
        counts[0] += f * a * x
        counts[1] += f * b * y
        counts[2] += g * c * x
        counts[3] += g * d * y
        p, q = a * x + b * y, c * x + d * y
        own[k] = (f * p / (f * p + g * q), g * q / (f * p + g * q))
    return np.array(own), np.array(counts).reshape(2, 2), float(np.log(scale).sum() + top.sum())


def marginals(scores: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents, in numbers scaled by line; long documents one by one, the others at once.

    scores: (lines, 2) log potentials, moves: (2, 2) log potentials of neighbouring labels. Returns the marginals of each
    line, the expected counts of moves, and the log normaliser of each document.
    """
    long = lines > LONG_CHAIN
    if not long.any():
        return _marginals(scores, lines, moves)
    own, counts, logs = np.empty_like(scores), np.zeros((2, 2)), np.empty(len(lines))
    in_short, ends = np.repeat(~long, lines), np.cumsum(lines)
    own[in_short], counts, logs[~long] = _marginals(scores[in_short], lines[~long], moves)
    for d in np.flatnonzero(long).tolist():
        span = slice(ends[d] - lines[d], ends[d])
        own[span], more, logs[d] = _chain(scores[span], moves)
        counts = counts + more
    return own, counts, logs


def _marginals(scores: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: step t works on all that have a line t."""
    order, first = _lanes(lines)
    sizes = lines[order]
    top = scores.max(axis=1, keepdims=True)
    emit, step = np.exp(scores - top), np.exp(moves)
    forward, scale = np.empty_like(emit), np.empty(len(emit))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # lanes longer than t
    for t in range(longest):
        at = first[: active[t]] + t
        f = emit[at] if t == 0 else (forward[at - 1] @ step) * emit[at]
        scale[at] = s = f.sum(axis=1)
        forward[at] = f / s[:, None]
    backward = np.ones_like(emit)
    counts = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        ahead = emit[at + 1] * backward[at + 1] / scale[at + 1][:, None]
        backward[at] = ahead @ step.T
        counts += step * (forward[at].T @ ahead)
    own = forward * backward
    logs = np.log(scale) + top[:, 0]
    edges = np.concatenate([[0], np.cumsum(lines)])
    return own / own.sum(axis=1, keepdims=True), counts, np.add.reduceat(logs, edges[:-1]) if len(lines) else np.zeros(0)


@dataclass(frozen=True)
class Field:
    """Weights of the features for the good label, of the moves between labels, and the curve to probabilities."""

    weights: tuple[float, ...]
    moves: tuple[tuple[float, float], tuple[float, float]]
    curve: tuple[float, float]

    def goodness(self, texts: list[str]) -> np.ndarray:
        """Log-odds of the length-weighted mean of the lines' marginals, for each text."""
        good, lines, length = line_scores(texts, np.array(self.weights))
        own, _, _ = marginals(np.column_stack([np.zeros(len(good)), good]), lines, np.array(self.moves))
        edges = np.cumsum(lines) - lines
        weight = length + 1
        mean = np.add.reduceat(own[:, 1] * weight, edges) / np.add.reduceat(weight, edges)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        slope, intercept = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * self.goodness(texts) + intercept, -30, 30)))


def fit_field(sample: list[tuple[str, int, float]], rounds: int = 150, rate: float = 0.08, ridge: float = 1e-3) -> Field:
    """Fits the field by Adam on the likelihood of lines that all bear their document's label, then the curve."""
    y = np.array([label for _, label, _ in sample], dtype=float)
    if not len(sample) or not 0 < y.sum() < len(y):
        return Field((0.0,) * FEATURES, ((0.0, 0.0), (0.0, 0.0)), (1.0, 2.0))
    texts, each = [t for t, _, _ in sample], np.array([w for _, _, w in sample])
    x, lines, _ = line_features(texts)
    of = np.repeat(np.arange(len(lines)), lines)
    share = each[of] / lines[of]  # every document weighs as it is sampled, however many lines it has
    seen = np.array([[np.sum((1 - y) * (lines - 1)), 0.0], [0.0, np.sum(y * (lines - 1))]])
    weights, moves = np.zeros(FEATURES), np.zeros((2, 2))
    state = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    for n in range(1, rounds + 1):
        good = x @ weights
        own, counts, _ = marginals(np.column_stack([np.zeros(len(good)), good]), lines, moves)
        gradient = np.concatenate([x.T @ (share * (y[of] - own[:, 1])) / len(y) - ridge * weights, ((seen - counts) / max(1, seen.sum()) - ridge * moves).ravel()])
        state = [0.9 * state[0] + 0.1 * gradient, 0.99 * state[1] + 0.01 * gradient**2]
        change = rate * (state[0] / (1 - 0.9**n)) / (np.sqrt(state[1] / (1 - 0.99**n)) + 1e-8)
        weights, moves = weights + change[:FEATURES], moves + change[FEATURES:].reshape(2, 2)
    draft = Field(tuple(weights), tuple(map(tuple, moves)), (1.0, 0.0))
    slope, intercept = logistic(draft.goodness(texts)[:, None], y, each)
    return Field(draft.weights, draft.moves, (float(slope), float(intercept)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field fitted on at most sample_docs labelled documents outside the held-out fold."""
    return fit_field(labelled_sample(docs, labels, "quality", folds, held_out, sample_docs))


def score_quality(docs: DataFrame, field: Field, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Adds held_out, score and predicted to docs; columns of these names are replaced, others stay.

    Every whole text is scored on its own; null and empty texts are one empty line. A null doc_id is in no held-out fold.
    Rows that repeat get equal scores. An empty table gives no rows. No shuffle. Memory is a block of texts and some numbers
    for each of its lines; of a long text the features of CHUNK_LINES lines are held at once.
    """
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    base = docs.select(*kept, F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"))
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = kept.index("text")

    def blocks(texts):
        block, size = [], 0
        for text in texts:
            own = 4 * len(text) + LINE_BYTES * text.count("\n")
            if block and size + own > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append(text)
            size += own
        if block:
            yield block

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = np.concatenate([field.score(b) for b in blocks(texts_of(batch.column(at)))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], names=schema.names)

    return base.mapInArrow(run, schema)
