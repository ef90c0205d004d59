"""Toxicity by a weighted lexicon and Aho-Corasick over folded text (operator 9)."""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import texts_of
from tessella.llm.samples import fold_of, labelled_sample, logistic

#: Labelled documents that the lexicon's weights are fitted on, at most.
SAMPLE_DOCS = 4_000
#: Entries of the lexicon, at most, by weight.
LEXICON_ENTRIES = 4_096

#: Parameters that a caller may replace: general insults with which a lexicon starts where the labels say nothing of them,
SEEDS = ("idiot", "moron", "stupid", "imbecile", "loser", "pathetic", "scum", "trash", "worthless", "disgusting", "clown", "bastard", "dumbass", "retard", "vermin")
#: and phrases in which a listed word means no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "clown car", "stupid mistake", "pond scum", "soap scum", "sore loser rule", "loser bracket")

#: Letters of other scripts that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ɪ": "i", "ɴ": "n", "ʀ": "r", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
}
SIGNS = {"@": "a", "$": "s", "!": "i"}
SIGN = re.compile(r"[@$!](?=[^\W_])")


class _Folding(dict):
    """Code point to what it is read as, made when it is first met: lower-case letters and digits, a blank for the rest.

    Compatibility forms (wide, mathematical, enclosed and small letters, ligatures) fall apart into plain ones; loose marks
    and characters without width go. Letters composed with a mark stay so, as another word may differ by the mark only.
    """

    def __missing__(self, code: int) -> str | None:
        parts = [c for c in unicodedata.normalize("NFKC", chr(code)) if unicodedata.category(c) not in ("Mn", "Me", "Cf")]
        plain = "".join(HOMOGLYPHS.get(c, c) for c in "".join(parts).lower())
        self[code] = found = plain if plain.isalnum() else " " if parts else None
        return found


class _Bare(dict):
    """Code point to the letter without marks; one for one, so places stay."""

    def __missing__(self, code: int) -> str:
        first, *rest = unicodedata.normalize("NFD", chr(code))
        self[code] = found = HOMOGLYPHS.get(first, first) if all(unicodedata.category(c) == "Mn" for c in rest) else chr(code)
        return found


_TABLE, _BARE = _Folding(), _Bare()


def fold(text: str) -> str:
    """Text with wide and look-alike letters and digits as plain letters and blanks for the rest, between two blanks."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "@" in text or "$" in text or "!" in text:
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.translate(_TABLE)} "


@dataclass(frozen=True)
class Lexicon:
    """Weights of word beginnings, and of short words with a blank behind, phrases that cancel hits inside them, and the curve from features to probability."""

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]


def _new_words(texts: list[str]) -> Counter:
    """Words of the texts; a word counts once for each pair of neighbours, so copies of a text don't count twice."""
    seen: set[int] = set()
    out: Counter = Counter()
    for text in texts:
        words = fold(text).split()
        for left, word, right in zip(["", *words], words, [*words[1:], ""]):
            key = hash((left, word, right))
            if key not in seen:
                seen.add(key)
                out[word] += 1
    return out


def _weights(sample: list[tuple[str, int, float]], shortest: int, longest: int, least: int, entries: int, seeds: tuple[str, ...]) -> dict[str, float]:
    """Log-odds of the labels for beginnings of words, by how often they occur in toxic and in clean text. Words shorter than `shortest` count whole, with a blank behind.

    Beginnings are weighed from short to long, each with its shorter one as prior; kept are those that make toxic text at
    least e times as likely even where chance flatters them, that occur `least` times there, and that say more than the shorter one they begin with.
    """
    counts, total = {}, []
    for y in (1, 0):
        words = _new_words([text for text, label, _ in sample if label == y])
        total.append(max(1, sum(words.values())))
        by_start: Counter = Counter()
        for word, n in words.items():
            if len(word) < shortest:
                by_start[f"{word} "] += n
            for k in range(shortest, min(len(word), longest) + 1):
                by_start[word[:k]] += n
        counts[y] = by_start
    toxic, clean, odds = counts[1], counts[0], {}
    for start, n in sorted(toxic.items(), key=lambda x: (len(x[0]), x[0])):
        if n >= least:
            own = math.log((n + 0.5) / total[0] / ((clean[start] + 0.5) / total[1]))
            odds[start] = (3 * odds.get(start[:-1], 0.0) + (n + clean[start]) * own) / (3 + n + clean[start])
    sure = {s: w - 1.5 * math.sqrt(1 / toxic[s] + 1 / (clean[s] + 1)) for s, w in odds.items()}  # the lower end of what the counts allow
    told = {s: sure[s] for s, w in odds.items() if sure[s] >= 1 and (s[:-1] not in odds or odds[s[:-1]] < 1 or abs(w - odds[s[:-1]]) > 0.25)}
    # a beginning that goes on in one way only is taken as long as it does: a word's, not that of all words that begin like it
    grown = {s[:-1]: s for s in odds if toxic[s] >= 0.98 * toxic[s[:-1]]}
    for start in sorted(set(told) & set(grown), key=len):
        weight = told.pop(start)
        while start in grown:
            start = grown[start]
        told[start] = max(weight, told.get(start, weight))
    # where a longer beginning is clean, it must not pass for its toxic shorter one
    told |= {s: min(0.0, w) for s, w in odds.items() if w < 1 and odds.get(s[:-1], 0.0) >= 1}
    kept = dict(sorted(told.items(), key=lambda x: (-abs(x[1]) * toxic[x[0]], x[0]))[:entries])
    for word in seeds:
        if toxic[word] + clean[word] < least:
            kept[word] = 6.0
    return kept


def _side(text: str) -> int:
    """0 or 1 by the least hash of a text's neighbouring words, so near copies are mostly on one side."""
    words = ["", *fold(text).split(), ""]
    return min(zlib.crc32(f"{a} {b}".encode()) for a, b in itertools.pairwise(words)) & 1


def fit_lexicon(
    sample: list[tuple[str, int, float]], shortest: int = 4, longest: int = 12, least: int = 4, seeds: tuple[str, ...] = SEEDS, exceptions: tuple[str, ...] = EXCEPTIONS
) -> Lexicon:
    """A lexicon and its curve. The curve is fitted on one half of the sample with weights learned from the other half."""
    labels = np.array([y for _, y, _ in sample], dtype=float)
    learn = lambda rows: tuple(sorted(_weights(rows, shortest, longest, least, LEXICON_ENTRIES, seeds).items()))
    final = Lexicon(learn(sample), tuple(exceptions), (0.2, 2.0, 0.0, 0.0, -3.0))
    if not len(sample) or not 0 < labels.sum() < len(labels):
        return final
    xs, ys, ws = [], [], []
    sides = [_side(t) for t, _, _ in sample]  # so copies don't tell what their copies are
    for side in (0, 1):
        match = Matcher(Lexicon(learn([s for s, k in zip(sample, sides) if k != side]), final.exceptions, final.curve))
        xs += [match.features(t) for (t, _, _), k in zip(sample, sides) if k == side]
        ys += [y for (_, y, _), k in zip(sample, sides) if k == side]
        ws += [w for (_, _, w), k in zip(sample, sides) if k == side]
    curve = logistic(np.array(xs), np.array(ys, dtype=float), np.array(ws))
    return Lexicon(final.weights, final.exceptions, tuple(float(c) for c in curve))


class Matcher:
    """One automaton for words and exception phrases."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.curve = lexicon.curve
        self.automaton = ahocorasick.Automaton()
        for word, weight in lexicon.weights:
            self.automaton.add_word(f" {word}", (len(word) + 1, weight, False))
        for phrase in lexicon.exceptions:
            key = f"{fold(phrase).rstrip()} "
            self.automaton.add_word(key, (len(key), 0.0, True))
        self.automaton.make_automaton()

    def _matches(self, folded: str) -> tuple[dict[int, float], list[tuple[int, int]]]:
        """Weights by the place of the word they match, the longest beginning of each, and the stretches of exception phrases in order."""
        hits: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (n, weight, exception) in self.automaton.iter(folded):
            if exception:
                begin = end - n
                while safe and safe[-1][0] >= begin:  # ends rise, so an earlier phrase that begins later is inside
                    safe.pop()
                safe.append((begin, end - 1))  # the blank behind a phrase begins the next word
            else:
                hits[end - n] = weight  # ends rise, so the longest comes last
        return hits, safe

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Weight of the hits outside exception phrases on a logarithmic scale, by the logarithm of the words and by words; and their number's logarithm.

        A word is matched as it is written, and where that matches nothing without its marks. Time is in proportion to the text.
        """
        folded = fold(text)
        words = len(folded.split())
        hits, safe = self._matches(folded)
        if not folded.isascii() and (bare := folded.translate(_BARE)) != folded:
            hits = self._matches(bare)[0] | hits
        total, k = 0.0, 0
        for at in sorted(hits):
            while k < len(safe) and safe[k][1] <= at:
                k += 1
            if k == len(safe) or at < safe[k][0]:
                total += hits[at]
        size = math.log2(4 + words)
        return math.asinh(total), total / size, 10 * total / (10 + words), size / 10

    def score(self, text: str) -> float:
        *slopes, intercept = self.curve
        x = intercept + sum(a * b for a, b in zip(slopes, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


_MATCHERS: dict[Lexicon, Matcher] = {}


def matcher(lexicon: Lexicon) -> Matcher:
    """One automaton for each worker and lexicon."""
    if lexicon not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[lexicon] = Matcher(lexicon)
    return _MATCHERS[lexicon]


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample_docs: int = SAMPLE_DOCS, seeds: tuple[str, ...] = SEEDS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon fitted on at most sample_docs labelled documents outside the held-out fold; seeds and exceptions are the caller's lists."""
    return fit_lexicon(labelled_sample(docs, labels, "toxic", folds, held_out, sample_docs), seeds=seeds, exceptions=exceptions)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """Adds held_out, score and predicted to docs; columns of these names are replaced, others stay.

    Every whole text is scored on its own, of any length; null and empty texts get the score of a text without hits. A null doc_id is in
    no held-out fold. Rows that repeat get equal scores. An empty table gives no rows. No shuffle.
    """
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    base = docs.select(*kept, F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"))
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = kept.index("text")

    def run(batches):
        match = matcher(lexicon)
        for batch in batches:
            scores = [match.score(t) for t in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=schema.names)

    return base.mapInArrow(run, schema)
