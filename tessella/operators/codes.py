"""Codes over tables that the caller brings: prefix-coded text, word codes, positions as numbers.

None of these has a table of its own. Code tables come from character counts, word lists and weights are parameters, and
the layout of position codes is this library's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import geo, matrix, names

#: Bits that the text decoder looks up at once; longer codes are searched. Codes are at most 56 bits long.
WINDOW_BITS = 14
LONGEST_CODE = 56
#: Bytes of text that are coded or decoded at once in a worker.
BLOCK_BYTES = 1 << 18
#: Bytes of codes that the decoder takes at once: a place for every bit of them is 2 MB.
RUN_BYTES = 1 << 15


def code_table(docs: DataFrame, column: str = "text") -> dict[str, str]:
    """Characters to canonical prefix codes, from all texts of a column.

    One row for each distinct character, at most 1,114,112, comes to the driver when this is called, not when a plan runs.
    """
    counts = [(r["code"], r["n"]) for r in names.char_counts(docs, column).orderBy("code").collect()]
    return {chr(point): bits for point, bits in names.canonical_codes(names.code_lengths(counts)).items()}


class _Table:
    """A code table as arrays: by code point the code and its length (0: none), and codes from the left in 56 bits, in order."""

    def __init__(self, table: dict[str, str]):
        self.deepest = max(map(len, table.values()), default=1)
        if self.deepest > LONGEST_CODE:
            raise ValueError(f"codes may have {LONGEST_CODE} bits at most")
        points = np.array([ord(c) for c in table], dtype=np.int64)
        codes, lengths = np.array([int(b, 2) for b in table.values()], dtype=np.uint64), np.array([len(b) for b in table.values()], dtype=np.int64)
        top = int(points.max(initial=0)) + 2
        self.code, self.length = np.zeros(top, dtype=np.uint64), np.zeros(top, dtype=np.uint8)
        self.code[points], self.length[points] = codes, lengths
        left = codes << (LONGEST_CODE - lengths).astype(np.uint64)
        order = np.argsort(left, kind="stable")
        self.left, self.points, self.lengths = left[order], points[order].astype(np.uint32), lengths[order]
        self.wide = min(self.deepest, WINDOW_BITS)
        self.reach, self.symbol = np.zeros(1 << self.wide, dtype=np.uint8), np.zeros(1 << self.wide, dtype=np.uint32)
        for first, point, length in zip((left >> np.uint64(LONGEST_CODE - self.wide)).tolist(), points.tolist(), lengths.tolist()):
            if length <= self.wide:
                self.reach[first : first + (1 << (self.wide - length))], self.symbol[first : first + (1 << (self.wide - length))] = length, point

    def sizes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, the length of each's code, and the first character of each text and its bits; no bits: a character is missing."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        lengths = self.length[np.minimum(points, len(self.length) - 1)].astype(np.int64)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        sums, missing = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(lengths == 0)])
        bits = np.where(missing[first[1:]] > missing[first[:-1]], -1, sums[first[1:]] - sums[first[:-1]])
        return points, lengths, first, bits

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The codes of all texts, each from a whole byte on: codes are moved to their places in words of 64 bits and added up."""
        points, lengths, first, bits = self.sizes(texts)
        size = np.maximum(-(-bits // 8), 0)
        begin = np.concatenate([[0], np.cumsum(size)])
        sums = np.cumsum(lengths) - lengths
        count = np.diff(first)
        at = sums + np.repeat(8 * begin[:-1] - np.concatenate([sums, [0]])[first[:-1]], count)
        keep = np.repeat(bits >= 0, count) & (lengths > 0)
        at, lengths = at[keep], lengths[keep]
        code = self.code[np.minimum(points[keep], len(self.code) - 1)] << (64 - lengths).astype(np.uint64)
        words = np.zeros(int(begin[-1]) // 8 + 2, dtype=np.uint64)
        if len(at):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[starts]] = np.bitwise_or.reduceat(code >> shift, starts)
            over = np.flatnonzero(shift + lengths.astype(np.uint64) > 64)  # at most one for each word
            words[word[over] + 1] |= code[over] << (np.uint64(64) - shift[over])
        data = words.astype(">u8").tobytes()
        return [data[a : a + n] if b >= 0 else None for a, n, b in zip(begin.tolist(), size.tolist(), bits.tolist())]

    def decode(self, coded: list[bytes], counts: list[int]) -> list[str | None]:
        """The texts of all codes, by runs of codes whose arrays stay in a core's cache."""
        return _in_blocks(list(zip(coded, counts)), lambda x: len(x[0]), lambda run: self._decode(*zip(*run)), RUN_BYTES)

    def _decode(self, coded: tuple[bytes, ...], counts: tuple[int, ...]) -> list[str | None]:
        """The texts of all codes. For every bit the place behind a code that begins there is looked up at once; 32 steps are then made as one.

        Bits where no code begins stay where they are, which the last step of a text tells.
        """
        pad = LONGEST_CODE // 8 + 2
        stream = np.frombuffer(b"".join(c + bytes(pad) for c in coded) + bytes(pad), dtype=np.uint8)
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        begin = np.cumsum(sizes + pad) - sizes - pad
        three = stream[:-2].astype(np.uint32) << 16 | stream[1:-1].astype(np.uint32) << 8 | stream[2:]
        window = np.empty((len(three), 8), dtype=np.uint32)
        for shift in range(8):
            window[:, shift] = three >> (24 - self.wide - shift) & ((1 << self.wide) - 1)
        window = window.reshape(-1)
        reach, symbol = self.reach[window], self.symbol[window]
        if self.deepest > self.wide:
            far = np.flatnonzero(reach == 0)
            far = far[far < 8 * (len(stream) - 9)]
            byte = far >> 3
            value = np.zeros(len(far), dtype=np.uint64)
            for k in range(8):
                value = value << np.uint64(8) | stream[byte + k]
            value = (value << (far & 7).astype(np.uint64)) >> np.uint64(8)
            place = np.searchsorted(self.left, value, side="right") - 1
            found = (place >= 0) & (value - self.left[place] < np.uint64(1) << (LONGEST_CODE - self.lengths[place]).astype(np.uint64))
            reach[far[found]], symbol[far[found]] = self.lengths[place[found]], self.points[place[found]]
        one = np.arange(len(reach), dtype=np.intp)
        one += reach
        np.minimum(one, len(reach) - 1, out=one)
        jump, stride = one, 1
        if sum(counts) >= 256:
            for _ in range(5):
                jump, stride = jump.take(jump), 2 * stride
        step, heads = jump.item, []
        for p, n in zip((8 * begin).tolist(), counts):
            for _ in range(-(-n // stride)):
                heads.append(p)
                p = step(p)
        steps, texts = np.empty((len(heads), stride), dtype=np.intp), []
        at = np.array(heads, dtype=np.intp)
        for k in range(stride):
            steps[:, k] = at
            at = one.take(at)
        row = 0
        steps = steps.reshape(-1)
        for a, size, n in zip((8 * begin).tolist(), sizes.tolist(), counts):
            own = steps[row * stride : row * stride + n]
            row += -(-n // stride)
            # no code begins where the reach is 0, and the last code may not end behind the bytes
            fine = not n or (reach[own].all() and int(own[-1]) + int(reach[own[-1]]) <= a + 8 * size)
            texts.append(symbol[own].tobytes().decode("utf-32-le") if fine else None)
        return texts


def _in_blocks(items: list, size, run, most: int = BLOCK_BYTES) -> list:
    """Results of run over runs of items of about so many bytes together; a larger item is taken alone. None stays None."""
    out: list = [None] * len(items)
    block, held = [], 0
    for i, item in enumerate([*items, None]):
        if block and (held >= most or i == len(items)):
            for k, found in zip(block, run([items[k] for k in block])):
                out[k] = found
            block, held = [], 0
        if item is not None:
            block.append(i)
            held += size(item)
    return out


def _runs(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of a column of texts or binaries of about so many bytes each, so that a worker holds a batch once, not also as objects and results."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        yield column.slice(begin, end - begin)
        begin = end


def coded_size(table: dict[str, str]):
    """A vectorised function text -> bytes that it takes in a code, without coding it (X1). The table is made once for each task."""

    @F.arrow_udf(T.LongType())
    def size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _Table(table)
        for texts in batches:
            for run in _runs(texts):
                found = _in_blocks(run.to_pylist(), len, lambda t: own.sizes(t)[3].tolist())
                yield pa.array([None if n is None or n < 0 else -(-n // 8) for n in found], pa.int64())

    return size


def encode_text(table: dict[str, str]):
    """A vectorised function text -> binary: the codes of its characters, filled with zeros to whole bytes.

    Null for null and for a text with a character that the table lacks. The table is made once for each task.
    """

    @F.arrow_udf(T.BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _Table(table)
        for texts in batches:
            for run in _runs(texts):
                yield pa.array(_in_blocks(run.to_pylist(), len, own.encode), pa.binary())

    return encode


def decode_text(table: dict[str, str]):
    """A vectorised function (binary, characters) -> text, the inverse of encode_text; null where the bytes are too few."""

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = _Table(table)
        for data, counts in batches:
            begin = 0
            for run in _runs(data):
                items = [None if raw is None or n is None else (raw, int(n)) for raw, n in zip(run.to_pylist(), counts.slice(begin, len(run)).to_pylist())]
                begin += len(run)
                # more characters than bits are never there
                items = [x if x is None or x[1] <= 8 * len(x[0]) else (b"", 1) for x in items]
                yield pa.array(_in_blocks(items, lambda x: len(x[0]), lambda some: own.decode(*map(list, zip(*some)))), pa.string())

    return decode


#: Steps along an edge of a face, and the points of its triangle. Codes are face - 10 times these, and a point's number: all 64 bits.
EDGE_STEPS = (math.isqrt(8 * (2**63 // 10) + 1) - 3) // 2
POINTS = (EDGE_STEPS + 1) * (EDGE_STEPS + 2) // 2


_ROWS = 2 * EDGE_STEPS + 3
_MIDDLES, _CORNERS = np.array(geo.CENTROIDS), np.array([[geo.VERTICES[i] for i in f] for f in geo.FACES])
#: Rows that turn a direction into the weights of a face's corners, up to a common factor.
_WEIGHTS = np.linalg.inv(_CORNERS.transpose(0, 2, 1))


def _row_start(row: np.ndarray) -> np.ndarray:
    """Number of the first point of a row of the triangle; row i has EDGE_STEPS + 1 - i points."""
    return row * (_ROWS - row) // 2


def _codes(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Numbers of the nearest points of the nearest faces to directions, of which no part is missing."""
    p = np.column_stack([x, y, z])
    face = (p @ _MIDDLES.T).argmax(axis=1)  # the smallest one on edges
    w = np.einsum("nij,nj->ni", _WEIGHTS[face], p)
    w *= EDGE_STEPS / w.sum(axis=1, keepdims=True)
    near = np.floor(w + 0.5)
    off = np.abs(near - w)
    worst = off.argmax(axis=1)  # the weight that is rounded most gives way to the sum
    rows = np.arange(len(p))
    near[rows, worst] = EDGE_STEPS - (near.sum(axis=1) - near[rows, worst])
    i = np.clip(near[:, 0].astype(np.int64), 0, EDGE_STEPS)
    j = np.clip(near[:, 1].astype(np.int64), 0, EDGE_STEPS - i)
    return (face.astype(np.int64) - 10) * POINTS + _row_start(i) + j


def _directions(code: np.ndarray) -> np.ndarray:
    """Unit vectors of codes."""
    face, t = np.floor_divide(code, POINTS) + 10, np.mod(code, POINTS)
    row = np.floor((_ROWS - np.sqrt((_ROWS * _ROWS - 8 * t).astype(np.float64))) / 2).astype(np.int64)
    row -= _row_start(row) > t
    row += _row_start(row + 1) <= t
    u, v = row / EDGE_STEPS, (t - _row_start(row)) / EDGE_STEPS
    p = np.einsum("ni,nij->nj", np.column_stack([u, v, 1 - u - v]), _CORNERS[face])
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def _sphere(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.radians(lat), np.radians(lon)
    return np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)


def _coded(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> pd.Series:
    known = np.isfinite(x) & np.isfinite(y) & np.isfinite(z)
    out = pd.Series(pd.NA, index=range(len(x)), dtype="Int64")
    out[known] = _codes(x[known], y[known], z[known])
    return out


@F.pandas_udf(T.LongType())
def code_of_xyz(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """The position code of a direction, a BIGINT: the nearest of POINTS points on the nearest of 20 faces.

    Points are at most 3.7 mm from what they stand for. Null where a part is null or not finite.
    """
    return _coded(*(v.to_numpy(dtype=np.float64) for v in (x, y, z)))


@F.pandas_udf(T.LongType())
def position_code(lat: pd.Series, lon: pd.Series) -> pd.Series:
    """The position code of degrees (G4, G6). One vectorised function, so that plans stay small where filters use its result."""
    return _coded(*_sphere(lat.to_numpy(dtype=np.float64), lon.to_numpy(dtype=np.float64)))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("lat", "lon", "x", "y", "z")]))
def position_of(code: pd.Series) -> pd.DataFrame:
    """struct<lat, lon, x, y, z> of a position code, x, y, z of length 1 (G5, G6); its parts are null for null."""
    known = code.notna().to_numpy()
    p = np.full((len(code), 3), np.nan)
    p[known] = _directions(code[known].to_numpy(dtype=np.int64))
    x, y, z = p.T
    return pd.DataFrame({"lat": np.degrees(np.arctan2(z, np.hypot(x, y))), "lon": np.degrees(np.arctan2(y, x)), "x": x, "y": y, "z": z})


@F.arrow_udf(T.ArrayType(T.LongType()))
def _track(lats: pa.Array, lons: pa.Array) -> pa.Array:
    flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
    codes = pa.array(_coded(*_sphere(flat(lats), flat(lons))), pa.int64())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lats), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), codes, mask=lats.is_null())


def track_codes(track: Column) -> Column:
    """Position codes of an array of struct<lat, lon> (G12); null for null."""
    return _track(F.transform(track, lambda p: p["lat"].cast("double")), F.transform(track, lambda p: p["lon"].cast("double")))


def digits_needed(words: int, most: int = 2**63 - 1) -> int:
    """Words that any number up to `most` takes with a list of so many words, the check's word included."""
    n = 1
    while most:
        most //= words
        n += 1
    return n


def to_words(number: Column, words: list[str], signed: bool = False) -> Column:
    """A number from 0 as words (G7): first its remainder by the number of words, as a check, then its digits, least first.

    signed: a BIGINT below 0 counts too, as position codes are; then all 64 bits, from -2**63 on, are written.
    """
    base, count = len(words), digits_needed(len(words), 2**64 - 1 if signed else 2**63 - 1)

    @F.arrow_udf(T.StringType())
    def write(numbers: pa.Array) -> pa.Array:
        listed, known = pa.array(words, pa.string()), pc.fill_null(numbers.is_valid() if signed else pc.greater_equal(numbers, 0), False)
        number = np.ascontiguousarray(pc.fill_null(numbers, 0).to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
        rest = number ^ np.uint64(2**63) if signed else number
        digits = [rest % base]
        for _ in range(count - 1):
            rest, digit = np.divmod(rest, np.uint64(base))
            digits.append(digit)
        text = pc.binary_join_element_wise(*[listed.take(pa.array(d, pa.uint64())) for d in digits], " ")
        return pc.if_else(known, text, pa.scalar(None, pa.string()))

    return write(number.cast("bigint"))


def from_words(words: list[str], signed: bool = False):
    """A vectorised function text -> the number of a word code.

    Null where a word isn't listed, words are too many or few, or the check fails. Blanks around words and capitals don't
    count. with_number_of_words reads texts with slips as well.
    """
    base, most = len(words), 2**64 - 1 if signed else 2**63 - 1
    length, least = digits_needed(base, most), -(2**63) if signed else 0

    place = {w: i for i, w in reversed(list(enumerate(words)))}

    def one(text: str | None) -> int | None:
        digits = [place.get(w) for w in text.lower().split()] if text is not None else []
        if len(digits) != length or None in digits:
            return None
        number = sum(d * base**k for k, d in enumerate(digits[1:]))
        return number + least if number <= most and number % base == digits[0] else None

    @F.arrow_udf(T.LongType())
    def read(texts: pa.Array) -> pa.Array:
        # all texts in ASCII are read at once; others, and those with the blanks that only Python knows, one by one
        plain = pc.fill_null(pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring_regex(texts, "[\x1c-\x1f]"))), False)
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.if_else(plain, texts, ""))))
        right = pc.equal(pc.list_value_length(parts), length).to_numpy(zero_copy_only=False)
        own = [w for w in place if w.split() == [w]]
        found = pc.index_in(parts.filter(pa.array(right)).flatten(), value_set=pa.array(own, pa.string())).to_numpy(zero_copy_only=False).reshape(-1, length)
        listed = ~np.isnan(found.astype(np.float64)).any(axis=1)
        digits = np.array([place[w] for w in own], dtype=np.uint64)[found[listed].astype(np.int64)]
        number, fits = np.zeros(len(digits), dtype=np.uint64), np.ones(len(digits), dtype=bool)
        for k in range(length - 1, 0, -1):
            fits &= number <= (np.uint64(most) - digits[:, k]) // np.uint64(base)
            number = number * np.uint64(base) + digits[:, k]
        fits &= number % np.uint64(base) == digits[:, 0]
        out, known = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
        rows = np.flatnonzero(right)[listed][fits]
        out[rows], known[rows] = ((number ^ np.uint64(2**63)) if signed else number)[fits].view(np.int64), True
        for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            value = one(texts[i].as_py())
            out[i], known[i] = value or 0, value is not None
        return pa.array(out, pa.int64(), mask=~known)

    return read


def with_number_of_words(df: DataFrame, column: str, words: list[str], name: str) -> DataFrame:
    """Adds the number of a column's word codes; where one can't be read as it is, each word is first replaced by the nearest in the list.

    Only distinct words of such texts are compared with the list, and corrected texts are joined back by their spelling.
    Null where the check fails after that too.
    """
    exact = df.withColumn(name, from_words(words)(F.col(column)))
    slips = exact.filter(F.col(name).isNull() & F.col(column).isNotNull()).select(F.col(column).alias("_slip")).distinct()
    parts = slips.select("_slip", F.posexplode(F.split(F.btrim(F.lower("_slip")), r"\s+")).alias("_at", "_word"))
    nearest = names.nearest_word(parts, "_word", words)
    mended = nearest.groupBy("_slip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "nearest"))), lambda x: x["nearest"]), " ").alias("_text"))
    mended = mended.select("_slip", from_words(words)(F.col("_text")).alias("_mended")).filter("_mended IS NOT NULL")
    joined = exact.join(mended, exact[column] == mended["_slip"], "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.col("_mended"))).drop("_slip", "_mended")


def luminance(r: Column, g: Column, b: Column, weights: tuple[float, float, float]) -> Column:
    """Linear light of linear channels by the caller's weights (K8)."""
    return r * weights[0] + g * weights[1] + b * weights[2]


def derive_rgb_to_observer(observer: DataFrame, wavelengths: tuple[float, float, float]) -> DataFrame:
    """One row with to_lms and to_rgb: the matrix of three wavelengths in an observer's table, and its inverse (L2).

    observer: nm and the responses l, m, s, as the caller brings them. Wavelengths between rows are interpolated.
    """
    out = None
    for i, nm in enumerate(wavelengths):
        below = F.max(F.when(F.col("nm") <= nm, F.struct("nm", "l", "m", "s")))
        above = F.min(F.when(F.col("nm") >= nm, F.struct("nm", "l", "m", "s")))
        ends = observer.agg(below.alias("a"), above.alias("b"))
        at = F.when(F.col("b.nm") > F.col("a.nm"), (F.lit(nm) - F.col("a.nm")) / (F.col("b.nm") - F.col("a.nm"))).otherwise(0.0)
        column = ends.select(F.array(*[F.col(f"a.{k}") + (F.col(f"b.{k}") - F.col(f"a.{k}")) * at for k in "lms"]).alias(f"c{i}"))
        out = column if out is None else out.crossJoin(column)  # three rows of one each
    m = F.array(*[F.get(F.col(f"c{i}"), F.lit(k)) for k in range(3) for i in range(3)])
    return out.select(m.alias("to_lms"), matrix.invert(m).alias("to_rgb"))


def through(row: DataFrame, matrices: dict[str, list[float]]) -> DataFrame:
    """Adds to_<name> and from_<name> for each matrix of a caller: the observer's matrix carried on by it, and the inverse (L2).

    row: the result of derive_rgb_to_observer. A matrix takes the observer's responses to another space, as XYZ or the
    primaries of a display.
    """
    for name, cells in matrices.items():
        row = row.withColumn(f"to_{name}", matrix.multiply(F.array(*[F.lit(float(x)) for x in cells]), F.col("to_lms")))
        row = row.withColumn(f"from_{name}", matrix.invert(F.col(f"to_{name}")))
    return row


def is_identity(m: Column, tolerance: float = 1e-9) -> Column:
    """Whether a matrix is the identity but for rounding (L2)."""
    return F.forall(F.transform(m, lambda x, i: F.abs(x - F.when(i % 4 == 0, 1.0).otherwise(0.0))), lambda d: d <= tolerance)
