"""Progressive JPEG as a lossless store of bytes: coefficients, scans and RGB tensors in numpy (operator 10).

A payload is 64 bytes to a block. Byte b of a block is stored as one quantized coefficient of fixed magnitude category, so
that every scan has a fixed layout and is written and read as an array: AC coefficients are b or b - 255 (at least 128 in
size), DC coefficients are b + 256. Two scans select AC bands 1-5 and 6-63 without their lowest bit, two more refine DC and AC by
that bit. The reader also decodes progressive files of any other layout, symbol by symbol.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of payload in a block, blocks that are transformed at once, and bytes of texts or media that are coded or whose tensors are held at once.
UNIT = 64
CHUNK_BLOCKS = 1 << 14
READ_BYTES = 1 << 20
#: Zigzag position of each coefficient in natural order, by the diagonal rule.
_CELLS = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
ZIGZAG = np.array([8 * r + c for r, c in _CELLS])
#: Sampling of Y, Cb and Cr: 4:2:0. A minimum coded unit has 4, 1 and 1 blocks.
SAMPLING = ((2, 2), (1, 1), (1, 1))
BANDS = ((1, 5), (6, 63))
_COMMENT = b"payload "

#: Inverse transform of a block in zigzag order, times 4096 and rounded, so that sums are whole numbers and exact in doubles.
_X, _U = np.arange(8)[:, None], np.arange(8)[None, :]
_COSINES = np.cos((2 * _X + 1) * _U * np.pi / 16) * np.where(_U == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
_INVERSE = np.round(np.einsum("yv,xu->vuyx", _COSINES, _COSINES).reshape(64, 64)[ZIGZAG] * 4096)


class JpegError(ValueError):
    """The bytes are no progressive JPEG that can be read."""


def grid_of(blocks: int) -> tuple[int, int]:
    """Width and height, in coded units of 6 blocks, of a nearly square image that holds so many blocks."""
    units = max(1, -(-blocks // 6))
    wide = max(1, int(np.ceil(np.sqrt(units))))
    return wide, -(-units // wide)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _code(kind: int, length: int, symbol: int) -> bytes:
    """A Huffman table of one code, all zeros."""
    counts = bytearray(16)
    counts[length - 1] = 1
    return _segment(0xC4, bytes([kind]) + bytes(counts) + bytes([symbol]))


def _scan(component: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component + 1, 0, first, last, high << 4 | low]))


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64))
#: DC: a code of 8 bits for category 8, and a restart after each block. AC: a code of 1 bit for category 7.
_TABLES_FIRST = _code(0x00, 8, 8) + _code(0x10, 1, 7) + _segment(0xDD, struct.pack(">H", 1))
_NO_RESTART = _segment(0xDD, struct.pack(">H", 0))
#: For refinement a code of 1 bit for the end of a block.
_TABLES_REFINE = _code(0x10, 1, 0)
_RESTARTS = np.array([0xD0 + i for i in range(8)], dtype=np.uint8)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, whose length is a positive multiple of 64."""
    grids = [grid_of(len(p) // UNIT) for p in payloads]
    sizes = [6 * w * h for w, h in grids]
    data = np.frombuffer(b"".join(p.ljust(UNIT * n, b"\0") for p, n in zip(payloads, sizes)), dtype=np.uint8).reshape(-1, UNIT)
    positive = data >= 128
    magnitude = np.where(positive, data, 255 - data)
    half = magnitude[:, 1:] >> 1
    ac = np.where(positive[:, 1:], half, half ^ 127).astype(np.uint8)  # a zero bit and 7 bits of magnitude
    refine = np.zeros((len(data), 64), dtype=np.uint8)
    refine[:, 1:] = magnitude[:, 1:] & 1
    refine = np.packbits(refine, axis=1)
    dc = (data[:, 0] >> 1) | 128
    low = data[:, 0] & 1
    out, at = [], 0
    for payload, (w, h), n in zip(payloads, grids, sizes):
        cuts = [at, at + 4 * w * h, at + 5 * w * h, at + n]
        spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(SAMPLING))
        parts = [_HEAD, _segment(0xFE, _COMMENT + str(len(payload)).encode()), _segment(0xC2, frame), _TABLES_FIRST]
        for i, s in enumerate(spans):
            count = s.stop - s.start
            rows = np.zeros((count, 4), dtype=np.uint8)
            rows[:, 1], rows[:, 2], rows[:, 3] = dc[s], 0xFF, _RESTARTS[np.arange(count) & 7]
            coded = rows.tobytes()[:-2]
            if (dc[s] == 255).any():
                coded = re.sub(rb"\x00\xff(?=\xff[\xd0-\xd7]|\Z)", b"\x00\xff\x00", coded)
            parts += [_scan(i, 0, 0, 0, 1), coded]
        parts.append(_NO_RESTART)
        for first, last in BANDS:
            for i, s in enumerate(spans):
                parts += [_scan(i, first, last, 0, 1), ac[s, first - 1 : last].tobytes()]
        parts.append(_TABLES_REFINE)
        for i, s in enumerate(spans):
            count = s.stop - s.start
            bits = np.ones(-(-count // 8) * 8, dtype=np.uint8)
            bits[:count] = low[s]
            parts += [_scan(i, 0, 0, 1, 0), np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")]
        for i, s in enumerate(spans):
            parts += [_scan(i, 1, 63, 1, 0), refine[s].tobytes().replace(b"\xff", b"\xff\0")]
        out.append(b"".join(parts) + b"\xff\xd9")
        at += n
    return out


@dataclass
class Component:
    """Coefficients of one component in zigzag order, by block; wide and high count its own blocks, stride those stored in a row."""

    h: int
    v: int
    quant: int
    wide: int = 0
    high: int = 0
    stride: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), dtype=np.int32))
    dense: bool = False  # no AC coefficient of any block is zero


class _Bits:
    """Bits of one restart interval; beyond the end come ones."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        byte, bit = divmod(self.at, 8)
        self.at += n
        word = int.from_bytes(self.data[byte : byte + 4].ljust(4, b"\xff"), "big")
        return (word >> (32 - bit - n)) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise JpegError("no such code")


def _extended(bits: int, size: int) -> int:
    return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


_END_OF_SCAN = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")


class Reader:
    """Accumulates the scans of one progressive file into coefficient arrays."""

    def __init__(self, data: bytes, fast: bool = True):
        self.fast, self.quant, self.huffman, self.restart = fast, {}, {}, 0
        self.components: dict[int, Component] = {}
        self.width = self.height = 0
        self.comment = b""
        if data[:2] != b"\xff\xd8":
            raise JpegError("no start of image")
        at = 2
        try:
            while True:
                while data[at + 1] == 0xFF:
                    at += 1
                marker, at = data[at + 1], at + 2
                if marker == 0xD9:
                    break
                size = int.from_bytes(data[at : at + 2], "big")
                body, at = data[at + 2 : at + size], at + size
                if marker == 0xDA:
                    end = _END_OF_SCAN.search(data, at)
                    if not end:
                        raise JpegError("a scan doesn't end")
                    self._scan(body, data[at : end.start()])
                    at = end.start()
                elif marker == 0xC2:
                    self._frame(body)
                elif marker == 0xC4:
                    self._tables(body)
                elif marker == 0xDB:
                    self._quantizers(body)
                elif marker == 0xDD:
                    self.restart = int.from_bytes(body[:2], "big")
                elif marker == 0xFE:
                    self.comment = body
                elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                    raise JpegError(f"no progressive frame: {marker:x}")
        except IndexError:
            raise JpegError("the file is cut") from None

    def _quantizers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quant[number] = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=at + 1).astype(np.int64)
            at += 1 + n

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts, symbols, code, table = body[at + 1 : at + 17], at + 17, 0, {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    table[length, code] = body[symbols]
                    code, symbols = code + 1, symbols + 1
                code <<= 1
            self.huffman[body[at]], at = table, symbols

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or not self.width or not self.height:
            raise JpegError("samples of 8 bits are read only")
        parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        self.components = {p[0]: Component(p[1] >> 4, p[1] & 15, p[2]) for p in parts}
        self.h, self.v = max(c.h for c in self.components.values()), max(c.v for c in self.components.values())
        self.units = (-(-self.width // (8 * self.h)), -(-self.height // (8 * self.v)))
        for c in self.components.values():
            c.wide, c.high = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.stride = self.units[0] * c.h
            c.blocks = np.zeros((c.stride * self.units[1] * c.v, 64), dtype=np.int32)

    def _scan(self, body: bytes, coded: bytes) -> None:
        n = body[0]
        chosen = [(self.components[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
        first, last, approximation = body[1 + 2 * n : 4 + 2 * n]
        high, low = approximation >> 4, approximation & 15
        if n == 1 and self.fast and chosen[0][0].stride == chosen[0][0].wide and len(chosen[0][0].blocks) == chosen[0][0].wide * chosen[0][0].high:
            if self._fixed(*chosen[0], first, last, high, low, coded):
                return
        self._symbols(chosen, first, last, high, low, coded)

    def _fixed(self, c: Component, tables: int, first: int, last: int, high: int, low: int, coded: bytes) -> bool:
        """Reads a scan whose layout is fixed by its table of one code, as an array. False: it isn't of that kind."""
        count = len(c.blocks)
        if first == 0 and high and not self.restart:  # one bit for each block
            bits = np.unpackbits(np.frombuffer(coded.replace(b"\xff\0", b"\xff"), dtype=np.uint8))
            if len(bits) >= count:
                c.blocks[:, 0] |= bits[:count].astype(np.int32) << low
                return True
        elif first == 0 and not high and self.restart == 1 and self.huffman.get(tables >> 4) == {(8, 0): 8}:
            if len(coded) == 4 * count - 2:
                rows = np.frombuffer(coded + b"\xff\xd0", dtype=np.uint8).reshape(-1, 4)
                if not rows[:, 0].any() and (rows[:, 2] == 0xFF).all() and (rows[:, 1] != 0xFF).all():
                    v = rows[:, 1].astype(np.int32)
                    c.blocks[:, 0] = np.where(v >= 128, v, v - 255) << low
                    return True
        elif first and not high and not self.restart and self.huffman.get(0x10 | tables & 15) == {(1, 0): 7}:
            if len(coded) == count * (last - first + 1):
                rows = np.frombuffer(coded, dtype=np.uint8).reshape(count, -1)
                if rows.max(initial=0) < 128:
                    v = rows.astype(np.int32)
                    c.blocks[:, first : last + 1] = np.where(v >= 64, v, v - 127) << low if low == 0 else np.where(v >= 64, v << low, -((127 - v) << low))
                    c.dense = bool(c.blocks[:, 1:].all()) if last == 63 else False
                    return True
        elif first == 1 and last == 63 and high and not self.restart and c.dense and self.huffman.get(0x10 | tables & 15) == {(1, 0): 0}:
            data = coded.replace(b"\xff\0", b"\xff")
            if len(data) == 8 * count:
                bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).reshape(count, 64)
                if not bits[:, 0].any():
                    c.blocks[:, 1:] += np.where(c.blocks[:, 1:] > 0, 1, -1) * (bits[:, 1:].astype(np.int32) << low)
                    return True
        return False

    def _symbols(self, chosen: list[tuple[Component, int]], first: int, last: int, high: int, low: int, coded: bytes) -> None:
        """Reads a scan of any layout, symbol by symbol."""
        if len(chosen) == 1:
            c = chosen[0][0]
            order = [[(0, (i // c.wide) * c.stride + i % c.wide)] for i in range(c.wide * c.high)]
        else:
            order = [
                [(k, (y * c.v + dy) * c.stride + x * c.h + dx) for k, (c, _) in enumerate(chosen) for dy in range(c.v) for dx in range(c.h)]
                for y in range(self.units[1])
                for x in range(self.units[0])
            ]
        pieces = [p.replace(b"\xff\0", b"\xff") for p in re.split(rb"\xff+[\xd0-\xd7]", coded)]
        step = self.restart or len(order)
        for k, piece in enumerate(pieces):
            bits, before, state = _Bits(piece), [0] * len(chosen), [0]
            for unit in order[k * step : (k + 1) * step]:
                for number, at in unit:
                    c, tables = chosen[number]
                    block = c.blocks[at]
                    if first == 0 and not high:
                        size = bits.symbol(self.huffman[tables >> 4])
                        before[number] += _extended(bits.take(size), size)
                        block[0] = before[number] << low
                    elif first == 0:
                        block[0] |= bits.take(1) << low
                    elif not high:
                        self._ac_first(bits, self.huffman[0x10 | tables & 15], block, first, last, low, state)
                    else:
                        self._ac_refine(bits, self.huffman[0x10 | tables & 15], block, first, last, low, state)
        for c, _ in chosen:
            c.dense = bool(c.blocks[:, 1:].all())

    @staticmethod
    def _ac_first(bits, table, block, first, last, low, state) -> None:
        if state[0]:
            state[0] -= 1
            return
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                if k > last:
                    raise JpegError("a run leaves its band")
                value = _extended(bits.take(size), size)
                block[k] = value << low if value > 0 else -(-value << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                state[0] = (1 << run) + bits.take(run) - 1
                return

    @staticmethod
    def _ac_refine(bits, table, block, first, last, low, state) -> None:
        def correct(k: int) -> None:
            if bits.take(1):
                block[k] += (1 << low) if block[k] > 0 else -(1 << low)

        k = first
        if not state[0]:
            while k <= last:
                run, size = divmod(bits.symbol(table), 16)
                value = 0
                if size:
                    value = (1 << low) if bits.take(1) else -(1 << low)
                elif run < 15:
                    state[0] = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    if block[k]:
                        correct(k)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if value and k <= last:
                    block[k] = value
                k += 1
        if state[0]:
            for k in range(k, last + 1):
                if block[k]:
                    correct(k)
            state[0] -= 1

    def payload(self) -> bytes:
        """The bytes stored in the coefficients of a file that encode_payloads wrote."""
        if not self.comment.startswith(_COMMENT):
            raise JpegError("no payload is stored here")
        out = np.concatenate([c.blocks for c in self.components.values()])
        data = np.where(out < 0, out + 255, out)
        data[:, 0] = out[:, 0] - 256
        if data.min(initial=0) < 0 or data.max(initial=0) > 255:
            raise JpegError("coefficients out of range")
        return data.astype(np.uint8).tobytes()[: int(self.comment[len(_COMMENT) :])]

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at full resolution: inverse transform, then chroma repeated to the size of luma."""
        out = []
        for c in self.components.values():
            samples = np.empty((len(c.blocks), 64), dtype=np.uint8)
            for k in range(0, len(samples), CHUNK_BLOCKS):
                wide = (c.blocks[k : k + CHUNK_BLOCKS] * self.quant[c.quant]).astype(np.float64) @ _INVERSE
                samples[k : k + CHUNK_BLOCKS] = np.clip(np.floor(wide / 4096 + 0.5) + 128, 0, 255)
            rows = len(c.blocks) // c.stride
            plane = samples.reshape(rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * c.stride)
            plane = plane.repeat(self.v // c.v, axis=0).repeat(self.h // c.h, axis=1)
            out.append(plane[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        """The image as a tensor (height, width, 3) of bytes, in whole-number arithmetic; gray images have equal channels."""
        planes = self.planes()
        if len(planes) != 3:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        out = np.empty((*planes[0].shape, 3), dtype=np.uint8)
        step = max(1, 64 * CHUNK_BLOCKS // self.width)
        for k in range(0, self.height, step):
            y, cb, cr = (p[k : k + step].astype(np.int32) for p in planes)
            y, cb, cr = y << 16, cb - 128, cr - 128
            for channel, x in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
                out[k : k + step, :, channel] = np.clip((x + 32768) >> 16, 0, 255)
        return out


def feature(rgb: np.ndarray) -> str:
    """Size, channel means in thousandths and a checksum of an RGB tensor, in whole numbers."""
    flat = rgb.reshape(-1, 3)
    total = flat.sum(axis=0, dtype=np.int64)
    n = len(flat)
    return f"{rgb.shape[1]}x{rgb.shape[0]} rgb={','.join(str(int(t * 1000 // n)) for t in total)} crc={zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and media, a progressive JPEG of each text as UTF-8, filled with zeros to a positive multiple of 64.

    Null and empty texts are one block of zeros. Rows that repeat give equal rows; an empty table gives no rows. No shuffle.
    Other columns are not read. A medium takes about 1.03 times its text, and an RGB tensor twice, so texts may have up to 1 GB
    where tensors are kept, as a value of Spark ends at 2 GB. A text is coded whole in one task, which takes about 12 times its bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [(t or "").encode() for t in batch.column(1).to_pylist()]
            begin, held = 0, 0
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1])
                if held >= READ_BYTES or end == len(texts):
                    own = texts[begin:end]
                    media = encode_payloads([t + bytes(max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t)) for t in own])
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), pa.array([len(t) for t in own], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    begin, held = end, 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def read_media(stored: DataFrame, keep_tensors: bool = False) -> DataFrame:
    """What the stored bytes hold: doc_id, n_bytes, payload digests, media digests and feature; with keep_tensors also rgb, height and width.

    stored: doc_id, n_bytes and media as store_texts makes them. A null medium gives nulls. A tensor is its bytes in the order
    height, width, channel, at full resolution.
    """
    kind = stored.schema["doc_id"].dataType
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    if keep_tensors:
        names += ["height", "width", "rgb"]
        types += [T.IntegerType(), T.IntegerType(), T.BinaryType()]
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), *(T.StructField(n, t) for n, t in zip(names, types))])

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(names)
        reader = Reader(media)
        payload, rgb = reader.payload(), reader.rgb()
        row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb))
        return (*row, rgb.shape[0], rgb.shape[1], rgb.tobytes()) if keep_tensors else row

    def run(batches):
        for batch in batches:
            rows, begin, held = [], 0, 0
            for end, media in enumerate(batch.column(2).to_pylist(), 1):
                rows.append(one(media))
                held += len(media or b"")
                if held >= READ_BYTES or end == batch.num_rows:
                    arrays = [pa.array(c, f) for c, f in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns[:2], *arrays], names=schema.names)
                    rows, begin, held = [], end, 0

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
