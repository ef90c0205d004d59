"""Tensors, bit packing and byte layouts (T1-T6, P1-P6, X5, the big-endian part of E2, the width class of E3)."""

from __future__ import annotations

import functools
import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the two layouts.
ROW_MAJOR, COLUMN_MAJOR = "row_major", "column_major"
#: Bits of a run of samples that is packed as one number, at most.
RUN_BITS = 56


def product(shape: Column) -> Column:
    """Number of elements of a shape; 1 for no dimensions."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x.cast("bigint"))


def tensor(shape: Column, data: Column) -> Column:
    """struct<shape, data>; an error where the data don't fill the shape (T1). Null where either is null."""
    fits = F.size(data) == product(shape)
    return F.when(shape.isNull() | data.isNull(), F.lit(None)).when(fits, F.struct(shape.alias("shape"), data.alias("data"))).otherwise(F.raise_error(F.lit("data don't fill the shape")))


def strided(shape: Column, stride: Column, data: Column) -> Column:
    """struct<shape, stride, data>; an error where ranks differ."""
    fits = F.size(shape) == F.size(stride)
    made = F.struct(shape.alias("shape"), stride.alias("stride"), data.alias("data"))
    return F.when(shape.isNull() | stride.isNull() | data.isNull(), F.lit(None)).when(fits, made).otherwise(F.raise_error(F.lit("shape and stride differ in rank")))


def ndim(shape: Column) -> Column:
    """Number of dimensions."""
    return F.size(shape)


def is_empty(shape: Column) -> Column:
    """Whether a shape holds no element."""
    return product(shape) == 0


def row_major_stride(shape: Column) -> Column:
    """Strides of a dense row-major tensor: the product of the dimensions behind each."""
    return F.transform(shape, lambda _, i: F.aggregate(F.slice(shape, i + 2, F.size(shape)), F.lit(1).cast("bigint"), lambda a, x: a * x.cast("bigint")))


def is_contiguous(shape: Column, stride: Column) -> Column:
    """Whether the strides are those of a dense row-major tensor (T5)."""
    return F.transform(stride, lambda x: x.cast("bigint")) == row_major_stride(shape)


def bit_string(samples: Column, depth: int) -> Column:
    """The lowest `depth` bits of each sample, most significant first, as a string of 0 and 1."""
    mask = F.lit(-1 if depth == 64 else (1 << depth) - 1)
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.bin(x.cast("bigint").bitwiseAND(mask)), depth, "0")), "")


def bits_to_bytes(bits: Column) -> Column:
    """Binary of a bit string, filled with zeros to whole bytes."""
    size = F.ceil(F.length(bits) / 8).cast("int")
    filled = F.rpad(bits, size * 8, "0")
    hexed = F.transform(F.sequence(F.lit(1), size), lambda i: F.lpad(F.conv(F.substr(filled, i * 8 - 7, F.lit(8)), 2, 16), 2, "0"))
    return F.when(size > 0, F.unhex(F.array_join(hexed, ""))).when(size == 0, F.lit(b""))


def bytes_to_bits(data: Column) -> Column:
    """The bits of a binary, most significant first."""
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit("(.)"), F.lit(1)), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def packed_size(count: Column, depth: int) -> Column:
    """Bytes that `count` samples of `depth` bits take (P5)."""
    return F.ceil(count * depth / 8.0).cast("bigint")


def _run(depth: int) -> int:
    """Samples that fill whole bytes together."""
    return 8 // math.gcd(8, depth)


def _pack_runs(samples: Column, depth: int) -> Column:
    """Samples packed by runs that fill whole bytes, each run as one number."""
    n, mask, count = _run(depth), (1 << depth) - 1, F.size(samples)
    part = lambda i, k: F.shiftleft(F.coalesce(F.get(samples, i * n + k).cast("bigint"), F.lit(0)).bitwiseAND(mask), (n - 1 - k) * depth)
    whole = lambda i: functools.reduce(Column.bitwiseOR, [part(i, k) for k in range(n)])
    digits = n * depth // 4
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((count - 1) / n).cast("int")), lambda i: F.lpad(F.hex(whole(i)), digits, "0")), "")
    return F.when(count > 0, F.unhex(F.substr(hexed, F.lit(1), packed_size(count, depth).cast("int") * 2))).when(count == 0, F.lit(b""))


def _unpack_runs(data: Column, depth: int, count: Column) -> Column:
    """The inverse of _pack_runs."""
    n, mask = _run(depth), (1 << depth) - 1
    size = n * depth // 8
    run = lambda i: F.conv(F.rpad(F.hex(F.substring(data, i * size + 1, F.lit(size))), 2 * size, "0"), 16, 10).cast("bigint")
    runs = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / n).cast("int")), lambda i: run(i.cast("int")))
    samples = F.flatten(F.transform(runs, lambda r: F.array(*[F.shiftright(r, (n - 1 - k) * depth).bitwiseAND(mask) for k in range(n)])))
    return F.slice(samples, F.lit(1), count.cast("int"))


def pack(samples: Column, depth: int) -> Column:
    """Samples packed at `depth` bits each, most significant first, the last byte filled with zeros (P1, P6 at depth 1).

    Higher bits of a sample are cut. Depths are 1 to 64; pack_wide takes 65 to 128. Null for null; a null sample makes null.
    Where a few samples fill whole bytes of one number they are shifted together, else they are joined as bits.
    """
    if not 1 <= depth <= 64:
        raise ValueError("depth must be 1 to 64")
    packed = _pack_runs(samples, depth) if _run(depth) * depth <= RUN_BITS else bits_to_bytes(bit_string(samples, depth))
    return F.when(F.forall(samples, lambda x: x.isNotNull()), packed)


def unpack(data: Column, depth: int, count: Column) -> Column:
    """The inverse of pack: array<bigint> up to 63 bits, array<decimal(20,0)> at 64."""
    if not 1 <= depth <= 64:
        raise ValueError("depth must be 1 to 64")
    if _run(depth) * depth <= RUN_BITS:
        read = _unpack_runs(data, depth, count)
    else:
        bits = bytes_to_bits(data)
        read = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: F.conv(F.substr(bits, (i - 1) * depth + 1, F.lit(depth)), 2, 10).cast("bigint" if depth < 64 else "decimal(20,0)"))
    return F.when(count > 0, read).when(count == 0, F.array().cast("array<bigint>" if depth < 64 else "array<decimal(20,0)>"))


#: Carriers of unpacked samples: their bits and the type that holds all their values.
CARRIERS = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)", 128: "decimal(38,0)"}


def carrier_bits(depth: int) -> int:
    """The least carrier that holds a depth."""
    return next(bits for bits in CARRIERS if depth <= bits)


def unpack_to(data: Column, depth: int, count: Column, carrier: int | None = None) -> Column:
    """Samples as an array of a carrier's type, by default the least one.

    An error where the depth is beyond the carrier. Samples above 64 bits are decimals; one that needs more than 38 digits,
    which takes at least 127 bits, is an error.
    """
    carrier = carrier or carrier_bits(depth)
    if depth > carrier or carrier not in CARRIERS:
        raise ValueError(f"samples of {depth} bits don't fit a carrier of {carrier}")
    if depth <= 64:
        return unpack(data, depth, count).cast(f"array<{CARRIERS[carrier]}>")
    bits = bytes_to_bits(data)
    half = lambda i, at, n: F.conv(F.substr(bits, (i - 1) * depth + at, F.lit(n)), 2, 10).cast("decimal(38,0)")
    high = depth - 60
    joined = lambda i: (half(i, 1, high) * F.lit(1 << 60).cast("decimal(19,0)")).cast("decimal(38,0)") + half(i, 1 + high, 60)
    if high <= 64:
        read = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: joined(i).cast("decimal(38,0)"))
    else:
        top = lambda i: (half(i, 1, high - 60) * F.lit(1 << 60).cast("decimal(19,0)")).cast("decimal(38,0)") + half(i, 1 + high - 60, 60)
        read = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: ((top(i) * F.lit(1 << 60).cast("decimal(19,0)")).cast("decimal(38,0)") + half(i, 1 + high, 60)).cast("decimal(38,0)"))
    return F.when(count > 0, read).when(count == 0, F.array().cast("array<decimal(38,0)>"))


def pack_wide(samples: Column, depth: int) -> Column:
    """pack for samples of 16 big-endian bytes each, at depths up to 128."""
    if not 1 <= depth <= 128:
        raise ValueError("depth must be 1 to 128")
    return bits_to_bytes(F.array_join(F.transform(samples, lambda x: F.right(F.lpad(bytes_to_bits(x), 128, "0"), F.lit(depth))), ""))


def unpack_wide(data: Column, depth: int, count: Column) -> Column:
    """The inverse of pack_wide: samples of 16 bytes."""
    bits = bytes_to_bits(data)
    return F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: bits_to_bytes(F.lpad(F.substr(bits, (i - 1) * depth + 1, F.lit(depth)), 128, "0")))


def big_endian_hex(value: Column, width: int) -> Column:
    """Upper-case hex of the lowest `width` bytes, two's complement, most significant first."""
    return F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * width)) if width <= 8 else F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")


def big_endian(value: Column, width: int) -> Column:
    """Big-endian bytes of a whole number."""
    return F.unhex(big_endian_hex(value, width))


def from_big_endian(data: Column, signed: bool = False) -> Column:
    """The whole number in at most 8 big-endian bytes; unsigned ones of 8 bytes as decimal."""
    unsigned = F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")
    if not signed:
        return unsigned
    span = F.pow(F.lit(2.0), F.octet_length(data) * 8).cast("decimal(20,0)")
    return F.when(unsigned >= span / 2, unsigned - span).otherwise(unsigned).cast("bigint")


def width_class(value: Column, signed: bool = False) -> Column:
    """log2 of the least of 8, 16, 32, 64 and 128 bits that hold a whole number: 3 to 7 (E3 as a statistic).

    Unsigned numbers below 0 have none; signed ones are in two's complement. BIGINT and decimals are taken; null for null.
    """
    out = F.when(value < 0, F.lit(None)) if not signed else F.when(value.isNull(), F.lit(None))
    for width in range(3, 8):
        bits = 1 << width
        if not signed:
            fits = value < _whole(1 << bits) if width < 7 else value.isNotNull()
        else:
            fits = value.between(_whole(-(1 << bits - 1)), _whole((1 << bits - 1) - 1)) if width < 7 else value.isNotNull()
        out = out.when(fits, width)
    return out.cast("int")


def _whole(number: int) -> Column:
    """A whole number as BIGINT, or as a decimal where it needs more."""
    return F.lit(number) if -(2**63) <= number < 2**63 else F.lit(Decimal(number))


def sample_count(samples: Column) -> Column:
    """Number of unpacked samples."""
    return F.size(samples)


def no_samples(samples: Column) -> Column:
    """Whether there is no unpacked sample."""
    return F.size(samples) == 0
