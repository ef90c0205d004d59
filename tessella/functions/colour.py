"""Colour formats, greys and gamma 2 (K1-K7, K9). Channels are struct<r, g, b, a> of ints 0 to 255.

Formats: grey8, grey16, greyf, rgb676, rgb565, rgb8, rgb16, rgbf, rgba8, rgba16, rgbaf; a colour is its array of channels.
Gamma has one direction here: encoding to bytes takes the square root of linear light, decoding squares it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("grey8", "grey16", "greyf", "rgb676", "rgb565", "rgb8", "rgb16", "rgbf", "rgba8", "rgba16", "rgbaf")

# The named colours as red, green, blue.
NAMED = {
    "black": (0, 0, 0), "white": (255, 255, 255), "grey": (128, 128, 128), "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255),
    "cyan": (0, 255, 255), "magenta": (255, 0, 255), "yellow": (255, 255, 0), "orange": (255, 128, 0), "lime": (128, 255, 0), "aqua": (0, 255, 128), "violet": (128, 0, 255),
}


def _cut(x: Column, most: int) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(0)).cast("int")


def encode_gamma(linear: Column, most: int = 255) -> Column:
    """Linear light 0 to 1 as a whole number 0 to most: the square root, rounded (K9). NaN counts as 0."""
    return _cut(F.round(F.sqrt(F.greatest(F.nanvl(linear, F.lit(0.0)), F.lit(0.0))) * most), most)


def decode_gamma(value: Column, most: int = 255) -> Column:
    """The inverse of encode_gamma (K9)."""
    return F.pow(value / most, F.lit(2.0))


def linear_byte(linear: Column) -> Column:
    """floor(256 * sqrt(x)), saturated: the byte of a float channel (K1)."""
    return _cut(F.floor(F.sqrt(F.greatest(F.nanvl(linear, F.lit(0.0)), F.lit(0.0))) * 256), 255)


def grey8(r: Column, g: Column, b: Column) -> Column:
    """(30 r + 59 g + 11 b) div 100 (K7)."""
    return F.floor((r * 30 + g * 59 + b * 11) / 100).cast("int")


def pack565(r: Column, g: Column, b: Column) -> Column:
    """5, 6 and 5 leading bits in one number (K6)."""
    return F.shiftleft(F.shiftright(r, 3), 11).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3)).cast("int")


def unpack565(packed: Column) -> Column:
    """struct<r, g, b, a> of a 5-6-5 number; low bits repeat the high ones (K6)."""
    r, g, b = F.shiftright(packed, 11).bitwiseAND(31), F.shiftright(packed, 5).bitwiseAND(63), packed.bitwiseAND(31)
    wide = [F.shiftleft(r, 3).bitwiseOR(F.shiftright(r, 2)), F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4)), F.shiftleft(b, 3).bitwiseOR(F.shiftright(b, 2))]
    return _channels(*wide, F.lit(255))


def pack676(r: Column, g: Column, b: Column) -> Column:
    """6 x 7 x 6 levels in one byte, 0 to 251; the nearest levels, so unpacking and packing again changes nothing (K6)."""
    level = lambda x, most: F.floor((x * (2 * most) + 255) / 510)
    return ((level(r, 5) * 7 + level(g, 6)) * 6 + level(b, 5)).cast("int")


def unpack676(packed: Column) -> Column:
    """struct<r, g, b, a> of a 6 x 7 x 6 byte (K6)."""
    b, rest = packed % 6, F.floor(packed / 6)
    g, r = rest % 7, F.floor(rest / 7)
    return _channels(F.floor(r * 255 / 5), F.floor(g * 255 / 6), F.floor(b * 255 / 5), F.lit(255))


def _channels(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), a.cast("int").alias("a"))


def named(name: Column) -> Column:
    """Channels of a named colour; null for other names (K1)."""
    out = None
    for key, (r, g, b) in NAMED.items():
        value = _channels(F.lit(r), F.lit(g), F.lit(b), F.lit(255))
        out = F.when(name == key, value) if out is None else out.when(name == key, value)
    return out


def to_rgba8(fmt: str, channels: Column) -> Column:
    """struct<r, g, b, a> of a colour in a format; alpha is 255 where the format has none (K1, K2).

    16-bit channels keep their high byte, float channels are linear light, float alpha is a share of 255.
    """
    c = [F.get(channels, F.lit(i)) for i in range(4)]
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    if fmt == "rgb565":
        return unpack565(c[0].cast("int"))
    if fmt == "rgb676":
        return unpack676(c[0].cast("int"))
    read = linear_byte if fmt.endswith("f") else (lambda x: F.shiftright(x.cast("int"), 8)) if fmt.endswith("16") else (lambda x: x.cast("int"))
    if fmt.startswith("grey"):
        return _channels(read(c[0]), read(c[0]), read(c[0]), F.lit(255))
    alpha = F.lit(255) if not fmt.startswith("rgba") else _cut(F.round(c[3] * 255), 255) if fmt.endswith("f") else read(c[3])
    return _channels(read(c[0]), read(c[1]), read(c[2]), alpha)


def to_grey8(fmt: str, channels: Column) -> Column:
    """One grey byte of a colour; grey formats directly, others by grey8 (K3)."""
    rgba = to_rgba8(fmt, channels)
    return rgba["r"] if fmt.startswith("grey") else grey8(rgba["r"], rgba["g"], rgba["b"])


def from_rgba8(rgba: Column, fmt: str) -> Column:
    """The array of channels of a colour in a format (K4): whole numbers, or doubles for float formats."""
    r, g, b, a = (rgba[x] for x in "rgba")
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    if fmt == "rgb565":
        return F.array(pack565(r, g, b))
    if fmt == "rgb676":
        return F.array(pack676(r, g, b))
    wide = (lambda x: decode_gamma(x)) if fmt.endswith("f") else (lambda x: x * 257) if fmt.endswith("16") else (lambda x: x)
    if fmt.startswith("grey"):
        return F.array(wide(grey8(r, g, b)))
    values = [wide(r), wide(g), wide(b)]
    if fmt.startswith("rgba"):
        values.append(a / 255 if fmt.endswith("f") else wide(a))
    return F.array(*values)


def convert(fmt: str, channels: Column, target: str) -> Column:
    """A colour of one format in another, by way of 8-bit channels, so wider ones lose their low bits (K5)."""
    return from_rgba8(to_rgba8(fmt, channels), target)
