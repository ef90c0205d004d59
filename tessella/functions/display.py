"""Display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import lunar
from tessella.functions.algorithms import ALGORITHMS

UNITS = ("KB", "MB", "GB", "TB", "PB")


def grouped_number(n: Column) -> Column:
    """A whole number with blanks between groups of three digits."""
    return F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(\d{3})+$)", " ")


def _in_units(n: Column, shift: int, places: int) -> Column:
    """n / 2**shift with so many decimals. Ties go to the even digit, as printf and Rust round; format_string would take them up."""
    scale, mask = 10**places, (1 << shift) - 1
    scaled = n.bitwiseAND(mask) * scale
    below, rest = F.shiftright(scaled, shift), scaled.bitwiseAND(mask)
    half = 1 << shift - 1
    up = (rest > half) | ((rest == half) & (below % 2 == 1))
    total = F.shiftright(n, shift) * scale + below + up.cast("bigint")
    return F.concat(F.call_function("div", total, F.lit(scale)).cast("string"), F.lit("."), F.lpad((total % scale).cast("string"), places, "0"))


def byte_size(n: Column) -> Column:
    """A size in units of 1024 with four digits; below 1024 as it is."""
    n = n.cast("bigint")
    out = F.concat(n.cast("string"), F.lit(" Bytes"))
    for i, unit in enumerate(UNITS, 1):
        one = 1 << 10 * i
        digits = F.when(n >= 100 * one, _in_units(n, 10 * i, 1)).when(n >= 10 * one, _in_units(n, 10 * i, 2)).otherwise(_in_units(n, 10 * i, 3))
        out = F.when(n >= one, F.concat(digits, F.lit(f" {unit}"))).otherwise(out)
    return out


def hex_preview(data: Column, size: int = 4) -> Column:
    """The first bytes in upper-case hex, with dots where there are more."""
    return F.concat(F.hex(F.substring(data, 1, size)), F.when(F.octet_length(data) > size, "...").otherwise(""))


def short_text(text: Column, most: int = 30) -> Column:
    """A text of more than `most` characters cut to three fewer, and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def shape_text(shape: Column) -> Column:
    """Dimensions with signs between."""
    return F.array_join(F.transform(shape, lambda d: grouped_number(d)), " × ")


def format_value(kind: str, value: Column) -> Column:
    """A value as a line shows it, by its kind (C9). Null for null.

    whole; float (4 decimals), double (8); text; packed: struct<bit_depth, shape, data>; tensor: struct<shape, data> of
    bytes; time: a timestamp; position: struct<lat, lon>; code: struct<kind, id, bytes> with an algorithm of the registry,
    as digests, signatures, keys and wrapped bytes. Other kinds are their text.
    """
    if kind == "float":
        return F.when(value.isNotNull(), F.format_string("%.4f", value))
    if kind == "double":
        return F.when(value.isNotNull(), F.format_string("%.8f", value))
    if kind in ("packed", "tensor"):
        depth = value["bit_depth"].cast("string") if kind == "packed" else F.lit("8")
        size = grouped_number(F.octet_length(value["data"]))
        return F.concat(shape_text(value["shape"]), F.lit(", "), depth, F.lit("-bit packed tensor (" if kind == "packed" else "-bit tensor ("), size, F.lit(" Bytes)"))
    if kind == "time":
        return lunar.display(value)
    if kind == "position":
        part = lambda x, plus, minus: F.concat(F.format_string("%.4f", F.abs(x)), F.lit("°"), F.when(x < 0, minus).otherwise(plus))
        return F.concat(F.lit("("), part(value["lat"], "N", "S"), F.lit(", "), part(value["lon"], "E", "W"), F.lit(")"))
    if kind == "code":
        data = value["bytes"]
        head = F.concat(value["kind"], F.lit("["), F.coalesce(_name(value["kind"], value["id"]), F.lit("unknown")), F.lit(" "), F.octet_length(data).cast("string"), F.lit(" Bytes] "))
        return F.concat(head, F.hex(F.substring(data, 1, 4)), F.when(value["kind"] == "wrap", "").otherwise("..."))
    return value.cast("string")


def _name(kind: Column, id_: Column) -> Column:
    """Name of an algorithm of the registry."""
    out = F.when(F.lit(False), F.lit(""))
    for k, i, name, _ in ALGORITHMS:
        out = out.when((kind == k) & (id_ == i), name)
    return out


def short_value(kind: str, value: Column) -> Column:
    """format_value for a list: long texts are cut."""
    return short_text(value) if kind == "text" else format_value(kind, value)
