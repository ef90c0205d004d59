"""Capture records: rules, groups, rows of fields and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import bits
from tessella.operators.lookup import normal

# The fields of a capture record in their order, with type and rule.
FIELDS = (
    ("cfa_pattern", "array<string>", "cfa"), ("black_level", "float", ">=0"), ("white_level", "float", ">0"),
    ("dark_frame_hash", "struct<algo:string,bytes:binary>", "hash"), ("flat_field_hash", "struct<algo:string,bytes:binary>", "hash"),
    ("bias_frame_hash", "struct<algo:string,bytes:binary>", "hash"), ("vignette_correction_hash", "struct<algo:string,bytes:binary>", "hash"),
    ("distortion_correction_hash", "struct<algo:string,bytes:binary>", "hash"), ("magic_9", "array<float>", "nine"),
    ("camera_make", "string", "text"), ("camera_model", "string", "text"), ("camera_serial", "string", "text"),
    ("iso_speed", "float", ">0"), ("shutter_time_s", "float", ">0"), ("aperture_f_number", "float", ">0"), ("focal_length_m", "float", ">0"),
    ("exposure_compensation", "float", "any"), ("focus_distance_m", "float", ">=0"), ("flash_fired", "boolean", "any"), ("metering_mode", "string", "text"),
    ("lens_make", "string", "text"), ("lens_model", "string", "text"), ("lens_serial", "string", "text"),
    ("lens_min_focal_m", "float", ">0"), ("lens_max_focal_m", "float", ">0"), ("lens_min_aperture", "float", ">0"), ("lens_max_aperture", "float", ">0"),
)
GROUPS = {"raw": [f[0] for f in FIELDS[:9]], "camera": [f[0] for f in FIELDS[9:20]], "lens": [f[0] for f in FIELDS[20:]]}
CFA_LETTERS = ("R", "G", "B", "C", "Y", "W", "E")
HASH_ALGORITHMS = ("BLAKE3", "SHA-256", "SHA-512")
#: Records whose rows of fields are sorted together by one task, on average.
DEALT_RECORDS = 20_000


def breaks_rule(value: Column, rule: str) -> Column:
    """Whether a value that is there breaks a rule; null values break none. NaN is no number above or below, so it breaks the number rules."""
    if rule == ">=0":
        bad = F.isnan(value.cast("double")) | (value < 0)
    elif rule == ">0":
        bad = F.isnan(value.cast("double")) | (value <= 0)
    elif rule == "text":
        bad = F.length(value) == 0
    elif rule == "cfa":
        bad = (F.size(value) == 0) | ~F.forall(value, lambda x: F.coalesce(x.isin(*CFA_LETTERS), F.lit(False)))
    elif rule == "hash":
        bad = F.coalesce(F.octet_length(value["bytes"]), F.lit(0)).eqNullSafe(0) | ~F.coalesce(value["algo"].isin(*HASH_ALGORITHMS), F.lit(False))
    elif rule == "nine":
        bad = F.size(value) != 9
    else:
        bad = F.lit(False)
    return value.isNotNull() & F.coalesce(bad, F.lit(False))


def violations(df: DataFrame, fields: dict[str, str] | None = None) -> Column:
    """Names of the fields that break their rules, in record order (B1). fields: column to rule; by default those of FIELDS that df has."""
    rules = fields or {name: rule for name, _, rule in FIELDS if name in df.columns}
    return F.array_compact(F.array(*[F.when(breaks_rule(F.col(name), rule), F.lit(name)) for name, rule in rules.items()]))


def group(*fields: str) -> Column:
    """A struct of the fields, or null where none of them is there (B2)."""
    return F.when(F.array_contains(F.array(*[F.col(f).isNotNull() for f in fields]), True), F.struct(*fields))


def dealt(df: DataFrame, key: str, most: int = DEALT_RECORDS) -> DataFrame:
    """df in partitions of about `most` records by key, and in one for each core at least.

    from_fields and parse_raw_image sort a record's rows by its key, and a record makes as many rows as it has fields. Where
    records are dealt before to_fields, no rows are exchanged behind it, and a task's sort doesn't grow with files or tables.
    The records are counted when this is called.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most)), key)


def to_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, ordinal, name, value as text) of the columns that aren't null, in the order of `columns`; lists and structs as JSON."""
    text = {c: F.to_json(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c).cast("string") for c in columns}
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("name"), text[c].alias("value")) for i, c in enumerate(columns)])
    return df.select(key, F.inline(rows)).filter("value IS NOT NULL")


def _typed(value: Column, kind: str) -> tuple[Column, Column]:
    """A text as a value of a type, null where it is none, and whether it is none; lists and structs are JSON."""
    if kind.startswith(("array<", "struct<", "map<")):
        read = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), f"struct<v:{kind},_corrupt_record:string>", {"columnNameOfCorruptRecord": "_corrupt_record"})
        bad = read["_corrupt_record"].isNotNull() | read["v"].isNull()
        return F.when(~bad, read["v"]), value.isNotNull() & bad
    typed = value.try_cast(kind)
    return typed, value.isNotNull() & typed.isNull()


def _settled(rows: DataFrame, mode: str, corrupt: str, reasons: Column) -> DataFrame:
    """Rows with their reasons as a column, or an error where there are any."""
    if mode == "PERMISSIVE":
        return rows.withColumn(corrupt, reasons)
    if mode != "FAILFAST":
        raise ValueError("a mode is PERMISSIVE or FAILFAST")
    return rows.filter(F.when(F.size(reasons) > 0, F.raise_error(F.concat_ws(", ", reasons)).cast("boolean")).otherwise(True))


def _parsed(fields: DataFrame, key: str, schema: dict[str, str], wanted: Column) -> DataFrame:
    """A column for each name of the schema, and _reasons: those of values that end early (null) or have a wrong type."""
    last = [F.max(F.when(wanted & (normal(F.col("name")) == normal(F.lit(name))), F.struct("ordinal", "value"))).alias(name) for name in schema]
    rows, values, reasons = fields.groupBy(key).agg(*last), [], []
    for name, kind in schema.items():
        value, bad = _typed(F.col(name)["value"], kind)
        values.append(value.alias(name))
        early = F.col(name).isNotNull() & F.col(name)["value"].isNull()
        reasons.append(F.when(early, f"{name}: end of data").when(bad, f"{name}: invalid data"))
    return rows.select(key, *values, F.array_compact(F.array(*reasons)).alias("_reasons"))


def from_fields(fields: DataFrame, key: str, schema: dict[str, str], mode: str = "PERMISSIVE", corrupt: str | None = None) -> DataFrame:
    """One row for each key from rows (key, ordinal, name, value): the last value of each name, cast to its type.

    Unknown names are left out. Values that end early or have a wrong type are null, and `corrupt` names a column for the list of
    their reasons; with mode FAILFAST they are an error. One grouped maximum for each column, counted map-side.
    """
    rows = _parsed(fields, key, schema, F.lit(True))
    reasons = F.col("_reasons")
    return (rows if mode == "PERMISSIVE" and corrupt is None else _settled(rows, mode, corrupt, reasons)).drop("_reasons")


IMAGE = "struct<bit_depth:smallint,shape:array<bigint>,data:binary>"


def parse_raw_image(fields: DataFrame, key: str, mode: str = "FAILFAST", corrupt: str = "_corrupt") -> DataFrame:
    """key, image and the groups raw, camera and lens of each capture, from all fields of the record.

    fields: key, ordinal, name, value, and section where a file has several; then those of section raw count. Errors are a value that
    ends early or has a wrong type, one that breaks its rule, and an image that is missing; with mode PERMISSIVE `corrupt` lists them.
    """
    wanted = F.coalesce(F.col("section") == "raw", F.lit(False)) if "section" in fields.columns else F.lit(True)
    schema = {"image": IMAGE} | {name: kind for name, kind, _ in FIELDS}
    rows = _parsed(fields, key, schema, wanted)
    told = F.exists("_reasons", lambda r: r.startswith("image: "))
    missing = F.when(F.col("image").isNull() & ~told, F.array(F.lit("image: missing"))).otherwise(F.array().cast("array<string>"))
    broken = F.transform(violations(rows), lambda n: F.concat(n, F.lit(": breaks its rule")))
    rows = rows.select(key, "image", *[group(*names).alias(g) for g, names in GROUPS.items()], F.concat("_reasons", missing, broken).alias("_reasons"))
    return _settled(rows, mode, corrupt, F.col("_reasons")).drop("_reasons")


def raw_image(depth: int, shape: Column, samples: Column) -> Column:
    """struct<bit_depth, shape, data> of samples packed at a depth; an error where they don't fill the shape."""
    checked = bits.tensor(shape, samples)
    return F.struct(F.lit(depth).cast("smallint").alias("bit_depth"), checked["shape"].alias("shape"), bits.pack(checked["data"], depth).alias("data"))


def standard_capture(samples: Column, iso: Column, shutter: Column, shape: tuple[int, int] = (4096, 3072)) -> dict[str, Column]:
    """Columns of the 12-bit preset: RGGB, levels 64 and 4095, no flash."""
    return {
        "image": raw_image(12, F.array(*[F.lit(n).cast("bigint") for n in shape]), samples),
        "cfa_pattern": F.array(*[F.lit(c) for c in "RGGB"]), "black_level": F.lit(64.0).cast("float"), "white_level": F.lit(4095.0).cast("float"),
        "iso_speed": iso.cast("float"), "shutter_time_s": shutter.cast("float"), "flash_fired": F.lit(False),
    }


def geotagged_photo(width: Column, height: Column, rgb: Column, lat: Column, lon: Column) -> Column:
    """struct<image, location>: a tensor [width, height, 3] and a position; an error where the data don't fill it."""
    shape = F.array(width.cast("bigint"), height.cast("bigint"), F.lit(3).cast("bigint"))
    return F.struct(bits.tensor(shape, rgb).alias("image"), F.struct(lat.alias("lat"), lon.alias("lon")).alias("location"))
