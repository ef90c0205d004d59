
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import bits, colour, display, geo, lunar, matrix, names
from tessella.operators import codes, integrity, lookup, records
from tessella.sources import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each order in line order; ties by quantity. An order's lines are few, so its list is small."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_returnflag") == "R").cast("bigint").alias("returned"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q", "returned"))).alias("items"))


# The flagship. One shuffle, by order key.
_BITS = "string_agg(right(lpad(bin({x}), 64, '0'), {d}), '' ORDER BY l_linenumber, l_quantity::BIGINT, (l_returnflag = 'R')::BIGINT)"
_HEX = "array_to_string(list_transform(range(0, (len({b}) + 7) // 8), lambda i: printf('%02X', CAST(('0b' || substr(rpad({b}, ((len({b}) + 7) // 8 * 8)::INT, '0'), (i * 8 + 1)::INT, 8)) AS INTEGER))), '')"


@query(f"""
WITH b AS (SELECT l_orderkey, count(*) AS n, {_BITS.format(x="l_quantity::BIGINT", d=6)} AS bits FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n::INTEGER AS n, {_HEX.format(b="bits")} AS packed, ceil(n * 6 / 8.0)::BIGINT AS bytes FROM b
""")
def pack_quantity(spark, sf_dir):
    data = F.transform("items", lambda x: x["q"])
    rows = _by_order(spark, sf_dir)
    return rows.select("l_orderkey", F.size("items").alias("n"), F.hex(bits.pack(data, 6)).alias("packed"), bits.packed_size(F.size("items"), 6).alias("bytes"))


# Back to the quantities.
@query("""
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag = 'R') - 1)::INTEGER AS pos, l_quantity::BIGINT AS q FROM lineitem
""")
def unpack_quantity(spark, sf_dir):
    rows = _by_order(spark, sf_dir).select("l_orderkey", F.size("items").alias("n"), bits.pack(F.transform("items", lambda x: x["q"]), 6).alias("packed"))
    return rows.select("l_orderkey", F.posexplode(bits.unpack(F.col("packed"), 6, F.col("n"))).alias("pos", "q"))


# Samples in the least carrier, and in one of 64 bits.
@query("""
SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS total8, sum(l_quantity::BIGINT)::BIGINT AS total64, count(*)::INTEGER AS n, max(l_quantity::BIGINT)::BIGINT AS most FROM lineitem GROUP BY l_orderkey
""")
def unpack_carriers(spark, sf_dir):
    rows = _by_order(spark, sf_dir).select("l_orderkey", F.size("items").alias("n"), bits.pack(F.transform("items", lambda x: x["q"]), 7).alias("packed"))
    rows = rows.withColumn("s8", bits.unpack_to(F.col("packed"), 7, F.col("n"))).withColumn("s64", bits.unpack_to(F.col("packed"), 7, F.col("n"), 64))
    total = lambda c, kind: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind)).cast("bigint")
    return rows.select("l_orderkey", total("s8", "bigint").alias("total8"), total("s64", "decimal(38,0)").alias("total64"), F.size("s64").alias("n"), F.array_max("s8").cast("bigint").alias("most"))


# Flags as bits.
@query(f"""
WITH b AS (SELECT l_orderkey, {_BITS.format(x="(l_returnflag = 'R')::BIGINT", d=1)} AS bits FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, {_HEX.format(b="bits")} AS packed FROM b
""")
def bool_pack_flags(spark, sf_dir):
    return _by_order(spark, sf_dir).select("l_orderkey", F.hex(bits.pack(F.transform("items", lambda x: x["returned"]), 1)).alias("packed"))


# Shapes of the embeddings as [8, 8], some with a padded row.
@query("""
SELECT vec_id, 2 AS ndim, len(embedding)::BIGINT AS len, len(embedding) = 0 AS empty, list_reverse([1, side + vec_id % 2]) = [side, 1] AS contiguous, vec_id % 2 = 1 AND side = 0 AS transposed_contiguous,
  CASE WHEN vec_id % 2 = 0 THEN 'row_major' ELSE 'column_major' END AS layout FROM (SELECT *, floor(sqrt(len(embedding)))::BIGINT AS side FROM embeddings)
""")
def tensor_shape(spark, sf_dir):
    side = F.floor(F.sqrt(F.size("embedding"))).cast("bigint")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array(side, side).alias("shape"), side.alias("side"))
    rows = rows.withColumn("t", bits.tensor(F.col("shape"), F.col("embedding")))
    one = F.lit(1).cast("bigint")
    row = bits.strided(F.col("shape"), F.array(F.col("side") + F.col("vec_id") % 2, one), F.col("embedding"))
    rows = rows.withColumn("contiguous", bits.is_contiguous(row["shape"], row["stride"]))
    return rows.select(
        "vec_id", bits.ndim(F.col("t.shape")).alias("ndim"), bits.product(F.col("t.shape")).alias("len"), bits.is_empty(F.col("t.shape")).alias("empty"), "contiguous",
        bits.is_contiguous(F.col("shape"), F.array(one, F.col("side"))).alias("transposed_contiguous"), F.when(F.col("contiguous"), bits.ROW_MAJOR).otherwise(bits.COLUMN_MAJOR).alias("layout"),
    )


# E3 as a statistic, and its counts.
@query("""
SELECT c AS width, count(*) AS n, sum(8 * (1 << (c - 3)) // 8)::BIGINT AS bytes FROM (
  SELECT CASE WHEN v < 256 THEN 3 WHEN v < 65536 THEN 4 WHEN v < 4294967296 THEN 5 ELSE 6 END AS c FROM (
    SELECT l_orderkey AS v FROM lineitem UNION ALL SELECT floor(o_totalprice * 100)::BIGINT FROM orders)) GROUP BY c
""")
def width_class(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("v"))
    prices = table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") * 100).alias("v"))
    classes = keys.unionByName(prices).groupBy(bits.width_class(F.col("v")).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    return classes.withColumn("bytes", F.col("n") * F.expr("shiftleft(1, width - 3)"))


# E2's bytes.
@query("SELECT l_orderkey, l_linenumber, lpad(printf('%X', l_orderkey), 8, '0') AS be4, lpad(printf('%X', l_orderkey), 16, '0') AS be8, l_orderkey::BIGINT AS back FROM lineitem")
def be_hex(spark, sf_dir):
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", bits.big_endian_hex(key, 4).alias("be4"), bits.big_endian_hex(key, 8).alias("be8"), bits.from_big_endian(bits.big_endian(key, 8), signed=True).alias("back")
    )


# TM1, TM3.
@query("SELECT event_id, ((epoch_us(ts) + 14182940000000) // 1000000)::DOUBLE AS lunar_seconds, epoch_us(ts) + 14182940000000 AS lunar_micros FROM events")
def lunar_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", lunar.to_seconds(F.col("ts")).alias("lunar_seconds"), lunar.to_micros(F.col("ts")).alias("lunar_micros"))


# TM2: to whole seconds and back.
@query("SELECT event_id, epoch_us(date_trunc('second', ts)) AS back_micros FROM events")
def lunar_roundtrip(spark, sf_dir):
    back = lunar.to_timestamp(lunar.to_seconds(F.col("ts")))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(back).alias("back_micros"))


# TM4.
@query("SELECT event_id, upper(strftime(ts, '%Y-%b-%d ')) || ltrim(strftime(ts, '%I'), '0') || strftime(ts, ':%M:%S.%g %p') AS shown FROM events")
def lunar_display(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", lunar.display(F.col("ts")).alias("shown"))


# G11.
@query("SELECT p_partkey, levenshtein(p_name, p_type)::INTEGER AS distance FROM part")
def edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.edit_distance(F.col("p_name"), F.col("p_type")).alias("distance"))


def _phonetic_sql(word: str) -> str:
    """The rules letter by letter in SQL, written out on their own."""
    u = f"upper({word})"
    c, p, n, m, last = f"substr({u}, i, 1)", f"(CASE WHEN i > 1 THEN substr({u}, i - 1, 1) ELSE '' END)", f"substr({u}, i + 1, 1)", f"substr({u}, i + 2, 1)", f"len({u})"
    first_or_after_vowel = f"(i = 1 OR {p} IN ('A', 'E', 'I', 'O', 'U'))"
    return f"""array_to_string(list_transform(range(1, {last} + 1), lambda i: CASE
      WHEN {c} IN ('A', 'E', 'I', 'O', 'U') THEN CASE WHEN i = 1 THEN {c} ELSE '' END
      WHEN {c} = 'B' THEN CASE WHEN {p} = 'M' AND i = {last} THEN '' ELSE 'B' END
      WHEN {c} = 'C' THEN CASE WHEN {n} = 'H' THEN 'X' WHEN {n} IN ('E', 'I', 'Y') THEN 'S' ELSE 'K' END
      WHEN {c} = 'D' THEN CASE WHEN {n} = 'G' AND {m} IN ('E', 'I', 'Y') THEN 'J' ELSE 'T' END
      WHEN {c} = 'G' THEN CASE WHEN {n} = 'H' OR ({n} = 'N' AND i = {last} - 1) THEN '' WHEN {n} IN ('E', 'I', 'Y') THEN 'J' ELSE 'K' END
      WHEN {c} = 'H' THEN CASE WHEN {first_or_after_vowel} THEN 'H' ELSE '' END
      WHEN {c} = 'K' THEN CASE WHEN {p} = 'C' THEN '' ELSE 'K' END
      WHEN {c} = 'P' THEN CASE WHEN {n} = 'H' THEN 'F' ELSE 'P' END
      WHEN {c} = 'Q' THEN 'K'
      WHEN {c} = 'S' THEN CASE WHEN {n} = 'H' OR ({n} = 'I' AND {m} IN ('A', 'O')) THEN 'X' ELSE 'S' END
      WHEN {c} = 'T' THEN CASE WHEN {n} = 'H' THEN '0' WHEN {n} = 'I' AND {m} IN ('A', 'O') THEN 'X' ELSE 'T' END
      WHEN {c} = 'V' THEN 'F' WHEN {c} = 'X' THEN 'KS' WHEN {c} = 'Z' THEN 'S'
      WHEN {c} IN ('W', 'Y') THEN CASE WHEN {first_or_after_vowel} THEN {c} ELSE '' END
      WHEN {c} IN ('F', 'J', 'L', 'M', 'N', 'R') THEN {c} ELSE '' END), '')"""


# G10.
@query(f"SELECT p_partkey, {_phonetic_sql('p_name')} AS name_key, {_phonetic_sql('p_type')} AS type_key FROM part")
def phonetic_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.phonetic_key(F.col("p_name")).alias("name_key"), names.phonetic_key(F.col("p_type")).alias("type_key"))


#: Entries for G9: names of the 25 nations of the benchmark's table, lower case.
NATIONS = (
    "algeria argentina brazil canada egypt ethiopia france germany india indonesia iran iraq japan jordan kenya morocco mozambique peru china romania russia vietnam britain america arabia".split()
)


# For each word of the parts' names.
@query(f"""
WITH d AS (SELECT unnest({NATIONS}) AS entry, unnest(range({len(NATIONS)})) AS ord), w AS (
  SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)), k AS (
  SELECT p_partkey, word, entry, ord, 2 * levenshtein({_phonetic_sql('lower(word)')}, {_phonetic_sql('entry')}) + levenshtein(lower(word), entry) AS score FROM w, d)
SELECT p_partkey, word, arg_min(entry, score * 100 + ord) AS nearest, min(score)::INTEGER AS score FROM k GROUP BY p_partkey, word
""")
def nearest_word(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return names.nearest_word(words, "word", NATIONS)


# N1.
@query(r"""
SELECT name, count(*) AS n, regexp_full_match(name, '[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*') AND NOT contains(name, '__') AND NOT ends_with(name, '_') AS valid FROM (
  SELECT event_type AS name FROM events UNION ALL SELECT p_name FROM part UNION ALL SELECT replace(lower(p_type), ' ', '.') FROM part) GROUP BY name
""")
def name_valid(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    all_names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).unionByName(part.select(F.col("p_name").alias("name")))
    all_names = all_names.unionByName(part.select(F.replace(F.lower("p_type"), F.lit(" "), F.lit(".")).alias("name")))
    return all_names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", names.is_valid_name(F.col("name")))


# X7, R9's check.
@query(r"""
SELECT doc_id, length(text)::INTEGER AS chars, strlen(text)::INTEGER AS bytes, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::INTEGER AS ascii_chars,
  (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')))::INTEGER AS wide_chars, strlen(text) = length(text) AS is_ascii FROM documents
""")
def text_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.text_stats(F.col("text")).alias("s"), names.is_ascii(F.col("text")).alias("is_ascii")).select("doc_id", "s.*", "is_ascii")


# The counts behind a code table.
@query("SELECT unicode(c)::BIGINT AS code, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def char_frequency(spark, sf_dir):
    return names.char_counts(table(spark, sf_dir, "documents"))


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rgba = F.struct((key % 256).cast("int").alias("r"), (key * 7 % 256).cast("int").alias("g"), (key * 31 % 256).cast("int").alias("b"), F.lit(255).alias("a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rgba.alias("c"))


_RGB = "(SELECT o_orderkey, (o_orderkey % 256)::INTEGER AS r, (o_orderkey * 7 % 256)::INTEGER AS g, (o_orderkey * 31 % 256)::INTEGER AS b FROM orders)"
_WIDE5, _WIDE6 = "((({x}) << 3) | (({x}) >> 2))", "((({x}) << 2) | (({x}) >> 4))"
_BACK565 = f"{_WIDE5.format(x='(p565 >> 11) & 31')} * 65536 + {_WIDE6.format(x='(p565 >> 5) & 63')} * 256 + {_WIDE5.format(x='p565 & 31')}"


# K4, K6, K7: 565, 676 and grey.
@query(f"""
SELECT o_orderkey, p565, ({_BACK565})::INTEGER AS back565, p676,
  ((p676 // 42 * 255 // 5) * 65536 + (p676 // 6 % 7 * 255 // 6) * 256 + p676 % 6 * 255 // 5)::INTEGER AS back676, grey FROM (
  SELECT o_orderkey, (((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3))::INTEGER AS p565,
    (((r * 10 + 255) // 510 * 7 + (g * 12 + 255) // 510) * 6 + (b * 10 + 255) // 510)::INTEGER AS p676, ((30 * r + 59 * g + 11 * b) // 100)::INTEGER AS grey FROM {_RGB})
""")
def rgb_packed(spark, sf_dir):
    one = lambda c: c["r"] * 65536 + c["g"] * 256 + c["b"]
    rows = _colours(spark, sf_dir).select(
        "o_orderkey", colour.from_rgba8(F.col("c"), "rgb565")[0].alias("p565"), colour.from_rgba8(F.col("c"), "rgb676")[0].alias("p676"), colour.from_rgba8(F.col("c"), "grey8")[0].alias("grey")
    )
    return rows.select("o_orderkey", "p565", one(colour.unpack565(F.col("p565"))).alias("back565"), "p676", one(colour.unpack676(F.col("p676"))).alias("back676"), "grey")


# K1-K3, K5: 16-bit, float and packed formats through 8-bit channels.
@query(f"""
SELECT o_orderkey, [r * 257, g * 257, b * 257] AS rgb16, (30 * r + 59 * g + 11 * b) // 100 * 257 AS grey16_of_rgb16, [r, g, b, 255] AS rgba8_of_rgb16,
  least(255, floor(sqrt(r / 255.0) * 256))::INTEGER AS red_of_float, ((30 * r + 59 * g + 11 * b) // 100)::INTEGER AS grey8_of_rgb16 FROM {_RGB}
""")
def rgb_convert(spark, sf_dir):
    rows = _colours(spark, sf_dir).withColumn("rgb16", colour.from_rgba8(F.col("c"), "rgb16"))
    return rows.select(
        "o_orderkey", "rgb16", colour.convert("rgb16", F.col("rgb16"), "grey16")[0].alias("grey16_of_rgb16"), colour.convert("rgb16", F.col("rgb16"), "rgba8").alias("rgba8_of_rgb16"),
        colour.to_rgba8("rgbf", F.array(F.col("c.r") / 255, F.col("c.g") / 255, F.col("c.b") / 255))["r"].alias("red_of_float"),
        colour.to_grey8("rgb16", F.col("rgb16")).alias("grey8_of_rgb16"),
    )


# K9.
@query(f"SELECT o_orderkey, round(pow(r / 255.0, 2), 9) AS linear8, round(sqrt(pow(r / 255.0, 2)) * 255)::INTEGER AS back8, round(pow(r * 257 / 65535.0, 2), 9) AS linear16, round(sqrt(pow(r * 257 / 65535.0, 2)) * 65535)::INTEGER AS back16 FROM {_RGB}")
def gamma(spark, sf_dir):
    r = F.col("c.r")
    return _colours(spark, sf_dir).select(
        "o_orderkey", F.round(colour.decode_gamma(r), 9).alias("linear8"), colour.encode_gamma(colour.decode_gamma(r)).alias("back8"),
        F.round(colour.decode_gamma(r * 257, 65535), 9).alias("linear16"), colour.encode_gamma(colour.decode_gamma(r * 257, 65535), 65535).alias("back16"),
    )


_M = [f"embedding[{i}]::DOUBLE" for i in range(1, 10)]
_DET = "(m[1]*(m[5]*m[9]-m[6]*m[8])-m[2]*(m[4]*m[9]-m[6]*m[7])+m[3]*(m[4]*m[8]-m[5]*m[7]))"


_ADJUGATE = ["m[5]*m[9]-m[6]*m[8]", "m[3]*m[8]-m[2]*m[9]", "m[2]*m[6]-m[3]*m[5]", "m[6]*m[7]-m[4]*m[9]", "m[1]*m[9]-m[3]*m[7]", "m[3]*m[4]-m[1]*m[6]", "m[4]*m[8]-m[5]*m[7]", "m[2]*m[7]-m[1]*m[8]", "m[1]*m[5]-m[2]*m[4]"]
_PRODUCT = [" + ".join(f"m[{3 * r + k + 1}] * inv[{3 * k + c + 1}]" for k in range(3)) for r in range(3) for c in range(3)]


# L1.
@query(f"""
SELECT vec_id, round({_DET}, 12) + 0.0 AS det, round(inv[1], 6) + 0.0 AS first, [{', '.join(f'round({x}, 3)::INTEGER' for x in _PRODUCT)}] AS identity
FROM (SELECT vec_id, m, [{', '.join(f'({x}) / {_DET}' for x in _ADJUGATE)}] AS inv FROM (SELECT vec_id, [{', '.join(_M)}] AS m FROM embeddings))
""")
def matrix_inverse(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 9).alias("m"))
    inverse = matrix.invert(F.col("m"))
    product = F.transform(matrix.multiply(F.col("m"), inverse), lambda x: F.round(x, 3).cast("int"))
    return rows.select("vec_id", (F.round(matrix.determinant(F.col("m")), 12) + 0.0).alias("det"), (F.round(inverse[0], 6) + 0.0).alias("first"), product.alias("identity"))


# G1, G14.
@query("""
SELECT event_id, round(cos(radians(lat)) * cos(radians(lon)), 9) + 0.0 AS x, round(cos(radians(lat)) * sin(radians(lon)), 9) + 0.0 AS y, round(sin(radians(lat)), 9) + 0.0 AS z,
  lat AS back_lat, lon AS back_lon,
  '(' || printf('%.6f', abs(lat)) || '°' || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || ', ' || printf('%.6f', abs(lon)) || '°' || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END || ')' AS shown
FROM (SELECT event_id, (event_id * 37 % 179 - 89)::DOUBLE AS lat, (event_id * 53 % 359 - 179)::DOUBLE AS lon FROM events)
""")
def lat_lon_xyz(spark, sf_dir):
    p = _positions(spark, sf_dir).withColumn("p", geo.to_xyz(F.col("lat"), F.col("lon")))
    back = geo.to_lat_lon(F.col("p.x"), F.col("p.y"), F.col("p.z"))
    return p.select(
        "event_id", *[(F.round(f"p.{k}", 9) + 0.0).alias(k) for k in "xyz"], (F.round(back["lat"], 6) + 0.0).alias("back_lat"), (F.round(back["lon"], 6) + 0.0).alias("back_lon"),
        geo.display_position(F.col("lat"), F.col("lon")).alias("shown"),
    )


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (event * 37 % 179 - 89).cast("double").alias("lat"), (event * 53 % 359 - 179).cast("double").alias("lon"))


#: Directions off the icosahedron's edges, its faces from the golden ratio, and each direction's nearest face with the weights of its corners.
_FACES_SQL = """
p AS (SELECT event_id, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z
  FROM (SELECT event_id, event_id * 37 % 179 - 89 + 0.37::DOUBLE AS lat, event_id * 53 % 359 - 179 + 0.29::DOUBLE AS lon FROM events)),
corner AS (SELECT i, (i // 6 * 2 - 1) / n AS a, (i // 3 % 2 * 2 - 1) * g / n AS b, n FROM (SELECT unnest(range(12)) AS i, (1 + sqrt(5)) / 2 AS g, sqrt(1 + pow((1 + sqrt(5)) / 2, 2)) AS n)),
v AS (SELECT i, n, CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN a ELSE b END AS x, CASE i % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE 0 END AS y, CASE i % 3 WHEN 0 THEN b WHEN 1 THEN 0 ELSE a END AS z FROM corner),
edge AS (SELECT a.i AS a, b.i AS b FROM v a, v b WHERE a.i < b.i AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 4.01 / (a.n * a.n)),
f AS (SELECT row_number() OVER (ORDER BY a.i, b.i, c.i) - 1 AS face, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz,
    sqrt(pow(a.x + b.x + c.x, 2) + pow(a.y + b.y + c.y, 2) + pow(a.z + b.z + c.z, 2)) AS size
  FROM edge ab JOIN edge bc ON ab.b = bc.a JOIN edge ac ON ac.a = ab.a AND ac.b = bc.b JOIN v a ON a.i = ab.a JOIN v b ON b.i = ab.b JOIN v c ON c.i = bc.b),
near AS (SELECT * FROM (SELECT *, (x * (ax + bx + cx) + y * (ay + "by" + cy) + z * (az + bz + cz)) / size AS nearness FROM p, f) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY nearness DESC, face) = 1),
raw AS (SELECT *, x * ("by" * cz - bz * cy) + y * (bz * cx - bx * cz) + z * (bx * cy - "by" * cx) AS du, x * (cy * az - cz * ay) + y * (cz * ax - cx * az) + z * (cx * ay - cy * ax) AS dv,
    x * (ay * bz - az * "by") + y * (az * bx - ax * bz) + z * (ax * "by" - ay * bx) AS dw FROM near),
w AS (SELECT *, du / (du + dv + dw) AS u, dv / (du + dv + dw) AS v, dw / (du + dv + dw) AS w FROM raw)
"""


def _off_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("event_id", (F.col("lat") + 0.37).alias("lat"), (F.col("lon") + 0.29).alias("lon"))


# G2, G3.
@query(f"WITH {_FACES_SQL} SELECT event_id, face::INTEGER AS face, round(nearness, 9) AS nearness, round(u, 9) + 0.0 AS u, round(v, 9) + 0.0 AS v, round(w, 9) + 0.0 AS w FROM w")
def closest_face(spark, sf_dir):
    at = geo.to_xyz(F.col("lat"), F.col("lon"))
    p = _off_edges(spark, sf_dir).select("event_id", *[at[k].alias(k) for k in "xyz"])
    p = p.withColumn("dots", geo.face_dots(F.col("x"), F.col("y"), F.col("z"))).withColumn("face", geo.nearest_face(F.col("dots")))
    b = geo.shares(geo.weights_on(F.col("x"), F.col("y"), F.col("z"), F.col("face")))
    return p.select("event_id", "face", F.round(F.array_max("dots"), 9).alias("nearness"), *[(F.round(b[k], 9) + 0.0).alias(k) for k in "uvw"])


# B1: parts in the role of captures.
@query("""
SELECT p_partkey, list_filter([CASE WHEN iso <= 0 THEN 'iso_speed' END, CASE WHEN black < 0 THEN 'black_level' END, CASE WHEN make = '' THEN 'camera_make' END,
  CASE WHEN len(list_filter(string_split(cfa, ''), lambda c: c NOT IN ('R', 'G', 'B', 'C', 'Y', 'W', 'E'))) > 0 OR cfa = '' THEN 'cfa_pattern' END], lambda v: v IS NOT NULL) AS broken
FROM (SELECT p_partkey, p_size - 5 AS iso, p_retailprice - 950 AS black, substr(p_brand, 1, (p_partkey % 5)::INT) AS make, upper(substr(p_name, 1, 2)) AS cfa FROM part)
""")
def validate_capture(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") - 5).alias("iso_speed"), (F.col("p_retailprice") - 950).alias("black_level"),
        F.substr("p_brand", F.lit(1), (F.col("p_partkey") % 5).cast("int")).alias("camera_make"),
        F.array_remove(F.split(F.upper(F.substr("p_name", F.lit(1), F.lit(2))), ""), "").alias("cfa_pattern"),
    )
    rules = {"iso_speed": ">0", "black_level": ">=0", "camera_make": "text", "cfa_pattern": "cfa"}
    return part.select("p_partkey", records.violations(part, rules).alias("broken"))


# B2, B4.
@query("""
SELECT p_partkey, (p_size > 25 OR p_partkey % 3 = 0) AS has_camera, CASE WHEN p_size > 25 THEN p_size END AS iso, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS make,
  printf('%03X%03X', p_size * 64, p_partkey % 4096) AS image FROM part
""")
def capture_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("iso", F.when(F.col("p_size") > 25, F.col("p_size"))).withColumn("make", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")))
    two = F.array(F.lit(2).cast("bigint"))
    image = records.raw_image(12, two, F.array((F.col("p_size") * 64).cast("bigint"), F.col("p_partkey")))
    rows = part.select("p_partkey", records.group("iso", "make").alias("camera"), image.alias("image"))
    return rows.select("p_partkey", F.col("camera").isNotNull().alias("has_camera"), "camera.iso", "camera.make", F.hex("image.data").alias("image"))


# B3, B5, C8.
@query("""
SELECT p_partkey, ordinal::INTEGER AS ordinal, name, value, '  ' || name || ': ' || value AS line FROM (
  SELECT p_partkey, 0 AS ordinal, 'brand' AS name, p_brand AS value FROM part UNION ALL
  SELECT p_partkey, 1, 'size', CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END FROM part UNION ALL SELECT p_partkey, 2, 'type', p_type FROM part) WHERE value IS NOT NULL
""")
def capture_fields(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"), F.col("p_type").alias("type"))
    fields = records.to_fields(part, "p_partkey", ["brand", "size", "type"])
    return fields.withColumn("line", lookup.tree_line(F.col("name"), F.col("value")))


# The rows back as records.
@query("SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM part")
def capture_parse(spark, sf_dir):
    part = records.dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"))
    return records.from_fields(records.to_fields(part, "p_partkey", ["brand", "size"]), "p_partkey", {"brand": "string", "size": "int"})


#: Values of the 27 fields of a record, in order: as Spark columns and as SQL. Field k is absent from every (k + 2)th part.
_RECORD_SQL = {
    "float": "(p_size + {k} - 5)::FLOAT", "string": "p_brand || ' {k}'", "boolean": "p_size % 2 = 0", "array<string>": "['R', 'G', 'G', 'B']", "array<float>": "list_transform(range(9), lambda i: p_size::FLOAT)",
    "struct<algo:string,bytes:binary>": "sha256(p_name || '{k}')",
}


def _record_value(kind: str, k: int):
    size = F.col("p_size")
    return {
        "float": (size + k - 5).cast("float"), "string": F.concat("p_brand", F.lit(f" {k}")), "boolean": size % 2 == 0, "array<string>": F.array(*map(F.lit, "RGGB")), "array<float>": F.array_repeat(size.cast("float"), 9),
        "struct<algo:string,bytes:binary>": F.struct(F.lit("SHA-256").alias("algo"), F.unhex(F.sha2(F.concat(F.encode("p_name", "UTF-8"), F.lit(str(k).encode())), 256)).alias("bytes")),
    }[kind]


def _record_column(name: str, kind: str, k: int) -> str:
    return f"CASE WHEN p_partkey % {k + 2} <> 0 THEN {_RECORD_SQL[kind].format(k=k)} END AS {name}"


_BELOW = {">0": "{n} <= 0", ">=0": "{n} < 0"}
_BROKEN = [f"CASE WHEN {_BELOW[rule].format(n=name)} THEN '{name}: breaks its rule' END" for name, _, rule in records.FIELDS if rule in _BELOW]


# A record of all 27 fields as rows, and back in its groups.
@query(f"""
SELECT p_partkey, image, {', '.join(name for name, _, _ in records.FIELDS)}, list_filter([{', '.join(_BROKEN)}], lambda r: r IS NOT NULL) AS broken FROM (
  SELECT p_partkey, printf('%03X%03X', p_size * 64, p_partkey % 4096) AS image, {', '.join(_record_column(name, kind, k) for k, (name, kind, _) in enumerate(records.FIELDS))} FROM part)
""")
def capture_record(spark, sf_dir):
    part = records.dealt(table(spark, sf_dir, "part"), "p_partkey")
    image = records.raw_image(12, F.array(F.lit(2).cast("bigint")), F.array((F.col("p_size") * 64).cast("bigint"), F.col("p_partkey")))
    full = part.select("p_partkey", image.alias("image"), *[F.when(F.col("p_partkey") % (k + 2) != 0, _record_value(kind, k)).alias(name) for k, (name, kind, _) in enumerate(records.FIELDS)])
    rows = records.to_fields(full, "p_partkey", ["image", *(name for name, _, _ in records.FIELDS)])
    back = records.parse_raw_image(rows, "p_partkey", "PERMISSIVE", "broken")
    shown = lambda g, name, kind: (F.lower(F.hex(F.col(f"{g}.{name}.bytes"))) if kind.startswith("struct") else F.col(f"{g}.{name}")).alias(name)
    kinds = {name: kind for name, kind, _ in records.FIELDS}
    return back.select("p_partkey", F.hex("image.data").alias("image"), *[shown(g, name, kinds[name]) for g, names_ in records.GROUPS.items() for name in names_], "broken")


# G13, G12 by its positions.
@query("""
SELECT event_id, 12::BIGINT AS samples, (event_id * 37 % 179 - 89)::DOUBLE AS lat, (event_id * 53 % 359 - 179)::DOUBLE AS lon FROM events
""")
def geotagged_photo(spark, sf_dir):
    rgb = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: (F.col("event_id") * i % 256).cast("int"))
    photo = records.geotagged_photo(F.lit(2), F.lit(2), rgb, F.col("lat"), F.col("lon"))
    rows = _positions(spark, sf_dir).select("event_id", photo.alias("photo"))
    return rows.select("event_id", bits.product(F.col("photo.image.shape")).alias("samples"), "photo.location.*")


# A field by its path in the events' properties.
@query("SELECT event_id AS file_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def get_field(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    fields = table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.lit("event_props.main").alias("section"), F.posexplode(props).alias("ordinal", "name", "value"))
    return lookup.get_field(fields, "event props.main.k")


# C7.
@query("""
SELECT doc_id AS file_id, CASE WHEN half = 0 THEN 'head' ELSE 'tail' END AS name, (half * (n // 2))::BIGINT AS offset_bytes, (CASE WHEN half = 0 THEN n // 2 ELSE n - n // 2 END)::BIGINT AS size_bytes,
  (2 - half)::BIGINT AS fields_found FROM (SELECT doc_id, strlen(text) AS n FROM documents), (SELECT unnest([0, 1]) AS half)
""")
def section_info(spark, sf_dir):
    sections = _sections(spark, sf_dir)
    fields = sections.select("file_id", F.col("name").alias("section"), F.explode(F.sequence(F.col("half"), F.lit(1))).alias("ordinal"))
    labels = sections.select("file_id", F.col("half").alias("ordinal"), "name", "offset_bytes", "size_bytes", F.lit(1).alias("child_count"))
    return lookup.section_info(labels, fields).select("file_id", "name", "offset_bytes", "size_bytes", "fields_found")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of two sections, each with a hash; that of every seventh tail is wrong, of every fifth head absent."""
    n = F.octet_length("text").cast("bigint")
    half = F.floor(n / 2)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content"), n.alias("n"), half.alias("cut"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    rows = rows.select(
        "file_id", "content", "half", F.when(F.col("half") == 0, "head").otherwise("tail").alias("name"), (F.col("half") * F.col("cut")).alias("offset_bytes"),
        F.when(F.col("half") == 0, F.col("cut")).otherwise(F.col("n") - F.col("cut")).alias("size_bytes"), F.substring("content", 1, 2).alias("magic"),
    )
    own = integrity.section_hash(F.col("content"), F.col("offset_bytes").cast("int"), F.col("size_bytes").cast("int"))
    wrong = F.when((F.col("half") == 1) & (F.col("file_id") % 7 == 0), F.repeat(F.lit("0"), F.lit(64))).when((F.col("half") == 0) & (F.col("file_id") % 5 == 0), F.lit(None)).otherwise(own)
    return rows.withColumn("hash", wrong).withColumn("offset_bytes", F.col("offset_bytes").cast("bigint"))


# V4, V8.
@query("""
SELECT doc_id AS file_id, 3 - (doc_id % 7 = 0)::BIGINT - (doc_id % 5 = 0)::BIGINT AS passed, (doc_id % 7 = 0)::BIGINT AS failed, (doc_id % 5 = 0)::BIGINT AS absent FROM documents
""")
def file_checks(spark, sf_dir):
    # one pass: a file's sections are an array, and its checks are counted in its row
    id_, size = F.col("file_id"), F.octet_length("content")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit(MAGIC), F.encode("text", "UTF-8")).alias("content"))
    cut = F.floor((size - len(MAGIC)) / 2).cast("int")
    own = lambda offset, n: integrity.section_hash(F.col("content"), offset, n)
    section = lambda name, offset, n, digest: F.struct(F.lit(name).alias("name"), offset.alias("offset_bytes"), n.alias("size_bytes"), digest.alias("hash"))
    tail = (cut + len(MAGIC), size - len(MAGIC) - cut)
    head = section("head", F.lit(len(MAGIC)), cut, F.when(id_ % 5 != 0, own(F.lit(len(MAGIC)), cut)))
    broken = F.when(id_ % 7 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(own(*tail))
    found = rows.select("file_id", integrity.checks_in_file(F.col("content"), F.lit(MAGIC), F.array(head, section("tail", *tail, broken))).alias("checks"))
    count = lambda status: F.size(F.filter("checks", lambda c: c["status"] == status)).cast("bigint")
    return found.select("file_id", *[count(s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("ABSENT", "absent"))])


MAGIC = b"TSL<"


def _in_files(sections: DataFrame) -> DataFrame:
    """Sections of documents behind the magic bytes, which don't come from the content that they are compared with."""
    moved = (F.col("offset_bytes") + len(MAGIC)).cast("int")
    return sections.withColumn("content", F.concat(F.lit(MAGIC), "content")).withColumn("offset_bytes", moved).withColumn("size_bytes", F.col("size_bytes").cast("int")).withColumn("magic", F.lit(MAGIC))


# V8, the whole: every eleventh file has another magic, every thirteenth a broken header; some have signatures and tokens.
@query("""
SELECT doc_id AS file_id, errors, warnings, CASE WHEN errors > 0 THEN 'INVALID' WHEN warnings > 0 THEN 'VALID' ELSE 'ALL CHECKS PASSED' END AS verdict FROM (
  SELECT doc_id, (doc_id % 11 = 0)::BIGINT + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE (doc_id % 7 = 0)::BIGINT END AS errors,
    CASE WHEN doc_id % 13 = 0 THEN 0 ELSE (doc_id % 3 = 0)::BIGINT + (doc_id % 4 = 0)::BIGINT END AS warnings FROM documents)
""")
def file_verify(spark, sf_dir):
    id_, head = F.col("file_id"), F.col("half") == 0
    sections = _in_files(_sections(spark, sf_dir)).withColumn("signature", F.when(head & (id_ % 3 == 0), "e"))
    sections = sections.withColumn("size_bytes", F.when(head & (id_ % 13 == 0), -1).otherwise(F.col("size_bytes")))
    sections = sections.withColumn("name", F.when(~head & (id_ % 4 == 0), "token_auth").otherwise(F.col("name")))
    start = F.when(F.col("doc_id") % 11 == 0, F.lit(b"NONE")).otherwise(F.lit(MAGIC))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(start, F.encode("text", "UTF-8")).alias("content"), F.lit(MAGIC).alias("magic"))
    return integrity.verdicts(integrity.verify(files, sections.drop("content")))


# V1, V3: a hash in the file itself.
@query("SELECT doc_id, sha256(unhex(repeat('00', 32)) || encode(text)) AS digest, doc_id % 3 <> 0 AS holds FROM documents")
def file_hash(spark, sf_dir):
    body = F.concat(F.lit(bytes(32)), F.encode("text", "UTF-8"))
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    rows = rows.withColumn("digest", integrity.file_hash(F.col("body"), 0))
    signed = F.concat("digest", F.substring("body", F.lit(33), F.octet_length("body")))
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(signed, F.lit(b"x"))).otherwise(signed)
    return rows.withColumn("file", broken).select("doc_id", F.lower(F.hex("digest")).alias("digest"), integrity.file_hash_holds(F.col("file"), 0).alias("holds"))


# V9.
@query("""
SELECT * FROM (VALUES ('mac', 'h', 'HMAC-SHA256', 32), ('mac', 's', 'HMAC-SHA512', 64), ('mac', 'p', 'Poly1305', 16), ('mac', 'b', 'BLAKE3-keyed', 32), ('mac', 'c', 'CMAC-AES', 16),
  ('hash', 'b', 'BLAKE3', 32), ('hash', 's', 'SHA-256', 32), ('hash', 't', 'SHA-512', 64), ('signature', 'e', 'Ed25519', 64), ('signature', 'p', 'ECDSA-P256', 64), ('signature', 'r', 'RSA-2048', 256),
  ('key', 'e', 'Ed25519', 32), ('key', 'x', 'X25519', 32), ('key', 'p', 'ECDSA-P256', NULL), ('key', 'r', 'RSA-2048', NULL), ('key', 'c', 'ChaCha20-Poly1305', NULL), ('key', 'a', 'AES-256-GCM', NULL),
  ('wrap', 'c', 'ChaCha20-Poly1305', 32), ('wrap', 'a', 'AES-256-GCM', 32)) t(kind, id, name, length)
""")
def algorithm_registry(spark, sf_dir):
    return integrity.algorithms(spark).filter(integrity.is_known(F.col("kind"), F.col("id")))


# C9.
@query(r"""
SELECT o_orderkey, regexp_replace(reverse(regexp_replace(reverse(v::VARCHAR), '(\d{3})', '\1 ', 'g')), '^ ', '') AS grouped,
  CASE WHEN v >= 1073741824 THEN printf('%.3f GB', v / 1073741824.0) WHEN v >= 104857600 THEN printf('%.1f MB', v / 1048576.0) WHEN v >= 10485760 THEN printf('%.2f MB', v / 1048576.0)
    WHEN v >= 1048576 THEN printf('%.3f MB', v / 1048576.0) WHEN v >= 102400 THEN printf('%.1f KB', v / 1024.0) WHEN v >= 10240 THEN printf('%.2f KB', v / 1024.0)
    WHEN v >= 1024 THEN printf('%.3f KB', v / 1024.0) ELSE v || ' Bytes' END AS size
FROM (SELECT o_orderkey, floor(o_totalprice * 100)::BIGINT AS v FROM orders)
""")
def display_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 100).alias("v"))
    return rows.select("o_orderkey", display.grouped_number(F.col("v")).alias("grouped"), display.byte_size(F.col("v")).alias("size"))


# The preview is of the first four bytes, which may end inside a character.
@query("SELECT doc_id, substr(hex(encode(text)), 1, 8) || CASE WHEN strlen(text) > 4 THEN '...' ELSE '' END AS preview, CASE WHEN length(text) > 30 THEN substr(text, 1, 27) || '...' ELSE text END AS short FROM documents")
def display_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", display.hex_preview(F.encode("text", "UTF-8")).alias("preview"), display.short_text(F.col("text")).alias("short"))


# Values by their type.
@query(r"""
SELECT o_orderkey, o_orderkey::VARCHAR AS whole, printf('%.4f', round(o_totalprice::FLOAT::DOUBLE, 4)) AS single, printf('%.8f', o_totalprice) AS double,
  CASE WHEN strlen(o_orderpriority || o_orderpriority || o_orderpriority) > 30 THEN substr(o_orderpriority || o_orderpriority || o_orderpriority, 1, 27) || '...' ELSE o_orderpriority || o_orderpriority || o_orderpriority END AS text,
  '1 × ' || (1000 + o_orderkey % 9)[1] || ' ' || lpad(((1000 + o_orderkey % 9) % 1000)::VARCHAR, 3, '0') || ', 12-bit packed tensor (3 Bytes)' AS packed,
  'hash[SHA-256 32 Bytes] ' || upper(substr(sha256(o_orderkey::VARCHAR), 1, 8)) || '...' AS digest, 'wrap[AES-256-GCM 2 Bytes] 0102' AS wrap,
  upper(strftime(o_orderdate, '%Y-%b-%d ')) || ltrim(strftime(o_orderdate, '%I'), '0') || strftime(o_orderdate, ':%M:%S.%g %p') AS time,
  '(' || printf('%.4f', o_orderkey % 90 + 0.5) || '°N, ' || printf('%.4f', o_orderkey % 180 + 0.25) || '°W)' AS position FROM orders
""".replace("(1000 + o_orderkey % 9)[1]", "(1000 + o_orderkey % 9) // 1000"))
def display_values(spark, sf_dir):
    orders, key, show = table(spark, sf_dir, "orders"), F.col("o_orderkey"), display.format_value
    tensor = F.struct(F.lit(12).alias("bit_depth"), F.array(F.lit(1).cast("bigint"), 1000 + key % 9).alias("shape"), F.lit(b"\x00\x01\x02").alias("data"))
    coded = lambda kind, id_, data: F.struct(F.lit(kind).alias("kind"), F.lit(id_).alias("id"), data.alias("bytes"))
    digest = F.unhex(F.sha2(F.encode(key.cast("string"), "UTF-8"), 256))
    return orders.select(
        "o_orderkey", show("whole", key).alias("whole"), show("float", F.col("o_totalprice").cast("float")).alias("single"), show("double", F.col("o_totalprice")).alias("double"),
        display.short_value("text", F.repeat("o_orderpriority", F.lit(3))).alias("text"), display.short_value("packed", tensor).alias("packed"),
        show("code", coded("hash", "s", digest)).alias("digest"), show("code", coded("wrap", "a", F.lit(b"\x01\x02"))).alias("wrap"), show("time", F.col("o_orderdate")).alias("time"),
        show("position", F.struct((key % 90 + 0.5).alias("lat"), (-(key % 180) - 0.25).alias("lon"))).alias("position"),
    )


def _word_list(spark: SparkSession, sf_dir: str) -> list[str]:
    """The words of the parts' names, in order: the caller's own list for word codes, which is a parameter of the plan."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct().orderBy("w")
    return [r["w"] for r in words.collect()]


# A code table from all characters, then every text coded and read back. Lengths are optimal by a test.
@query("SELECT doc_id, length(text)::INTEGER AS chars, md5(text) AS back FROM documents")
def text_code(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    code = codes.code_table(docs)
    rows = docs.select("doc_id", F.length("text").alias("chars"), codes.encode_text(code)("text").alias("coded"))
    return rows.select("doc_id", "chars", F.md5(F.encode(codes.decode_text(code)(F.col("coded"), F.col("chars")), "UTF-8")).alias("back"))


# The whole table in its code, against its size in UTF-8. An optimal code takes less than a bit a character more than the entropy.
@query(r"""
WITH c AS (SELECT count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c), h AS (SELECT sum(n * log2((SELECT sum(n) FROM c) / n)) / 8 AS entropy, sum(n) AS chars FROM c)
SELECT count(*) AS texts, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, sum(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')))::BIGINT AS ascii_chars,
  any_value(entropy) + any_value(h.chars) / 8 + count(*) < sum(strlen(text)) AS smaller FROM documents, h
""")
def text_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    stats = docs.select(names.compression_stats(F.col("text"), codes.coded_size(codes.code_table(docs))("text")).alias("s")).select("s.*")
    sums = [F.sum(c).alias(c) for c in ("chars", "bytes", "ascii_chars")]
    return stats.agg(F.count(F.lit(1)).alias("texts"), *sums, (F.sum("coded_bytes") < F.sum("bytes")).alias("smaller"))


_STEPS, _POINTS = codes.EDGE_STEPS, codes.POINTS
_POWERS = [len(NATIONS) ** k for k in range(codes.digits_needed(len(NATIONS), 2**64 - 1) - 1)]


# Positions as numbers of 64 bits, as words, and back, within 4 mm.
@query(f"""
WITH {_FACES_SQL}, near3 AS (SELECT *, floor(u * {_STEPS} + 0.5)::BIGINT AS a, floor(v * {_STEPS} + 0.5)::BIGINT AS b, floor(w * {_STEPS} + 0.5)::BIGINT AS c FROM w),
off AS (SELECT *, abs(a - u * {_STEPS}) AS oa, abs(b - v * {_STEPS}) AS ob, abs(c - w * {_STEPS}) AS oc FROM near3),
ij AS (SELECT *, CASE WHEN oa > ob AND oa > oc THEN {_STEPS} - b - c ELSE a END AS i, CASE WHEN NOT (oa > ob AND oa > oc) AND ob > oc THEN {_STEPS} - a - c ELSE b END AS j FROM off),
point AS (SELECT *, ((face - 10)::HUGEINT * {_POINTS} + i::HUGEINT * (2 * {_STEPS}::HUGEINT + 3 - i) // 2 + j)::BIGINT AS code, i / {float(_STEPS)!r} AS pu, j / {float(_STEPS)!r} AS pv FROM ij),
back AS (SELECT *, ax * pu + bx * pv + cx * (1 - pu - pv) AS qx, ay * pu + "by" * pv + cy * (1 - pu - pv) AS qy, az * pu + bz * pv + cz * (1 - pu - pv) AS qz FROM point),
unit AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS q, code::HUGEINT + 9223372036854775808 AS n FROM back)
SELECT event_id, code, round(degrees(atan2(qz, sqrt(qx * qx + qy * qy))), 7) + 0.0 AS lat, round(degrees(atan2(qy, qx)), 7) + 0.0 AS lon,
  sqrt(pow(x - qx / q, 2) + pow(y - qy / q, 2) + pow(z - qz / q, 2)) * 6371000 < 0.004 AS near, code AS tracked, code AS read,
  [{', '.join(f"'{w}'" for w in NATIONS)}][(n % {len(NATIONS)} + 1)::BIGINT] || ' ' || array_to_string([{', '.join(f"[{', '.join(repr(w) for w in NATIONS)}][(n // {p}::HUGEINT % {len(NATIONS)} + 1)::BIGINT]" for p in _POWERS)}], ' ') AS words FROM unit
""")
def position_codes(spark, sf_dir):
    rows = _off_edges(spark, sf_dir).withColumn("code", codes.position_code("lat", "lon")).withColumn("p", codes.position_of("code"))
    at = geo.to_xyz(F.col("lat"), F.col("lon"))
    gap = functools.reduce(lambda a, b: a + b, [F.pow(at[k] - F.col(f"p.{k}"), F.lit(2.0)) for k in "xyz"])
    track = codes.track_codes(F.array(F.struct("lat", "lon"), F.struct("lat", "lon")))
    rows = rows.withColumn("words", codes.to_words(F.col("code"), NATIONS, signed=True))
    return rows.select(
        "event_id", "code", (F.round("p.lat", 7) + 0.0).alias("lat"), (F.round("p.lon", 7) + 0.0).alias("lon"), (F.sqrt(gap) * 6_371_000 < 0.004).alias("near"), track[1].alias("tracked"),
        codes.from_words(NATIONS, signed=True)("words").alias("read"), "words",
    )


# Order keys as words of the parts' names, and back; every fiftieth with a slip in its first word, and all with a wrong check.
@query("""
WITH RECURSIVE w AS (SELECT list(word ORDER BY word) AS ws, count(*) AS b FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)),
d AS (SELECT o_orderkey, 0 AS k, o_orderkey::BIGINT AS rest FROM orders UNION ALL SELECT o_orderkey, k + 1, rest // b FROM d, w WHERE k + 1 < ceil(63 * ln(2) / ln(b) - 1e-9))
SELECT o_orderkey, any_value(ws)[o_orderkey % any_value(b) + 1] || ' ' || string_agg(ws[rest % b + 1], ' ' ORDER BY k) AS words, o_orderkey AS back, NULL::BIGINT AS broken FROM d, w GROUP BY o_orderkey
""")
def word_codes(spark, sf_dir):
    words = _word_list(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", codes.to_words(F.col("o_orderkey"), words).alias("words"))
    slip = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.upper(F.substr("words", F.lit(1), F.lit(1))), "words")).otherwise(F.col("words"))
    rows = codes.with_number_of_words(rows.withColumn("slip", slip), "slip", words, "back")
    listed = F.array(*map(F.lit, words))
    other = F.element_at(listed, ((F.col("o_orderkey") + 1) % len(words)).cast("int") + 1)
    return rows.select("o_orderkey", "words", "back", codes.from_words(words)(F.concat(other, F.substr("words", F.instr("words", " "), F.length("words")))).alias("broken"))


def _response(k: int, nm: float) -> str:
    middle, width = ((570, 60.0), (540, 55.0), (445, 35.0))[k]
    low, high = nm // 10 * 10, nm // 10 * 10 + 10
    at = lambda x: f"exp(-pow(({x} - {middle}) / {width}, 2))"
    return f"({at(low)} * {(high - nm) / 10!r} + {at(high)} * {(nm - low) / 10!r})"


_TO_LMS = [_response(k, nm) for k in range(3) for nm in (645.0, 523.0, 445.0)]
_CARRIED = (1.9, -1.1, 0.2, 0.4, 0.6, 0.0, 0.0, 0.0, 1.1)
_TO_SPACE = [" + ".join(f"{_CARRIED[3 * r + k]!r} * m[{3 * k + c + 1}]" for k in range(3)) for r in range(3) for c in range(3)]


# K8, L2: a caller's observer table (here a synthetic one), its matrices, and those of a space beyond it.
@query(f"""
SELECT list_transform(m, lambda x: round(x, 9) + 0.0) AS to_lms, [{', '.join(f'round(({x}) / {_DET}, 6) + 0.0' for x in _ADJUGATE)}] AS to_rgb, [{', '.join(f'round({x}, 9) + 0.0' for x in _TO_SPACE)}] AS to_space,
  list_transform([{', '.join(_PRODUCT)}], lambda x: round(x, 6)) = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] AS inverse_holds, round(0.2::DOUBLE * 0.25 + 0.7 * 0.5 + 0.1 * 1.0, 9) AS light
FROM (SELECT m, [{', '.join(f'({x}) / {_DET}' for x in _ADJUGATE)}] AS inv FROM (SELECT [{', '.join(_TO_LMS)}] AS m))
""")
def observer_matrix(spark, sf_dir):
    nm = F.col("id") * 10.0 + 390
    bell = lambda middle, width: F.exp(-F.pow((nm - middle) / width, F.lit(2.0)))
    observer = spark.range(45).select(nm.alias("nm"), bell(570, 60.0).alias("l"), bell(540, 55.0).alias("m"), bell(445, 35.0).alias("s"))
    m = codes.through(codes.derive_rgb_to_observer(observer, (645.0, 523.0, 445.0)), {"space": list(_CARRIED)})
    shown = lambda c, digits: F.transform(c, lambda x: F.round(x, digits) + 0.0).alias(c)
    light = codes.luminance(F.lit(0.25), F.lit(0.5), F.lit(1.0), (0.2, 0.7, 0.1))
    holds = codes.is_identity(matrix.multiply(F.col("to_space"), F.col("from_space"))) & codes.is_identity(matrix.multiply(F.col("to_lms"), F.col("to_rgb")))
    m = m.withColumn("inverse_holds", holds)  # before the select, whose aliases would be taken for the matrices
    return m.select(shown("to_lms", 9), shown("to_rgb", 6), shown("to_space", 9), "inverse_holds", F.round(light, 9).alias("light"))
