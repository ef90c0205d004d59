"""Records, lookup, integrity, codes and sources on small tables."""

import collections
import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessella import __main__ as command_line
from tessella import sources
from tessella.functions import geo, matrix, names
from tessella.operators import codes, integrity, lookup, records
from tessella.plans.queries import QUERIES
from tessella.streaming import width_counts, with_columns


def test_rules(spark):
    row = spark.createDataFrame([(0.0, float("nan"), "", ["R", "X"], [1.0] * 8, -1.0)], "iso_speed double, white_level double, lens_make string, cfa_pattern array<string>, magic_9 array<double>, black_level double")
    assert row.select(records.violations(row)).first()[0] == ["cfa_pattern", "black_level", "white_level", "magic_9", "iso_speed", "lens_make"]
    empty = spark.createDataFrame([(None, None)], "iso_speed float, lens_make string")
    assert empty.select(records.violations(empty)).first()[0] == []
    digest = spark.createDataFrame([(("SHA-256", b"\x01"), ("MD5", b"\x01"))], "dark_frame_hash struct<algo:string,bytes:binary>, flat_field_hash struct<algo:string,bytes:binary>")
    assert digest.select(records.violations(digest)).first()[0] == ["flat_field_hash"]


def test_fields_there_and_back(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 7), (3, None, None)], "id int, make string, iso int")
    fields = records.to_fields(df, "id", ["make", "iso"])
    assert sorted(map(tuple, fields.collect())) == [(1, 0, "make", "a"), (2, 1, "iso", "7")]
    more = fields.unionByName(spark.createDataFrame([(1, 5, "make", "b"), (1, 6, "other", "x"), (2, 7, "iso", "no")], fields.schema))
    back = {r["id"]: (r["make"], r["iso"]) for r in records.from_fields(more, "id", {"make": "string", "iso": "int"}).collect()}
    assert back == {1: ("b", None), 2: (None, None)}


def test_preset(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in records.standard_capture(F.array(*[F.lit(i).cast("bigint") for i in range(4)]), F.lit(800), F.lit(0.01), (2, 2)).items()]).first()
    assert bytes(row["image"]["data"]).hex() == "000001002003" and row["cfa_pattern"] == list("RGGB")


def test_get_field(spark):
    fields = spark.createDataFrame([(1, "camera sensor.main", 0, "iso speed", "100"), (1, "camera sensor.main", 1, "iso_speed", "200"), (2, "lens", 0, "iso_speed", "1")], "file_id int, section string, ordinal int, name string, value string")
    assert [tuple(r) for r in lookup.get_field(fields, "camera_sensor.main.iso_speed").collect()] == [(1, "100")]
    assert lookup.get_field(fields, "none.iso_speed").count() == 0
    with pytest.raises(ValueError):
        lookup.get_field(fields, "lens")


def test_file_hash_and_checks(spark):
    content = b"HEAD" + bytes(32) + b"body"
    digest = hashlib.sha256(content).digest()
    signed = content[:4] + digest + content[36:]
    row = spark.createDataFrame([(signed, signed[:-1] + b"x")], "good binary, bad binary")
    assert tuple(row.select(integrity.file_hash_holds(F.col("good"), 4), integrity.file_hash_holds(F.col("bad"), 4)).first()) == (True, False)
    sections = spark.createDataFrame(
        [(1, "a", signed, 36, 4, hashlib.sha256(b"body").hexdigest(), b"HEAD"), (1, "b", signed, 0, 4, None, b"HEAD"), (2, "a", signed, 36, 4, "00", b"TAIL")],
        "file_id int, name string, content binary, offset_bytes int, size_bytes int, hash string, magic binary",
    )
    counts = {r["file_id"]: tuple(r)[1:] for r in integrity.check_counts(integrity.checks(sections)).collect()}
    assert counts == {1: (2, 0, 1), 2: (0, 2, 0)}
    nested = sections.groupBy("file_id", "content", "magic").agg(F.array_sort(F.collect_list(F.struct("name", "offset_bytes", "size_bytes", "hash"))).alias("s"))
    flat = nested.select("file_id", F.inline(integrity.checks_in_file(F.col("content"), F.col("magic"), F.col("s"))))
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, integrity.checks(sections).collect()))


def test_verify_gives_rows_for_every_check(spark):
    files = spark.createDataFrame([(1, b"HEADbody", b"HEAD"), (2, b"TAILbody", b"HEAD"), (3, b"HEAD", b"HEAD"), (4, b"HEAD", b"HEAD"), (5, None, b"HEAD")], "file_id int, content binary, magic binary")
    good = hashlib.sha256(b"body").hexdigest()
    sections = spark.createDataFrame(
        [(1, "a", 4, 4, good, "e"), (1, "token auth", 4, 4, None, None), (2, "a", 4, 4, good, None), (2, "b", 4, 5, good, None), (3, "a", -1, 4, good, "e")],
        "file_id int, name string, offset_bytes int, size_bytes int, hash string, signature string",
    )
    result = integrity.verify(files, sections)
    assert {tuple(r) for r in result.collect()} == {
        (1, "magic", "PASS"), (1, "header", "PASS"), (1, "section a", "PASS"), (1, "signature a", "WARN"), (1, "section token auth", "ABSENT"), (1, "token", "WARN"),
        (2, "magic", "FAIL"), (2, "header", "PASS"), (2, "section a", "PASS"), (2, "section b", "FAIL"), (2, "token", "ABSENT"), (3, "magic", "PASS"), (3, "header", "FAIL"),
        (4, "magic", "PASS"), (4, "header", "PASS"), (4, "token", "ABSENT"), (5, "magic", "FAIL"), (5, "header", "FAIL"),
    }
    found = {r["file_id"]: tuple(r)[1:] for r in integrity.verdicts(result).collect()}
    assert found == {1: (0, 2, "VALID"), 2: (2, 0, "INVALID"), 3: (1, 0, "INVALID"), 4: (0, 0, "ALL CHECKS PASSED"), 5: (2, 0, "INVALID")}


def test_fields_of_a_wrong_type_leave_a_reason(spark):
    fields = spark.createDataFrame([(1, 0, "iso", "no"), (1, 1, "make", None), (2, 0, "iso", "7")], "id int, ordinal int, name string, value string")
    rows = {r["id"]: tuple(r)[1:] for r in records.from_fields(fields, "id", {"make": "string", "iso": "int"}, corrupt="_corrupt").collect()}
    assert rows == {1: (None, None, ["make: end of data", "iso: invalid data"]), 2: (None, 7, [])}
    with pytest.raises(Exception, match="iso: invalid data"):
        records.from_fields(fields, "id", {"iso": "int"}, "FAILFAST").count()


def test_raw_image_there_and_back(spark):
    kinds = dict(id="int", image=records.IMAGE) | {name: kind for name, kind, _ in records.FIELDS}
    values = {"array<string>": list("RGGB"), "float": 1.5, "struct<algo:string,bytes:binary>": ("SHA-256", b"\x00\xff"), "array<float>": [0.5] * 9, "string": "x", "boolean": False}
    full = {name: values[kind] for name, kind, _ in records.FIELDS}
    rows = [(1, (12, [2], b"\x01\x02\x03"), *full.values()), (2, None, *full.values()), (3, (8, [1], b"\x01"), *(full | {"iso_speed": -1.0}).values()), (4, (8, [1], b"\x01"), *[None] * 27)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    fields = records.to_fields(df, "id", [n for n in kinds if n != "id"]).withColumn("section", F.lit("raw"))
    fields = fields.unionByName(spark.createDataFrame([(5, 0, "image", "{}", "other"), (4, 50, "magic_9", "[1, x]", "raw")], fields.schema))
    back = {r["id"]: r for r in records.parse_raw_image(fields, "id", "PERMISSIVE").collect()}
    assert {k: r["_corrupt"] for k, r in back.items()} == {1: [], 2: ["image: missing"], 3: ["iso_speed: breaks its rule"], 4: ["magic_9: invalid data"], 5: ["image: missing"]}
    assert back[1]["image"].asDict() == {"bit_depth": 12, "shape": [2], "data": b"\x01\x02\x03"} and back[4]["camera"] is None
    assert {n: tuple(v) if isinstance(v, tuple) else v for g in records.GROUPS for n, v in back[1][g].asDict().items()} == full
    with pytest.raises(Exception, match="image: missing"):
        records.parse_raw_image(fields.filter("id = 2"), "id").collect()
    assert records.parse_raw_image(fields.filter("id = 1"), "id").count() == 1


def test_records_are_dealt_before_their_fields(spark, tmp_path):
    """However many records a file has, a task sorts the rows of a bounded number of them, and rows of fields aren't exchanged."""
    spark.range(5_000).selectExpr("id", "id * 2 AS a", "IF(id % 3 = 0, NULL, 'x') AS b").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = records.dealt(spark.read.parquet(str(tmp_path / "t")), "id", 500)
    back = records.from_fields(records.to_fields(df, "id", ["a", "b"]), "id", {"a": "bigint", "b": "string"})
    sizes = [r["n"] for r in back.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 700 and back.filter("a = id * 2 AND (b IS NULL) = (id % 3 = 0)").count() == 5_000
    for name in ("capture_record", "capture_parse"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate"), name


def test_section_notes(spark):
    labels = spark.createDataFrame(
        [(1, 0, "a", 0, 4, 1, "e", "c", "c"), (1, 1, "b", 4, 4, 1, None, "a", None), (1, 2, "d", 8, 4, 1, "r", None, None)],
        "file_id int, ordinal int, name string, offset_bytes int, size_bytes int, child_count int, signature string, key string, wrap string",
    )
    fields = spark.createDataFrame([(1, "a")], "file_id int, section string")
    assert {r["name"]: (r["fields_found"], r["notes"]) for r in lookup.section_info(labels, fields).collect()} == {
        "a": (1, "Signed with Ed25519, Encrypted with ChaCha20-Poly1305"), "b": (0, ""), "d": (0, "Signed with RSA-2048")}


def test_word_codes(spark):
    words = ["ash", "bay", "cod", "dew", "elk"]
    edges = spark.createDataFrame([(0,), (4,), (5,), (2**62,), (2**63 - 1,), (-1,), (-(2**63),), (None,)], "n bigint").withColumn("w", codes.to_words(F.col("n"), words)).withColumn("s", codes.to_words(F.col("n"), words, signed=True))
    rows = edges.select("n", "w", "s", codes.from_words(words)("w").alias("back"), codes.from_words(words, signed=True)("s").alias("all")).collect()
    assert all(r["back"] == r["n"] for r in rows if r["n"] is not None and r["n"] >= 0) and [r["w"] for r in rows[-3:]] == [None] * 3
    assert all(r["all"] == r["n"] for r in rows)
    swapped = rows[2]["w"].replace("ash", "bay", 1)
    assert spark.range(1).select(codes.from_words(words)(F.lit(swapped)), codes.from_words(words)(F.lit("ash fox"))).first()[0] is None


@pytest.mark.parametrize("signed", [False, True])
def test_words_are_read_and_written_at_once_as_one_by_one(spark, signed):
    """Texts of a batch give what the plain rules give for each: bounds, checks, blanks, capitals, words in other letters."""
    words, draw = ["ash", "bay", "cod", "ärm", "elk", "ash"], random.Random(9)
    base, low, most = len(words), -(2**63) if signed else 0, 2**64 - 1 if signed else 2**63 - 1
    count = codes.digits_needed(base, most)
    written = lambda n: " ".join(words[n // base**k % base] for k in (0, *range(count - 1)))

    def plain(text):
        digits = [words.index(w) if w in words else None for w in text.lower().split()] if text is not None else [None]
        if len(digits) != count or None in digits:
            return None
        number = sum(d * base**k for k, d in enumerate(digits[1:]))
        return number + low if number <= most and number % base == digits[0] else None

    numbers = [0, 1, 5, 6, most, most - 1, 2**62, *(draw.randrange(most) for _ in range(200))]
    texts = [*map(written, numbers), *(written(n).replace("ärm", "bay") for n in numbers), *(" ".join(["elk"] * k) for k in range(count + 2)), None, "", " ", "fox", written(7).upper(), "\t" + written(8).replace(" ", " \n "), written(9).replace(" ", "\x1c")]
    texts += [" ".join(draw.choice(words[:5]) for _ in range(count)) for _ in range(300)]
    texts += [t + " " for t in texts if t]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codes.from_words(words, signed)("t").alias("n")).collect()
    assert [r["n"] for r in rows] == [plain(r["t"]) for r in rows] and sum(r["n"] is not None for r in rows) > 300
    rows = spark.createDataFrame([(n + low,) for n in numbers], "n bigint").select("n", codes.to_words(F.col("n"), words, signed).alias("w")).collect()
    assert [r["w"] for r in rows] == [written(r["n"] - low) for r in rows]


def test_tracks_and_words_take_no_row_by_row_pass():
    """A hundred thousand positions: words, numbers and tracks each take a second or two at the most."""
    n = 100_000
    lat, lon = (pa.ListArray.from_arrays(pa.array(range(0, 2 * n + 1, 2), pa.int32()), pa.array(np.resize(np.linspace(-80, 80, 997), 2 * n))) for _ in range(2))
    text = pa.array([" ".join(["ash"] * codes.digits_needed(3, 2**64 - 1))] * n)
    began = time.perf_counter()
    assert len(codes._track.func(lat, lon)) == n
    assert codes.from_words(["ash", "bay", "cod"], True).func(text).to_pylist()[-1] == -(2**63)
    assert time.perf_counter() - began < 2.5


def test_word_codes_with_slips(spark):
    words = ["amber", "basil", "cedar", "dahlia", "fennel"]
    good = spark.createDataFrame([(n,) for n in (0, 7, 123456789, 2**62)], "n bigint").withColumn("w", codes.to_words(F.col("n"), words))
    slips = good.select("n", F.regexp_replace(F.upper("w"), "CEDAR", "seder").alias("w"))
    other = spark.createDataFrame([(None, None), (None, "amber"), (None, " ".join(["basil", *["amber"] * 27]))], "n bigint, w string")
    for r in codes.with_number_of_words(good.unionByName(slips).unionByName(other), "w", words, "back").collect():
        assert r["back"] == r["n"]


def test_positions_are_within_4_mm(spark):
    at = spark.range(20_000).select((F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    ends = spark.createDataFrame([(float(a), float(b)) for a in (-90, -45, 0, 31.7174744, 90) for b in (-180, -90, 0, 36, 180)] + [(None, 1.0), (float("nan"), 1.0)], "lat double, lon double")
    rows = at.unionByName(ends).withColumn("code", codes.position_code("lat", "lon")).withColumn("p", codes.position_of("code")).withColumn("xyz", geo.to_xyz(F.col("lat"), F.col("lon")))
    rows = rows.withColumn("again", codes.code_of_xyz("p.x", "p.y", "p.z"))
    gap = F.sqrt(F.pow(F.col("xyz.x") - F.col("p.x"), F.lit(2.0)) + F.pow(F.col("xyz.y") - F.col("p.y"), F.lit(2.0)) + F.pow(F.col("xyz.z") - F.col("p.z"), F.lit(2.0))) * 6_371_000_000
    good = rows.filter("code IS NOT NULL")
    facts = good.agg(F.avg(gap).alias("mean"), F.max(gap).alias("most"), F.count("p.lat").alias("n")).first()
    assert facts["mean"] < 2.14 and facts["most"] < 5.06 and facts["n"] == 20_025  # the published errors
    moved = good.filter("code <> again").withColumn("q", codes.position_of("again"))  # points on an edge are on two faces
    assert moved.filter("abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) > 1e-14").count() == 0
    track = F.array(F.struct("lat", "lon"), F.struct(F.lit(None).cast("double").alias("lat"), "lon"))
    assert good.select("code", codes.track_codes(track).alias("t")).filter("t[0] <> code OR t[1] IS NOT NULL OR size(t) <> 2").count() == 0
    assert spark.range(1).select(codes.track_codes(F.lit(None).cast("array<struct<lat:double,lon:double>>"))).first()[0] is None


def test_text_code(spark):
    docs = spark.createDataFrame([("aab",), ("",), ("é ß",), (None,)], "text string")
    table = codes.code_table(docs)
    rows = docs.withColumn("c", codes.encode_text(table)("text")).withColumn("back", codes.decode_text(table)(F.col("c"), F.length("text")))
    assert all(r["back"] == r["text"] for r in rows.collect())
    assert spark.createDataFrame([("z",)], "text string").select(codes.encode_text(table)("text")).first()[0] is None
    long = {chr(97 + i): "1" * i + "0" for i in range(20)}  # codes beyond the decoder's window
    text = spark.createDataFrame([("".join(reversed(sorted(long))),), ("attta",)], "text string").withColumn("c", codes.encode_text(long)("text"))
    assert all(r["back"] == r["text"] for r in text.withColumn("back", codes.decode_text(long)(F.col("c"), F.length("text"))).collect())
    assert text.select(codes.decode_text(long)(F.col("c"), F.lit(500))).first()[0] is None


def test_codec_by_plain_strings():
    draw = random.Random(5)
    text = "".join(draw.choice("etaoin shrdlu, ß日本😀" + "e" * 40) for _ in range(3000))
    lengths = names.code_lengths(sorted((ord(c), n) for c, n in collections.Counter(text).items()))
    table = {chr(p): b for p, b in names.canonical_codes(lengths).items()}
    deep = {chr(97 + i): "1" * i + "0" for i in range(56)}
    for code in (table, deep):
        own = codes._Table(code)
        texts = ["", text[:1] if code is table else "a", *("".join(draw.choice(list(code)) for _ in range(n)) for n in (1, 7, 64, 500, 2000)), text if code is table else "zyx" * 100, "?" if "?" not in code else ""]
        coded = own.encode(texts)
        for t, c, n in zip(texts, coded, own.sizes(texts)[3]):
            bits = "".join(code.get(x, "-") for x in t)
            want = None if "-" in bits else int("0" + bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
            assert c == want and n == (-1 if "-" in bits else len(bits))
        known = [(t, c) for t, c in zip(texts, coded) if c is not None]
        assert own.decode([c for _, c in known], [len(t) for t, _ in known]) == [t for t, _ in known]
        assert own.decode([known[-2][1][:-1], b""], [len(known[-2][0]), 3]) == [None, None]
    with pytest.raises(ValueError):
        codes._Table({"a": "0" * 57})


def test_codec_is_fast():
    draw = random.Random(6)
    texts = ["".join(draw.choices("etaoin shrdlucmfwypvbgk.,", range(25, 0, -1), k=20_000)) for _ in range(50)]
    table = {chr(p): b for p, b in names.canonical_codes(names.code_lengths(sorted((ord(c), n) for c, n in collections.Counter("".join(texts)).items()))).items()}
    own = codes._Table(table)
    began = time.perf_counter()
    coded = own.encode(texts)
    middle = time.perf_counter()
    assert own.decode(coded, [len(t) for t in texts]) == texts
    size = sum(map(len, texts)) / 1e6
    assert size / (middle - began) > 2.3 and size / (time.perf_counter() - middle) > 2.3  # megabytes a second of one core; the floor of the survey


def test_many_texts_are_decoded_in_little_memory():
    """Arrays of a place for every bit are made for a run of texts, not for all; a text longer than a run is one."""
    import tracemalloc

    own = codes._Table({"a": "0", "b": "10", "c": "110", "d": "111"})
    texts = ["abcd" * 2_000] * 300 + ["", "dcba" * 20_000, ""] + ["cab" * i for i in range(300)]
    coded = own.encode(texts)
    tracemalloc.start()
    assert own.decode(coded, list(map(len, texts))) == texts
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()


def test_workers_hold_a_batch_of_texts_once():
    """The codec's and the counts' functions read a batch by slices: beside it they hold little, however large it is."""
    import tracemalloc

    texts = pa.array(["abcd" * 1_000, None, "", "dc" * 500] * 2_500)
    code = {"a": "0", "b": "10", "c": "110", "d": "111"}
    tracemalloc.start()
    coded, back, bits = [], [], []
    for part in codes.encode_text(code).func(iter([texts])):
        coded.append(part)
    assert sum(map(len, coded)) == len(texts) and len(coded) > 10
    whole = pa.concat_arrays(coded)
    for part in codes.decode_text(code).func(iter([(whole, pc.utf8_length(texts))])):
        back.append(part)
    for part in codes.coded_size(code).func(iter([texts])):
        bits.append(part)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 32 << 20
    assert pa.concat_arrays(back).equals(texts) and pa.concat_arrays(bits).to_pylist() == [None if c is None else len(c) for c in whole.to_pylist()]


def test_matrices_beyond_an_observer(spark):
    row = spark.createDataFrame([([2.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 8.0],)], "to_lms array<double>")
    found = codes.through(row, {"xyz": [1, 1, 0, 0, 1, 0, 0, 0, 1]}).select("to_xyz", "from_xyz", codes.is_identity(matrix.multiply(F.col("to_xyz"), F.col("from_xyz"))), codes.is_identity(F.col("to_xyz"))).first()
    assert found[0] == [2, 4, 0, 0, 4, 0, 0, 0, 8] and found[1] == [0.5, -0.5, 0, 0, 0.25, 0, 0, 0, 0.125] and found[2:] == (True, False)


def test_command_line(spark, tmp_path, capsys):
    folder = str(tmp_path)
    spark.createDataFrame([(1, b"HEADbody", b"HEAD"), (2, b"TAIL", b"HEAD")], "file_id int, content binary, magic binary").write.parquet(f"{folder}/files.parquet")
    label = (1, 0, "cam", 4, 4, 1, hashlib.sha256(b"body").hexdigest(), "e")
    spark.createDataFrame([label], "file_id int, ordinal int, name string, offset_bytes int, size_bytes int, child_count int, hash string, signature string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "cam", 0, "iso", "200")], "file_id int, section string, ordinal int, name string, value string").write.parquet(f"{folder}/fields.parquet")
    run = lambda *a: (command_line.main(list(a), spark), capsys.readouterr().out.splitlines())
    assert run("info", folder) == (0, ["1  cam  at 4  4 Bytes  1 fields  Signed with Ed25519"])
    assert run("get", folder, "cam.iso") == (0, ["1  200"]) and run("get", folder, "cam.x") == (1, [])
    assert run("tree", folder) == (0, ["1  cam  iso: 200"])
    code, lines = run("verify", folder)
    assert code == 1 and lines[-1] == "2  INVALID" and "1  PASS  section cam" in lines and "1  VALID" in lines
    with pytest.raises(SystemExit):
        command_line.main(["get", folder], spark)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    sources.write(df, f"{tmp_path}/t.parquet")
    assert sorted(map(tuple, sources.table(spark, str(tmp_path), "t").collect())) == [(1, "a"), (2, None)]
    assert sources.long_format(df, "id", "s").collect()[0]["value"] == "a"
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert bytes(sources.files(spark, str(tmp_path), "*.bin").first()["content"]) == b"abc"


def test_columns_on_streams(spark, tmp_path):
    df = spark.createDataFrame([(5,), (300,)], "n bigint")
    df.write.parquet(f"{tmp_path}/in")
    from tessella.functions import bits

    stream = with_columns(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), {"w": bits.width_class(F.col("n"))})
    q = stream.writeStream.format("memory").queryName("widths").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("widths").collect())) == [(5, 3), (300, 4)]
    with pytest.raises(ValueError):
        with_columns(df, {})


def test_counts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:{s:02d}", v) for m in range(5) for s, v in ((1, 5), (30, 300), (31, 70000), (59, 2**40))]
    df = spark.createDataFrame(rows, "t string, v bigint").select(F.to_timestamp("t").alias("t"), "v")
    df.write.parquet(f"{tmp_path}/in")
    stream = width_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "t", "v", "2 minutes", "0 seconds")
    q = stream.writeStream.format("memory").queryName("width_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = sorted(map(tuple, width_counts(df, "t", "v", "2 minutes").collect()))
    assert sorted(map(tuple, spark.table("width_counts").collect())) == want and len(want) == 12 and sum(w[2] for w in want) == 20
