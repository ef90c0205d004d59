"""Tokens, packing, search, scorers, media and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import jpeg, packing, quality, samples, tokens, toxicity, vectors, words
from tessella.llm.queries import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  two  blanks ", "ends with blank ", "\nline\n\n next", "tab\tand nbsp", "it's they'll 'quoted' x'y", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "1²½ ③ Ⅷ ४", "日本語 テキスト", "emoji 👩‍👩‍👧 x",
    "é ß ñ Ÿ ǅ", "á b​ c", "\x1c\x1d x\x85y", "!!! ??? ...", "x" * 5000, "word " * 3000, "Ünïcode " * 10, " para ", "a  b", "tail\n",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "y"), (None, "no id", "z")], "doc_id bigint, text string, n_tokens string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_token_counts_are_the_library_s(odd, small):
    for df in (odd, small):
        found = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(df, PATH).collect())
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(ids_of(r["text"])), n > 1024) for r in df.collect())
        assert found == want
    assert tokens.token_counts(odd.limit(0), PATH).count() == 0


def test_full_caches_start_again(monkeypatch):
    monkeypatch.setattr(tokens, "WORKER_ENTRIES", 3)
    cache = tokens.ChunkCache(tokens.encoder(PATH), len, {"common": 1})
    text = "some quite different words and common common ones"
    assert sum(cache.parts(text)) == len(ids_of(text)) and len(cache.misses) <= 3


def test_packing_holds_each_id_once(odd, small):
    for df in (odd, small):
        rows = packing.pack(df, PATH, size=64).collect()
        by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
            by_doc[r["doc_id"]].append(r)
            by_sequence[r["sequence_id"]].append(r)
        want = collections.defaultdict(list)
        for r in df.collect():
            want[r["doc_id"]].append(ids_of(r["text"]) + [1])
        for doc, texts in want.items():
            if len(texts) == 1:
                pieces = sorted(by_doc[doc], key=lambda r: r["start"])
                assert [i for p in pieces for i in p["ids"]] == texts[0] and all(p["doc_tokens"] == len(texts[0]) for p in pieces)
            else:
                assert sum(p["length"] for p in by_doc[doc]) == sum(map(len, texts))
        for pieces in by_sequence.values():
            pieces.sort(key=lambda r: r["offset"])
            assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))] and sum(p["length"] for p in pieces) <= 64
        assert sum(r["length"] for r in rows) / (64 * len(by_sequence)) > 0.97
    assert packing.pack(odd.limit(0), PATH).count() == 0


def test_short_words_are_learned_whole():
    draw = random.Random(2)
    fill = lambda: [draw.choice(("river", "kyst", "stone", "of", "the", "walk", "green", "a")) for _ in range(12)]
    sample = [(" ".join([*fill(), *["kys"] * (i % 2), *fill()]), i % 2, 1.0) for i in range(400)]
    lexicon = toxicity.fit_lexicon(sample)
    match = toxicity.Matcher(lexicon)
    assert dict(lexicon.weights)["kys "] > 1 and not {"of ", "the ", "a "} & set(dict(lexicon.weights))
    assert match.score("the river, kys") > 0.7 > match.score("the river kyst") and match.score("KYS!") > 0.7


def test_balance_cuts_only_where_no_sequence_has_room():
    draw = random.Random(5)
    for _ in range(20):
        lengths = [draw.choice((draw.randrange(1, 60), draw.randrange(1, 2048), draw.randrange(1, 2048))) for _ in range(400)]
        places = packing.balance(lengths, 2048, 1 / 2048)
        pieces = {i: [] for i in range(len(lengths))}
        for k, own in enumerate(places):
            for i, start, n in own:
                pieces[i].append((start, n, k))
        room = [2048] * len(places)
        for i in sorted(pieces, key=lambda i: (-lengths[i], i)):
            left = lengths[i]
            for _, n, k in sorted(pieces[i]):
                assert n == left or max(room) < left
                room[k], left = room[k] - n, left - n


def test_balance_levels_costs():
    draw = random.Random(1)
    lengths = [draw.randrange(1, 900) for _ in range(400)]
    places = packing.balance(lengths, 2048, 1 / 2048)
    assert sum(n for s in places for _, _, n in s) == sum(lengths) and len(places) == -(-sum(lengths) // 2048)
    seen = collections.defaultdict(list)
    for s in places:
        for i, start, n in s:
            seen[i].append((start, n))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) == lengths[i] for i, v in seen.items())
    costs = [sum(packing.attention_cost(n, 1 / 2048) for _, _, n in s) for s in places]
    naive = [sum(packing.attention_cost(n, 1 / 2048) for n in chunk) for chunk in (lengths[i : i + len(lengths) // len(places)] for i in range(0, len(lengths), len(lengths) // len(places)))]
    assert np.std(costs) < np.std(naive)


def test_words_are_those_of_python():
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab \t\né X") for _ in range(draw.randrange(60))) for _ in range(300)] + ["", " ", "a" * 200_000 + " b"]
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, ends = words.word_spans(data)
        got = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        assert got == re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
        hashes = words.word_hashes(data, starts, ends)
        assert len(set(hashes.tolist())) == len(set(got))


# --- search


def test_search_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vectors, "TILE", 3)
    monkeypatch.setattr(vectors, "WIDTH", 2)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 6)).round(1)
    x[50:150] = x[50]  # copies of one vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(399, x[398].tolist(), "x"), (1000, None, "x"), (1001, [1.0, None], "x"), (1002, [float("nan")] * 6, "x"), (1003, [float("inf")] * 6, "x"), (1004, [], "x"), (1005, [1e30] * 6, "x"), (1006, [2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    plain = [(i, np.floor(1024 * np.float32(v).astype(np.float64)).tolist()) for i, v, _ in rows[:401]] + [(1004, []), (1006, [2048.0])]
    df = df.filter("vec_id <> 1005")
    dot = lambda a, b: int(sum(p * q for p, q in zip(a, b)))
    want = []
    for q, own in plain:
        if q % 50:
            continue
        best = sorted((-dot(own, v), i) for i, v in plain if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, vectors.search(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)
    assert vectors.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = df.filter("vec_id IN (0, 1, 2)")
    assert vectors.search(few, F.col("vec_id") == 0).count() == 2


def test_huge_components_are_ranked_exactly(spark):
    rows = [(0, [1e30, 1.0]), (1, [1.0, 1.0]), (2, [-1e30, 2.0]), (3, [9e15, 1.0]), (4, [9e15, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = vectors.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [4, 3, 1, 2] and [r["score"] for r in found][::3] == [2**63 - 1, -(2**63)]


@pytest.mark.parametrize("spread, share", [(0.02, 0.5), (None, 1.0)])
def test_search_expands_annuli_until_the_bounds_exclude_the_rest(spark, monkeypatch, spread, share):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    draw = np.random.default_rng(2)
    middles = draw.normal(size=(24, 16))
    x = middles[np.arange(1200) % 24] + spread * draw.normal(size=(1200, 16)) if spread else draw.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    report, e = {}, np.floor(1024 * x)
    found = {(r["query_id"], r["rank"]): r["score"] for r in vectors.search(df, F.col("vec_id") % 40 == 0, report=report).collect()}
    for q in range(0, 1200, 40):
        best = np.sort(np.delete(e @ e[q], q))[::-1][:10]
        assert [found[q, k + 1] for k in range(10)] == best.tolist()
    assert report["queries"] == 30 and report["annuli"] >= 34 and report["scanned"] <= share * report["pairs"]


# --- scorers


def accuracy(spark, sf, scored, label):
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(a == b for a, b in rows) / len(rows)


def test_quality_on_held_out_documents(spark):
    scored = queries()["op8_quality"](spark, "/root/testdata/sf0.1")
    assert accuracy(spark, "sf0.1", scored, "quality") > 0.96


def test_toxicity_on_held_out_documents(spark):
    scored = queries()["op9_toxicity"](spark, "/root/testdata/sf0.1")
    assert accuracy(spark, "sf0.1", scored, "toxic") > 0.97


def test_forward_backward_by_brute_force():
    draw = np.random.default_rng(3)
    lines = np.array([1, 4, 2, 6])
    scores, moves = draw.normal(size=(lines.sum(), 2)), draw.normal(size=(2, 2))
    own, counts, logs = quality.marginals(scores, lines, moves)
    at, all_counts = 0, np.zeros((2, 2))
    for d, n in enumerate(lines):
        total, line, pair = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weight = np.exp(sum(scores[at + i, y[i]] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)))
            total += weight
            for i in range(n):
                line[i, y[i]] += weight
            for a, b in zip(y, y[1:]):
                pair[a, b] += weight
        assert np.allclose(own[at : at + n], line / total) and np.isclose(logs[d], np.log(total))
        all_counts += pair / total
        at += n
    assert np.allclose(counts, all_counts)


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T іdіоt $tupid!") == " idiot idiot stupid  "
    match = toxicity.Matcher(toxicity.Lexicon((("idiot", 3.0), ("trash", 2.0)), toxicity.EXCEPTIONS, (1.0, 0.0, 0.0, 0.0, 0.0)))
    density = lambda text: match.features(text)[0]
    assert density("the trash can is full") == 0 and density("the trash is full") > 0 and density("You IDI0TS, idi​ot") > density("idiot")
    assert density("videotrash myidiot") == 0 and density("") == 0


def test_look_alike_letters_are_folded():
    match = toxicity.Matcher(toxicity.Lexicon((("idiot", 3.0), ("réeux", 2.0)), (), (1.0, 0.0, 0.0, 0.0, 0.0)))
    for word in ("idiot", "ïdiöt", "idiòt", "𝐢𝐝𝐢𝐨𝐭", "ⅰdiot", "ιdıot", "1D10T", "ｉｄｉｏｔ", "i\u0301diot", "i\u200bdiot", "ⓘⓓⓘⓞⓣ", "idіоt"):
        assert match.features(f"you {word}")[0] > 0, word
    assert match.features("réeux")[0] > 0 and match.features("re\u0301eux")[0] > 0 and match.features("reeux")[0] == 0


def test_lexicon_by_naive_scan():
    draw = random.Random(6)
    weights = {w: float(k + 1) for k, w in enumerate(("ab", "abc", "b", "ca ", "cab", "bb "))}
    phrases = ("ab ca", "b b", "cab ab b")
    match = toxicity.Matcher(toxicity.Lexicon(tuple(weights.items()), phrases, (1.0, 0.0, 0.0, 0.0, 0.0)))
    for _ in range(500):
        folded = toxicity.fold(" ".join("".join(draw.choice("abc") for _ in range(draw.randrange(1, 5))) for _ in range(draw.randrange(12))))
        safe = [(i, i + len(p) + 1) for p in phrases for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        total = 0.0
        for i, c in enumerate(folded):
            found = [w for w in weights if folded.startswith(f" {w}", i)]
            if found and not any(a <= i < b for a, b in safe):
                total += weights[max(found, key=len)]
        assert np.isclose(match.features(folded)[0], np.arcsinh(total)), folded


def test_exception_phrases_take_time_in_proportion():
    import time

    match = toxicity.Matcher(toxicity.Lexicon((("trash", 2.0),), toxicity.EXCEPTIONS, (1.0, 0.0, 0.0, 0.0, 0.0)))
    began = time.perf_counter()
    assert match.features("trash can " * 200_000)[0] == 0 and time.perf_counter() - began < 5


def test_the_caller_s_lists_are_taken():
    sample = [("some plain words here", 0, 1.0), ("some zork words here", 1, 1.0)] * 3
    lexicon = toxicity.fit_lexicon(sample, least=9, seeds=("blarg",), exceptions=("blarg day",))
    assert [w for w, _ in lexicon.weights] == ["blarg"] and lexicon.exceptions == ("blarg day",)


def test_quality_in_pieces_is_quality_whole(monkeypatch):
    draw = np.random.default_rng(4)
    texts = ["a b\nc D d\n\nE!", "", "x y\n" * 40, "one", "7\n8 8"]
    field = quality.Field(tuple(draw.normal(size=quality.FEATURES)), ((0.3, -0.2), (0.1, 0.4)), (1.0, 0.2))
    features, lines, _ = quality.line_features(texts)
    good = features @ np.array(field.weights)
    want = []
    for d, text in enumerate(texts):  # marginals by all labellings of up to 12 lines, else by the chain alone
        at, n = lines[:d].sum(), lines[d]
        size = np.array([len(x.encode()) + 1 for x in text.split("\n")])
        s = np.column_stack([np.zeros(n), good[at : at + n]])
        own = quality._chain(s, np.array(field.moves))[0] if n > 12 else None
        if own is None:
            own, total = np.zeros((n, 2)), 0.0
            for code in range(2**n):
                y = [code >> i & 1 for i in range(n)]
                weight = np.exp(sum(s[i, y[i]] for i in range(n)) + sum(field.moves[a][b] for a, b in zip(y, y[1:])))
                total += weight
                own[np.arange(n), y] += weight
            own /= total
        mean = (own[:, 1] * size).sum() / size.sum()
        want.append(1 / (1 + np.exp(-(np.log(mean / (1 - mean)) + 0.2))))
    for chunk, chain in ((1 << 15, 4096), (3, 2), (1, 1)):
        monkeypatch.setattr(quality, "CHUNK_LINES", chunk)
        monkeypatch.setattr(quality, "LONG_CHAIN", chain)
        assert np.allclose(field.score(texts), want)


def test_quality_of_a_text_of_very_many_lines():
    import tracemalloc

    field = quality.Field((0.1,) * quality.FEATURES, ((0.1, 0.0), (0.0, 0.1)), (1.0, 0.0))
    tracemalloc.start()
    assert 0 <= field.score(["\n" * 200_000])[0] <= 1 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_samples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(40)] + [(0, "y"), (None, "z")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    found = samples.labelled_sample(docs, labels, "toxic", 3, 1, 100, limit_bytes=5500)
    assert 5 <= len(found) <= 6 and sum(len(t) for t, _, _ in found) <= 5500 and len(samples.labelled_sample(docs, labels, "toxic", 3, 1, 100)) == len(samples.labelled_sample(docs.dropDuplicates(), labels, "toxic", 3, 1, 100))


def test_scorers_edge_cases(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (4, 1, 0), (5, 0, 1)], "doc_id bigint, quality int, toxic int")
    for module, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        model = module.train(odd, labels)
        rows = score(odd.withColumn("score", F.lit("x")), model).collect()
        assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
        assert score(odd.limit(0), model).count() == 0
        none = module.train(odd, labels.limit(0))
        assert score(odd, none).count() == len(ODD) + 2


# --- media


def test_media_round_trip(odd, small):
    for df in (odd, small):
        texts = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        want = collections.Counter()
        for doc, raw in texts:
            padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            want[doc, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
        rows = jpeg.read_media(jpeg.store_texts(df)).collect()
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert jpeg.read_media(jpeg.store_texts(odd.limit(0))).count() == 0


def test_tensors_are_stored(odd, monkeypatch):
    monkeypatch.setattr(jpeg, "READ_BYTES", 4000)
    rows = jpeg.read_media(jpeg.store_texts(odd.select("doc_id", "text", F.lit("x").alias("rgb"))), keep_tensors=True).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        rgb = np.frombuffer(r["rgb"], dtype=np.uint8).reshape(r["height"], r["width"], 3)
        assert jpeg.feature(rgb) == r["feature"] and r["height"] % 16 == r["width"] % 16 == 0
    whole = jpeg.Reader(jpeg.encode_payloads([bytes(range(256)) * 40])[0])
    want = whole.rgb()
    monkeypatch.setattr(jpeg, "CHUNK_BLOCKS", 5)
    assert (whole.rgb() == want).all()


def test_array_and_symbol_readers_agree():
    draw = random.Random(1)
    for n in (64, 448, 64 * 60):
        for payload in (bytes(draw.randrange(256) for _ in range(n)), bytes([255]) * n, bytes(n)):
            media = jpeg.encode_payloads([payload])[0]
            fast, slow = jpeg.Reader(media), jpeg.Reader(media, fast=False)
            assert fast.payload() == slow.payload() == payload
            assert (fast.rgb() == slow.rgb()).all()


def test_runs_of_ends_and_new_coefficients():
    """A gray file of two blocks with end-of-band runs and refinement that makes a coefficient, written bit by bit."""
    seg = jpeg._segment
    frame = seg(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    table = lambda kind, symbols: seg(0xC4, bytes([kind]) + bytes([0, len(symbols)]) + bytes(14) + bytes(symbols))
    pack = lambda bits: (lambda b: int(b, 2).to_bytes(len(b) // 8, "big"))(bits + "1" * (-len(bits) % 8))
    scan = lambda ss, se, a: seg(0xDA, bytes([1, 1, 0, ss, se, a]))
    head = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([1] * 64)) + frame
    dc = table(0x00, [0, 3]) + scan(0, 0, 0) + pack("01" + "101" + "00")  # difference 5, then 0
    ac = table(0x10, [0x01, 0x11, 0x10]) + scan(1, 5, 0x01) + pack("00" + "1" + "10" + "0")  # first coefficient 1 << 1, then a run that ends 2 blocks
    refine = scan(1, 5, 0x10) + pack("01" + "0" + "1" + "10" + "0")  # corrects the first by one, skips a zero, then a new -1; a run ends both
    reader = jpeg.Reader(head + dc + ac + refine + b"\xff\xd9")
    blocks = next(iter(reader.components.values())).blocks
    assert blocks[0, :6].tolist() == [5, 3, 0, -1, 0, 0] and blocks[1].tolist() == [5] + [0] * 63
    assert reader.rgb().shape == (8, 16, 3)


def test_inverse_transform_and_chroma():
    flat = np.zeros((1, 64))
    flat[0, 0] = 8 * 50
    assert np.allclose(flat @ jpeg._INVERSE / 4096, 50, atol=0.1)
    x = np.random.default_rng(1).normal(size=(4, 64))
    assert np.allclose((x @ jpeg._INVERSE / 4096) @ (jpeg._INVERSE / 4096).T, x, atol=0.01)
    media = jpeg.encode_payloads([bytes(64)])[0]
    planes = jpeg.Reader(media).planes()
    assert all(p.shape == (16, 16) for p in planes) and (planes[1][::2, ::2] == planes[1][1::2, 1::2]).all()


def test_broken_files_are_told():
    media = jpeg.encode_payloads([b"x" * 64])[0]
    for bad in (b"", b"\xff\xd8", media[:-2], media[:100], b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00\xff\xd9"):
        with pytest.raises(jpeg.JpegError):
            jpeg.Reader(bad)


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.park(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts[name] = docs.count()
        if name != "mixing":
            assert docs.select("doc_id").distinct().count() == counts[name]
            assert docs.filter("n_chars <> length(text)").count() == 0
    assert before > counts["toxicity"] >= counts["line_dedup"] >= counts["near_duplicates"] > 0.5 * before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    want = sum(len(ids_of(r["text"])) + 1 for r in docs.collect())
    assert pieces.agg(F.sum("length")).first()[0] == want
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    line = "a line that is long enough to be counted"
    rows = [(1, None, None, None, None), (None, "text without id", "en", "s", 3), (2, "", "en", "s", 0), (3, "x y", None, None, None), (3, "x y", None, None, None), (4, long, "en", "t", 9), (5, f"{line}\nown five words are here now", "en", "t", 1)]
    rows += [(6 + i, f"{line}\n{i} others say other things", "en", "t", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = ["key", "size", "score", "held_out", "own", "node", "copies", "taken", "mark", "wordless", "start", "length", "n_lines", "r", "cut"]
    docs = docs.select("*", *[F.lit("x").alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = out.collect()
        ids = collections.Counter(r["doc_id"] for r in got)
        if name in ("toxicity", "line_dedup"):
            assert len(got) == len(rows)
        elif name == "near_duplicates":
            assert ids == collections.Counter([1, None, 2, 3, 4, 5, 6, 7, 8])
        elif name == "packing":
            assert ids[4] > 10 and sum(r["length"] for r in got) == sum(len(ids_of(r[1])) + 1 for r in rows)
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in ("red", "blue", "green"))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, c), (None, c), (None, a), (None, ""), (None, None), (None, ""), (3, ""), (4, ""), (5, b + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert collections.Counter(kept) == collections.Counter([(1, a), (2, b), (None, c), (None, ""), (None, ""), (None, None), (3, ""), (4, "")])
