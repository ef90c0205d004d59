"""Page text, line dedup, near-duplicates, mixing: edge cases and brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, graph, linededup, mixing, neardup, pages
from tessella.llm.queries import oracle_sql, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(name, same_rows):
    same_rows(queries()[name], oracle_sql()[name])


# --- pages


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in pages.extract_text(df).collect()}


def test_blocks_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><a href="/">Home</a></nav>
    <main><h1>One &amp; two</h1><p>First <b>bold</b>word&nbsp;here<br>next<p>Second<script>var a="</p><p>no";</script> end</p><ul><li>a<li>b</ul>
    <div class="advert">buy</div><aside>side</aside><form>mail</form><section id="comments"><p>great</p></section><div hidden>x</div></main>
    <p>outside</p><footer>&copy; me</footer>"""
    kept = [x.text for x in pages.lines_of(page) if x.core and not x.out]
    assert kept == ["One & two", "First boldword here next", "Second end", "a", "b"]


def test_odd_markup():
    assert [x.text for x in pages.lines_of("a < b and <3 <p title='x > y'>c</p><!-- <p>d --> e")] == ["a < b and <3", "c", "e"]
    assert pages.lines_of("") == [] and pages.lines_of("<script>never closed <p>x") == []
    assert [x.text for x in pages.lines_of("<div><p>x</div></p></span>y")] == ["x", "y"]
    assert [x.text for x in pages.lines_of("<p>" + "word " * 100_000)] == [" ".join(["word"] * 100_000)]


def test_articles_keep_parts_whose_slugs_or_values_hold_marks():
    page = """<article><section id="related-work"><p>a</p></section><div id="social-effects">b</div><h2 id="menu-planning">c</h2><h2 id="comments">d</h2>
    <p>see <a href="/hidden-gems">the gems</a> and <a title="the hidden cost" href="/p?id=comments">its cost</a> here</p><p data-hidden="1" data-class=ad>e</p>
    <div class="tag-share-prices">f</div><div class="box share">no</div><div id="comments">no</div><p hidden>no</p><p style="display: none">no</p><div role=navigation>no</div></article>"""
    assert [x.text for x in pages.lines_of(page) if x.core and not x.out] == ["a", "b", "c", "d", "see the gems and its cost here", "e", "f"]
    assert [x.text for x in pages.lines_of("<article id='comments-on-tax'>x</article><article class='comment-body'>y</article>") if not x.out] == ["x"]


def test_quoted_values_of_any_length_end_no_tag():
    props = "<p>a > b</p>" * 50_000
    assert [x.text for x in pages.lines_of(f"<article data-props='{props}'><p title=\"{props}\">x</p></article><p>y</p>")] == ["x", "y"]
    assert [x.text for x in pages.lines_of("<p title=\"never closed>x</p><p>it's</p><p title=Bob's>z</p>")] == ["x", "it's", "z"]
    assert [x.text for x in pages.lines_of("<p data-a='" + "w " * 5_000 + ">" + "'>x</p>" + "<p a='>" * 2_000)][0] == "x"


def test_shared_lines_are_a_longest_common_subsequence():
    draw = random.Random(3)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0] * (len(b) + 1), row
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1]

    for _ in range(200):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(12))] for _ in range(2))
        found = [a[i] for i in pages.shared_lines(a, b)]
        rest = iter(b)
        assert len(found) == longest(a, b) and all(x in rest for x in found)


def test_differencing_deletes_what_pages_of_a_host_share(spark):
    page = "<body><div>Menu line</div><p>{}</p><div>Imprint</div></body>"
    found = texts(spark, [(1, "http://a.com/x/1", page.format("One")), (2, "http://a.com/x/2?q=1", page.format("Two")), (3, "http://b.com/x/1", page.format("Three"))])
    assert found == {1: "One", 2: "Two", 3: "Menu line\nThree\nImprint"}


def test_articles_keep_lines_that_others_cite(spark):
    page = "<article><h1>{}</h1><p>Cited.</p><p><a href='/'>Read more</a></p></article>"
    assert texts(spark, [(1, "http://a.com/1", page.format("A")), (2, "http://a.com/2", page.format("B"))]) == {1: "A\nCited.", 2: "B\nCited."}


def test_long_pages_align_in_little_memory():
    import tracemalloc

    a = [i if i % 7 else -1 for i in range(12_000)]
    b = [x for i, x in enumerate(a) if i % 5] + [-2] * 50
    tracemalloc.start()
    found = pages.shared_lines([-3, *a], [-4, *b])
    assert len(found) == 9_600 and tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_copies_of_a_page_keep_their_text(spark):
    page, other = "<body><div>Menu</div><p>Text of the page</p></body>", "<body><div>Menu</div><p>Another</p></body>"
    rows = [(i, "http://a.com/p", page) for i in range(40)] + [(50, "http://a.com/q", other), (1, "http://b.com/p", page), (2, "http://b.com/p", page)]
    found = collections.Counter((r["page_id"], r["url"], r["text"]) for r in pages.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    want = [(i, "http://a.com/p", "Text of the page") for i in range(40)] + [(50, "http://a.com/q", "Another")] + [(i, "http://b.com/p", "Menu\nText of the page") for i in (1, 2)]
    assert found == collections.Counter(want)


def test_pages_by_brute_force(spark):
    """Every page against a plain statement of the rule: the nearest other content of the host, a quadratic alignment, then the marks."""
    draw = random.Random(11)
    menus = {h: [f"{h} link {i}" for i in range(6)] for h in ("a.com", "b.com", "c.com")}
    rows = []
    for i in range(60):
        host = draw.choice(["a.com", "a.com", "b.com", "c.com"])
        body = [f"own {draw.randrange(30)} of it" for _ in range(draw.randrange(5))]
        parts = [f"<div>{x}</div>" for x in menus[host] if draw.random() < 0.8] + [f"<p>{x}</p>" for x in body] + [f"<div class='ad'>buy {i}</div>", f"<div>end of {host}</div>"]
        if draw.random() < 0.4:
            parts = [*parts[:4], "<article>", *parts[4:-2], f"<p><a href='/'>{host} more</a></p>", "</article>", *parts[-2:]]
        rows.append((i, f"http://{host}/{draw.choice('xyz')}/{draw.randrange(300)}", "".join(parts)))
    rows += [(100 + i, u, h) for i, (_, u, h) in enumerate(rows[:8])]  # copies

    def common(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        return n[-1][-1]

    host_path = lambda u: (u.split("/")[2], "/" + u.split("/", 3)[3])
    blocks = {i: pages.lines_of(h) for i, _, h in rows}
    got = {r["page_id"]: r for r in pages.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    changed = 0
    for i, url, _ in rows:
        host, path = host_path(url)
        own = [x.text for x in blocks[i]]
        others = [(k, host_path(u)[1]) for k, u, _ in rows if host_path(u)[0] == host and [x.text for x in blocks[k]] != own]
        alike = lambda p: (1 << 30) if p == path else next((n for n, (x, y) in enumerate(zip(p, path)) if x != y), min(len(p), len(path)))
        best = max(alike(p) for _, p in others)
        stays = {common(own, [x.text for x in blocks[k]]) for k, p in others if alike(p) == best}
        marked = any(x.core and not x.out for x in blocks[i])
        plain = [x for x in blocks[i] if not (x.out or marked and not x.core)]
        text = got[i]["text"].split("\n") if got[i]["text"] else []
        assert got[i]["n_lines"] == len(own) and got[i]["n_shared"] + got[i]["n_marked"] + len(text) == len(own)
        firm = [x.text for x in plain if x.core and x.linked < 0.5]
        assert firm == [x for x in text if x in firm] and set(text) <= {x.text for x in plain}
        assert got[i]["n_shared"] <= max(stays)
        if not marked:
            assert got[i]["n_shared"] in stays
            changed += [x.text for x in plain] != text
    assert changed > 20


def test_tables_of_pages_are_written_in_few_files(spark, monkeypatch):
    """Not one for each shuffle partition; findings that are broadcast and findings that are shuffled give the same rows."""
    parked = {}

    def park(df, name):
        out = common.park(df, name)
        parked[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(pages, "park", park)
    html = "<body><div>Menu of {0}</div><p>Own {1}</p><div>{2}</div><div class='ad'>buy</div></body>"
    rows = [(i, f"http://{'abc'[i % 3]}.com/{i * 7 % 400}/{i}", html.format("abc"[i % 3], i // 2, "Imprint" * (i % 4 > 0))) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:9], "page_id bigint, url string, html string").coalesce(2)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        wide = pages.extract_text(df)
        assert max(parked.values()) <= 2 * spark.sparkContext.defaultParallelism and "SortMergeJoin" not in wide._jdf.queryExecution().sparkPlan().toString()
        found = sorted(wide.collect())
        shuffled = pages.extract_text(df, broadcast=0)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().sparkPlan().toString() and sorted(shuffled.collect()) == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert sorted(pages.extract_text(df).collect()) == found and len(found) == 409 and sum(r["n_shared"] for r in found) > 400


def test_neighbours_beyond_a_part_and_its_batches():
    """The rows with another content next to each row of a part, by a plain search; a part goes over batches, and a batch over parts."""
    draw = random.Random(5)
    rows = [(part, draw.randrange(2 + part % 3)) for part in range(12) for _ in range(draw.randrange(30))]
    kind = pa.struct([("at", pa.int64()), ("content", pa.int64())])
    table = pa.table({"part": [p for p, _ in rows], "row": pa.array([{"at": i, "content": c} for i, (_, c) in enumerate(rows)], kind), "content": [c for _, c in rows]})
    found = pa.Table.from_batches(pages._beside(table.to_batches(max_chunksize=7))).to_pylist()
    for i, (part, content) in enumerate(rows):
        own = [k for k, (p, _) in enumerate(rows) if p == part]
        want = [next((k for k in order if rows[k][1] != content), None) for order in ([k for k in own if k < i][::-1], [k for k in own if k > i])]
        assert [(found[i][x] or {}).get("at") for x in ("row", "before", "after")] == [i, *want]
        assert (found[i]["part"], found[i]["first"], found[i]["last"]) == (part, i == own[0], i == own[-1])
    assert len(found) == len(rows)


def test_page_edge_cases(spark):
    found = texts(spark, [(1, None, None), (2, None, ""), (3, "no url", "<p>x</p>"), (None, "http://a/", "<p>y</p>"), (3, "no url", "<p>x</p>")])
    assert found[1] == "" and found[2] == "" and found[None] == "y" and found[3] == "x"
    assert texts(spark, []) == {}


# --- line dedup


def test_lines_by_brute_force(spark):
    draw = random.Random(5)
    pool = [f"A Shared line number {i:02d} of the pool" for i in range(12)] + ["short"]
    rows = [(i, "\n".join(draw.choice(pool).upper() if draw.random() < 0.2 else f"  {draw.choice(pool)}\t" if draw.random() < 0.2 else draw.choice(pool) for _ in range(draw.randrange(9)))) for i in range(60)]
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            holders[key(line)].add(i)
    want = {}
    for i, text in rows:
        kept = [x for x in text.split("\n") if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        want[i] = ("\n".join(kept), text.count("\n") + 1, text.count("\n") + 1 - len(kept))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for batches in (1, 5):
        assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(df, batches=batches).collect()} == want


def test_line_edge_cases(spark):
    line = "this line is long enough to count"
    rows = [(1, line, "x"), (1, line, "x"), (2, None, "y"), (None, line, "z"), (3, "", None), (4, f"{line}\n{line}\nown", None), (5, "é" * 20, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string")
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "", 1, 1), (1, "", 1, 1), (2, "", 1, 0), (None, "", 1, 1), (3, "", 1, 0), (4, f"{line}\n{line}\nown", 3, 0), (5, "é" * 20, 1, 0)], key=repr)
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    by_name = spark.createDataFrame([("a", line), ("b", line), ("c", line)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(by_name).collect()} == {"a": 1, "b": 1, "c": 0}
    clash = ["own", "own_id", "own_hash", "own_lines", "dropped_id", "dropped_hash", "dropped_at", "h", "hs", "pos", "last"]
    odd = df.drop("n_lines").select("*", *[F.lit(c).alias(c) for c in clash])
    got = linededup.dedup_lines(odd)
    assert got.columns == ["doc_id", "text", *clash, "n_lines", "n_dropped"] and got.filter(" AND ".join(f"{c} = '{c}'" for c in clash)).count() == 7
    long = spark.createDataFrame([(i, "\n".join([f"line {k} of very many lines" for k in range(30_000)] + [str(i)])) for i in range(3)], "doc_id bigint, text string")
    assert {r["doc_id"]: (r["n_dropped"], r["text"]) for r in linededup.dedup_lines(long).filter("doc_id < 2").collect()} == {i: (30_000, str(i)) for i in range(2)}


def test_ids_without_numbers_come_in_batches_too(spark, monkeypatch):
    taken = []
    own = linededup.LineRuns.add
    monkeypatch.setattr(linededup.LineRuns, "add", lambda self, batch: (taken.append(batch.count()), own(self, batch))[1])
    rows = [(f"id{i:03d}", f"a line that {i % 20} documents have") for i in range(200)]
    found = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string"), batches=4).collect()
    assert len(taken) == 4 and min(taken) > 0 and sum(r["n_dropped"] for r in found) == 180 and {r["doc_id"] for r in found if not r["n_dropped"]} == {f"id{i:03d}" for i in range(180, 200)}


def test_runs_are_joined_without_an_exchange(spark):
    runs = linededup.LineRuns(spark, fan_in=3)
    lines = spark.createDataFrame([(f"{i % 40:032x}", i) for i in range(400)] + [("once", 5), ("twice", 250), ("twice", 3)], "h string, doc_id bigint")
    for low in (380, 300, 270, 200, 100, 0):
        part = lines.filter(f"doc_id >= {low} AND doc_id < {dict([(380, 400), (300, 380), (270, 300), (200, 270), (100, 200), (0, 100)])[low]}")
        plan = runs.counted(part)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1  # the batch's own
        runs.add(part)
    assert [len(x) for x in runs.levels] == [0, 2]
    assert sorted((r["h"], r["last"]) for r in runs.settled().collect()) == [(f"{i % 40:032x}", i) for i in range(360, 400)]
    runs.close()


# --- near-duplicates


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_by_brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            p, q = root(i), root(j)
            up[max(p, q)] = min(p, q)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def edited(words, share, draw):
    return " ".join(w if draw.random() > share else f"{w}{draw.randrange(9)}" for w in words)


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 8)
    draw = random.Random(7)
    rows = []
    for g in range(6):
        base = [f"w{draw.randrange(500)}" for _ in range(draw.choice([12, 60, 200]))]
        rows += [edited(base, draw.choice([0, 0.01, 0.02, 0.05]), draw) for _ in range(draw.choice([2, 5, 40]))]
    rows += ["one two", "ONE  two", "one", "", " \t", "one two three four five", "one two three four five six"]
    rows += [" ".join(f"s{g}w{i}" for i in range(a, b)) for g in range(4) for a, b in ((0, 9), (1, 9), (0, 8), (0, 7), (1, 11), (0, 12))]
    rows = list(enumerate(rows))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert found == near_by_brute_force(rows)


def test_near_duplicates_of_a_whole_table(spark):
    """Every link of the 10,000 documents of sf0.1, by an exact join of prefixes, must be in the components, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    members = collections.defaultdict(list)
    for i, t in texts.items():
        members[frozenset(shingles(t))].append(i)
    members.pop(frozenset(), None)
    sets, often = sorted(members, key=len), collections.Counter(x for s in members for x in s)
    up, holders, links = list(range(len(sets))), collections.defaultdict(list), 0

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        near = set()
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-75 * len(s) // 100) + 1]:
            near.update(j for j in holders[x] if 100 * len(sets[j]) >= 75 * len(s))
            holders[x].append(k)
        for j in near:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                links += 1
                up[max(root(j), root(k))] = min(root(j), root(k))
    whole = collections.defaultdict(list)
    for k, s in enumerate(sets):
        whole[root(k)] += members[s]
    want = {i: i for i in texts} | {i: min(ids) for ids in whole.values() for i in ids}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert links > 100 and got == want


def test_small_sets_that_are_linked_share_a_key():
    draw = random.Random(9)
    for _ in range(300):
        a = np.array(draw.sample(range(2**60), draw.randrange(1, 11)), dtype=np.uint64)
        b = np.array((draw.sample(a.tolist(), draw.randrange(len(a) + 1)) + draw.sample(range(2**60), 3))[: draw.randrange(1, 11)], dtype=np.uint64)
        if 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b)):
            assert set(neardup.common_parts(a, 75)) & set(neardup.common_parts(b, 75))


def test_long_texts_make_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SET_UNIT", 100)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 32)
    base = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join([*base[40 * i :], *(f"v{i}x{j}" for j in range(40 * i))])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()} == near_by_brute_force(rows)


def test_near_duplicate_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, 1), (3, text, 2), (3, text, 3), (None, text, 4), (7, None, 5), (8, "", 6)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, node bigint"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(5, 46, 3, False), (3, 46, 3, True), (3, 46, 3, True), (None, 46, None, True), (7, 0, 7, True), (8, 0, 8, True)], key=repr)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_that_have_not_settled_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a bigint, b bigint")
    with pytest.raises(RuntimeError, match="settled in 1 rounds"):
        graph.components(chain, rounds=1)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


# --- mixing


def test_targets_stop_at_twice_the_source():
    targets = mixing.source_targets([("b", 100), ("a", 1000), (None, 10), ("", 0), ("c", 500)], (5, 2, 1), 1.5, 2.0)
    assert list(sorted(targets, key=lambda s: (s is None, s or ""))) == ["", "a", "b", "c", None]
    assert abs(sum(targets.values()) - 1.5 * 1610) < 1e-6
    assert targets[""] == 0 and targets["b"] == 200 and all(targets[s] <= 2 * n + 1e-9 for s, n in (("a", 1000), ("c", 500), (None, 10)))
    assert mixing.source_targets([], (5, 2, 1), 1.5, 2.0) == {}


def test_pivot_keeps_words_and_rounds_all_but_one():
    draw = random.Random(1)
    sizes = [draw.randrange(1, 50) for _ in range(300)]
    shares = [draw.random() for _ in sizes]
    out, carry = mixing.pivot(sizes, shares, draw)
    assert abs(sum(a * b for a, b in zip(sizes, out)) - sum(a * b for a, b in zip(sizes, shares))) < 1e-6
    assert [i for i, p in enumerate(out) if 0 < p < 1] in ([], [carry])


def test_pivot_keeps_each_share_in_expectation():
    draw, sizes, shares = random.Random(2), [3, 5, 2, 7], [0.3, 0.6, 0.5, 0.2]
    mean = [0.0] * 4
    for _ in range(4000):
        out, _ = mixing.pivot(sizes, shares, draw)
        mean = [m + p / 4000 for m, p in zip(mean, out)]
    assert all(abs(m - p) < 0.03 for m, p in zip(mean, shares))


def test_mix_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.randrange(40)), "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    a = mixing.mix(df).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert len(a) == 400 and all(0 <= r["taken"] <= 2 * r["size"] for r in a)
    for source in {r["source"] for r in a}:
        own = [r for r in a if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and own[0]["source_size"] == sum(r["size"] for r in own)
    whole = {r["doc_id"]: r for r in mixing.mix(df, cut_last=False).collect()}
    assert all(r["taken"] == r["size"] * r["copies"] for r in whole.values())
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(df, cut_last=False).collect())
    assert copies == {i: r["copies"] for i, r in whole.items() if r["copies"]}
    words = collections.Counter()
    for r in mixing.mixed_documents(df).collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert {i: n for i, n in words.items() if n} == {r["doc_id"]: r["taken"] for r in a if r["taken"]}


def test_mix_by_a_plain_tree(spark, monkeypatch):
    """The whole mix against pivotal rounding written out document by document, with leaves and nodes as plain lists."""
    monkeypatch.setattr(mixing, "LEAF_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    draw = random.Random(8)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 5, 5, 5, 30, 200])), draw.choice(["hot", "hot", "hot", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    marks = {r["doc_id"]: r["m"] for r in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(17)).alias("m")).collect()}
    sizes = {i: len(t.split()) for i, t, _ in rows}
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total, want = sum(sizes.values()), {}
    targets = mixing.source_targets([(s, sum(sizes[i] for i, _, x in rows if x == s)) for s in order], (5, 2, 1), 1.5, 2.0)
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    for source in order:
        own = [i for i, _, s in rows if s == source]
        ratio = min(2.0, targets[source] / sum(sizes[i] for i in own))
        share = {i: ratio - int(ratio) if sizes[i] else 0.0 for i in own}
        count, level = -(-len(own) // 16), 0
        groups = {k: [i for i in own if marks[i] % count == k] for k in range(count)}
        while True:
            left = {}
            for k, ids in groups.items():
                carry, toss = None, random.Random(f"17/{level}/{source}/{k}")
                for i in sorted(ids, key=lambda i: (-sizes[i], marks[i])):
                    if not 0 < share[i] < 1:
                        continue
                    if carry is None:
                        carry = i
                        continue
                    a, b = carry, i
                    give = {True: min(sizes[a] * (1 - share[a]), sizes[b] * share[b]), False: min(sizes[a] * share[a], sizes[b] * (1 - share[b]))}
                    up = toss.random() * (give[True] + give[False]) < give[False]
                    moved = give[up] if up else -give[up]
                    share[a], share[b] = share[a] + moved / sizes[a], share[b] - moved / sizes[b]
                    for x in (a, b):
                        share[x] = round(share[x], 12) if abs(share[x] - round(share[x])) < 1e-9 else share[x]
                    carry = next((x for x in (a, b) if 0 < share[x] < 1), None)
                if carry is not None:
                    left.setdefault(k // 4, []).append(carry)
            if count == 1:
                break
            groups, count, level = left, -(-count // 4), level + 1
        want |= {i: round(sizes[i] * (int(ratio) + share[i])) for i in own}
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    assert sum(abs(got[i] - want[i]) > 1 for i in want) == 0 and sum(got.values()) == pytest.approx(1.5 * total, abs=3)


def test_mix_edge_cases(spark):
    rows = [(1, None, None, "p"), (None, "a b c", None, "q"), (2, "", "s", "r"), (2, "", "s", "r"), (3, "x y", "s", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")
    out = mixing.mix(df)
    assert sorted(r["size"] for r in out.collect()) == [0, 0, 0, 2, 3]
    assert mixing.mixed_documents(df).columns == ["doc_id", "text", "source", "copies"]
    with pytest.raises(ValueError, match="size"):
        mixing.mix(df.withColumn("size", F.lit(1)), payload=("doc_id", "size"))
    cut = spark.createDataFrame([("  a b\tc ", 2), (None, 1), ("a", 1), ("a  é\n b ", 2), (" a", 5), ("w " * 50_000, 49_999)], "t string, n int").select(mixing.first_words(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in cut] == ["  a b", None, "a", "a  é", " a", ("w " * 49_999)[:-1]]
    long = spark.createDataFrame([(1, "w " * 300_000, "s"), (2, "w", "s")], "doc_id bigint, text string, source string")
    assert {r["size"] for r in mixing.mix(long).collect()} == {300_000, 1}
    assert mixing.mix(df.limit(0)).count() == 0


def test_digest_of_kept_text(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    assert linededup.dedup_lines(df).select(F.sha2(F.encode("text", "UTF-8"), 256)).first()[0] == hashlib.sha256(b"a\nb").hexdigest()
