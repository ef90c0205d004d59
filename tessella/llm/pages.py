"""Main text of web pages by nearest-URL page differencing (operator 1)."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import few, park

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
#: A comment, a declaration or a tag. A tag ends at the first '>' outside quoted values of any length; where such an end is nowhere, at the first '>'.
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+(?=>)|[^>]*+)>""", re.S)
#: One attribute of a tag, whole: its name, and its value in either quotes or none. A quote that is never closed is part of a value without quotes.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")

#: Elements whose content is no markup, and elements without content.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noembed"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that never hold main text.
OUT = frozenset("head script style noscript template nav footer aside form button select option datalist iframe svg canvas object dialog menu textarea title video audio map".split())
#: Elements whose start and end part blocks.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Marks by which templates tell what isn't the article. Outside it any word of class, id and role counts, but for ids of headings, and the second set too.
#: Inside it only a class or role that is a mark as a whole counts, or an id that is a comment mark: ids of an article's own parts are made from their titles.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation footer comment comments respond replies disqus pagination pager login signup toolbar widget".split()
)
OUTER_MARKS = frozenset(("header", "masthead", "topbar", "complementary", "contentinfo"))
COMMENT_MARKS = frozenset(("comment", "comments", "respond", "replies", "disqus"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass
class Line:
    """One block of text: whether it is inside the article, whether it is in an element that can't hold main text, and the share of it in links."""

    text: str
    core: bool
    out: bool
    linked: float


def _marked(tag: str, attributes: str, core: bool) -> tuple[bool, bool]:
    """Whether attributes put an element out, and whether they make it the main one."""
    tokens: set[str] = set()
    ids: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and "display:none" in "".join(value.split()):
            return True, False
        if name == "id":
            ids.update(value.split())
        elif name in ("class", "role"):
            tokens.update(value.split())
            if name == "role" and value.strip() == "main":
                return False, True
    if tag in ("html", "body", "main"):
        return False, False
    # comment-12 is a comment, comment-on-prices a title
    comment = any(re.sub(r"[-_]?\d+$", "", x) in COMMENT_MARKS for x in ids) and tag not in HEADINGS
    if tag == "article":
        return comment or any(re.split(r"[-_]", x)[0] in COMMENT_MARKS for x in tokens), False
    if core:
        return comment or bool(tokens & MARKS), False
    words = {w for x in (tokens if tag in HEADINGS else tokens | ids) for w in re.split(r"[^a-z0-9]+", x)}
    return bool(words & MARKS or words & OUTER_MARKS), False


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in order, with character references decoded and white space as single blanks; empty ones are left out."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, out, core
    parts: list[str] = []
    in_links, links, at = 0, 0, 0
    state = (False, False)

    def close() -> None:
        nonlocal parts, in_links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, state[1], state[0], min(1.0, in_links / len(text))))
            parts, in_links = [], 0

    while m := TAG.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            in_links += len(piece) * (links > 0)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            close()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            if any(s[0] == tag for s in stack):
                while True:
                    top = stack.pop()
                    links -= top[0] == "a"
                    if top[0] == tag:
                        break
                if state != (stack[-1][1:] if stack else (False, False)):
                    close()
                    state = stack[-1][1:] if stack else (False, False)
            continue
        if tag in BLOCKS and stack and stack[-1][0] == "p":
            stack.pop()
            state = stack[-1][1:] if stack else (False, False)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
            closing = page.find(">", at)
            at = closing + 1 if end and closing >= 0 else len(page)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        drop, main = _marked(tag, m[3], state[1]) if m[3] else (False, False)
        new = (state[0] or drop or tag in OUT or tag == "header" and not state[1], state[1] or main or tag in ("article", "main"))
        if new != state:
            close()
            state = new
        stack.append((tag, *new))
        links += tag == "a"
    parts.append(page[at:])
    close()
    return out


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, by bit vectors.

    A row of bits, one for each line of b, tells how the subsequence grows with each line of a. Only every k-th row is kept
    and the rows between are made again on the way back, so memory is the square root of the lines of a in rows.
    """
    both = set(a) & set(b)
    ours, theirs = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    start = 0
    while start < min(len(ours), len(theirs)) and a[ours[start]] == theirs[start]:
        start += 1
    end = 0
    while end < min(len(ours), len(theirs)) - start and a[ours[-1 - end]] == theirs[-1 - end]:
        end += 1
    head, tail = ours[:start], ours[len(ours) - end :]
    ours, theirs = ours[start : len(ours) - end], theirs[start : len(theirs) - end]
    if not ours or not theirs:
        return head + tail
    places: dict[int, list[int]] = {}
    for j, x in enumerate(theirs):
        places.setdefault(x, []).append(j)
    full = (1 << len(theirs)) - 1

    def after(row: int, x: int) -> int:
        if x not in places:
            return row
        mask = bytearray(len(theirs) // 8 + 1)
        for j in places[x]:
            mask[j >> 3] |= 1 << (j & 7)
        hit = row & int.from_bytes(mask, "little")
        return ((row + hit) | (row - hit)) & full

    step = max(1, math.isqrt(len(ours)))
    kept, row = [full], full  # the rows before lines 0, step, 2 * step, ...
    for i, at in enumerate(ours, 1):
        row = after(row, a[at])
        if i % step == 0:
            kept.append(row)
    found, i, j = [], len(ours), len(theirs)
    while i and j:
        base = (i - 1) // step * step
        rows = [kept[base // step]]
        for at in ours[base:i]:
            rows.append(after(rows[-1], a[at]))
        while i > base and j:
            if rows[i - base] >> (j - 1) & 1:
                j -= 1
            elif a[ours[i - 1]] == theirs[j - 1]:
                found.append(ours[i - 1])
                i, j = i - 1, j - 1
            else:
                i -= 1
    return head + found[::-1] + tail


def _beside(batches):
    """part, row, before and after (the rows of the part next to it with another content), first and last (in the part), from batches of part, row, content, sorted in each part.

    A part is held whole, as Arrow: it is a range partition, and its rows are a key, a path and a number.
    """

    def of_part(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        content, n = table.column("content").to_numpy(), table.num_rows
        starts = np.flatnonzero(np.concatenate(([True], content[1:] != content[:-1])))
        run = np.searchsorted(starts, np.arange(n), "right") - 1
        before, after = starts[run] - 1, np.append(starts[1:], n)[run]
        place = np.arange(n)
        for i in range(0, n, 10_000):
            part, row, _ = table.slice(i, 10_000).columns
            beside = [table.column("row").take(pa.array(x, mask=gone)) for x, gone in ((before[i : i + 10_000], before[i : i + 10_000] < 0), (after[i : i + 10_000], after[i : i + 10_000] == n))]
            ends = [pa.array(place[i : i + 10_000] == x) for x in (0, n - 1)]
            yield from pa.Table.from_arrays([part, row, *beside, *ends], names=["part", "row", "before", "after", "first", "last"]).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        parts = batch.column(0).to_numpy()
        for i, j in itertools.pairwise([0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]):
            if i < j:
                if held and held[0].column(0)[0].as_py() != parts[i]:
                    yield from of_part(held)
                    held = []
                held.append(batch.slice(i, j - i))
    if held:
        yield from of_part(held)


def _neighbours(keys: DataFrame, pages: int) -> DataFrame:
    """key and other: for each page the page of its host with another content whose path is nearest, the one before or after it in path order.

    keys: host, path, key, content; pages: about how many. Pages are ordered by (host, path, key) in range partitions, so a
    host with a third of all pages takes many tasks. Pages of equal content in a row have the same neighbours; four rows of
    each partition are collected, and broadcast, to tell the neighbours beyond its ends. Of two equally near pages the one
    before is taken.
    """
    spark = keys.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("host"), F.col("path"), F.col("key")]
    dealt = keys.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    row = F.struct("host", "path", "key", "content").alias("row")
    dealt = dealt.select(F.spark_partition_id().cast("bigint").alias("part"), row, "content")
    kind = dealt.schema["row"].dataType.simpleString()
    # a task passes several partitions on, one after the other, so its file holds them all
    seen = few(dealt, pages).mapInArrow(_beside, f"part bigint, row {kind}, before {kind}, after {kind}, first boolean, last boolean")
    seen = park(seen, "page-neighbours")
    found = seen.filter("first OR last").select("part", F.when(F.col("first"), F.struct("row", "after")).alias("first"), F.when(F.col("last"), F.struct("row", "before")).alias("last")).collect()
    parts: dict[int, list] = {}
    for r in found:
        ends = parts.setdefault(r["part"], [None, None])
        ends[:] = r["first"] or ends[0], r["last"] or ends[1]
    ends = sorted(parts.items())

    def beyond(content: int, parts, side: int):
        """The nearest row with another content in partitions further on: their end, or the first one unlike it."""
        for _, part in parts:
            for r in part[side]:
                if r is not None and r["content"] != content:
                    return r
        return None

    around = [(part, beyond(first["row"]["content"], ends[:i][::-1], 1), beyond(last["row"]["content"], ends[i + 1 :], 0)) for i, (part, (first, last)) in enumerate(ends)]
    edges = spark.createDataFrame(around, f"part bigint, earlier {kind}, later {kind}")
    seen = seen.join(F.broadcast(edges), "part").select("row.*", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))

    def near(side: str) -> Column:
        chars = F.split("path", "")
        alike = F.zip_with(chars, F.split(f"{side}.path", ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.when(F.col(f"{side}.host").eqNullSafe(F.col("host")), F.coalesce(F.array_position(alike, False), F.lit(0)).cast("int"))

    before, after = near("before"), near("after")
    # array_position is 0 where all characters agree: the paths are equal, which is nearest
    before, after = (F.when(x == 0, 1 << 30).otherwise(x) for x in (before, after))
    nearest = F.when(after.isNotNull() & (before.isNull() | (after > before)), F.col("after.key")).when(before.isNotNull(), F.col("before.key"))
    return seen.select("key", nearest.alias("other")).filter("other IS NOT NULL")


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _candidate(page: str | None) -> tuple[list[str], list[int], list[bool], list[int], int]:
    """The blocks of a page that marks leave, their places, whether alignment may delete each; the places of the others; the number of all."""
    rows = lines_of(page or "")
    marked = any(x.core and not x.out for x in rows)
    gone = [x.out or marked and not x.core for x in rows]
    kept = [(i, x) for i, (x, g) in enumerate(zip(rows, gone)) if not g]
    return [x.text for _, x in kept], [i for i, _ in kept], [not x.core or x.linked >= 0.5 for _, x in kept], [i for i, g in enumerate(gone) if g], len(rows)


def _decide(lines: list[str], at: list[int], soft: list[bool], out: list[int], n_lines: int, common: list[int] | None) -> tuple[str, int, int, int, int]:
    """text, n_chars, n_lines, n_shared and n_marked of a candidate. common: the places of the blocks that alignment found."""
    shared = set(common or ())
    stay = [x for x, i, s in zip(lines, at, soft) if not (s and i in shared)]
    by_marks = sum(i not in shared for i in out)
    text = "\n".join(stay)
    return text, len(text), n_lines, len(lines) + len(out) - len(stay) - by_marks, by_marks


def _pass(held: int, of_row, names: list[str], types: list[pa.DataType]):
    """An Arrow pass: the first columns as they are, then of_row of the others, a row at a time; some rows are held as Python objects at once."""

    def over(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                made = zip(*(of_row(*x) for x in zip(*(c.to_pylist() for c in some.columns[held:]))))
                yield pa.RecordBatch.from_arrays([*some.columns[:held], *(pa.array(c, t) for c, t in zip(made, types))], names=names)

    return over


def extract_text(pages: DataFrame, broadcast: int = 8 << 20) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, n_lines (all blocks), n_shared and n_marked (of these, deleted by alignment, and by marks).

    Each page is aligned with the page of its host that has the nearest URL path and another content, by a longest common
    subsequence of their blocks. Blocks that both have are deleted: outside the article always, inside it where they are
    mostly links, since an article may well cite or mirror another. Of what alignment leaves, blocks in elements that can't
    hold main text go, and where a page marks its article, blocks outside it.

    A null html is an empty page, with an empty text. A null url has no host; such pages are aligned with each other. Rows
    that repeat give equal rows, and pages of equal content are never aligned with one another, so a page isn't emptied by
    its copy. Of two equally near pages the earlier in path order counts. Pages of any length are read whole; columns but
    page_id, url and html are not read. An empty table gives no rows. Pages are parsed twice, for hashes and for what may be
    kept, so that no text needs to be written between; ordering and alignment move hashes.
    What alignment found is broadcast where it takes no more than some bytes, and pages then stay where they are parsed;
    beyond that pages and findings are joined by shuffles.
    """
    key = F.struct(F.col("page_id"), F.xxhash64("url", "html").alias("mark"))
    base = pages.select(key.alias("key"), "page_id", "url", "html")
    key_type, id_type = base.schema["key"].dataType.simpleString(), base.schema["page_id"].dataType.simpleString()

    strings, places = pa.list_(pa.string()), pa.list_(pa.int32())
    blocks = _pass(2, lambda h: ([_digest(x.text) for x in lines_of(h or "")],), ["key", "url", "hashes"], [pa.list_(pa.int64())])
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    hashed = base.select("key", "url", "html").mapInArrow(blocks, f"key {key_type}, url string, hashes array<bigint>")
    hashed = hashed.select("key", host.alias("host"), path.alias("path"), "hashes")
    parked = park(hashed, "page-hashes")
    count, hashes = parked.count(), parked.dropDuplicates(["key"])
    pairs = _neighbours(hashes.select("host", "path", "key", F.xxhash64("hashes").alias("content")), count)
    held = hashes.select("key", "hashes")
    aligned = pairs.join(held, "key").join(held.select(F.col("key").alias("other"), F.col("hashes").alias("theirs")), "other").select("key", "hashes", "theirs")
    aligned = few(aligned.filter(F.arrays_overlap("hashes", "theirs")), count)
    align = _pass(1, lambda a, b: (shared_lines(a, b),), ["key", "shared"], [places])
    shared = park(aligned.mapInArrow(align, f"key {key_type}, shared array<int>"), "page-shared")

    found = ["text", "n_chars", "n_lines", "n_shared", "n_marked"]
    schema = f"page_id {id_type}, url string, text string, n_chars bigint, n_lines bigint, n_shared bigint, n_marked bigint"
    types = [pa.string(), *[pa.int64()] * 4]
    size = 64 + 4 * F.size("shared") + F.coalesce(F.length(F.col("key.page_id").cast("string")), F.lit(0))
    if (shared.agg(F.sum(size)).first()[0] or 0) <= broadcast:
        rows = base.join(F.broadcast(shared), "key", "left").select("page_id", "url", "html", "shared")
        return rows.mapInArrow(_pass(2, lambda h, common: _decide(*_candidate(h), common), ["page_id", "url", *found], types), schema)
    names = ["lines", "at", "soft", "out", "n_lines"]
    candidates = _pass(3, _candidate, ["key", "page_id", "url", *names], [strings, places, pa.list_(pa.bool_()), places, pa.int64()])
    kept = base.mapInArrow(candidates, f"key {key_type}, page_id {id_type}, url string, lines array<string>, at array<int>, soft array<boolean>, out array<int>, n_lines bigint")
    rows = kept.join(shared.hint("merge"), "key", "left").select("page_id", "url", *names, "shared")
    return rows.mapInArrow(_pass(2, _decide, ["page_id", "url", *found], types), schema)
