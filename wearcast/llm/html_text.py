"""Main text of web pages: markup structure and a suffix array per host.

A page is cut into blocks with a zone each.  Blocks inside the page's article
(or, without one, its main element) are its text.  Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are
chrome.  The rest of a page without article and main element is open, and
there the host decides.

The blocks of every page, in page order, are one stream of tokens; the streams
of a host's pages, put one after another, are its text.  Its suffixes are
sorted to a depth of ``run`` tokens, and neighbours compared: a suffix whose
first ``run`` tokens also start a suffix of another page begins a long
repeated substring.  (A longer one shows by the suffixes after it, so a greater
depth finds no more.)  A substring may run over several blocks, such as the
entries of a menu, but not over the end of a page.  Open blocks that lie in
one whole go, and so do stretches of ``run`` tokens inside a block; a block that
one merely touches at its edge stays.

Articles (main elements on pages without one) veto: their text stays, however
often it recurs, and ends a stream's stretch.  It is no evidence either, or a
page without markup that quotes an article would lose the quoted text.

The suffix array is a Spark sort by (host, prefix, page, place), so a host of
any size spreads over tasks, as does a run of very many equal suffixes; runs
that cross a task's edge meet in an aggregate of two rows a task.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm.common import materialise, small_batches
from wearcast.llm.url_filter import url_parts

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"""|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)""",
    re.S,
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z0-9]+")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("aside button dialog footer form head menu nav select svg object".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer menu modal nav navbar navigation newsletter notice notices popup promo related share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split()
)
REMARKS = frozenset(("comment", "comments", "disqus"))
KEEP_OPEN = frozenset("html body article main".split())
ARTICLE, MAIN, OPEN, OUTSIDE = "article", "main", "open", "chrome"
ASIDE, EXPOSED, VETOED = 0, 1, 2  # in a stream: evidence only, may be removed, stays


def _marked(rest: str) -> str | None:
    """The kind of chrome that class, id or role name ("hidden" for a hidden
    element), or None."""
    if not rest or rest.isspace():
        return None
    for m in _MARKS.finditer(rest):
        if named := CHROME_WORDS.intersection(_WORD.findall((m[1] or m[2] or m[3] or "").lower())):
            return "comment" if named & REMARKS else min(named)
    return "hidden" if _HIDDEN.search(rest) else None


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks in order; no empty texts."""
    page = page or ""
    found: list[tuple[str, str]] = []
    buffer: list[str] = []
    skip = ""  # name of the element that opened chrome
    kind: str | None = None  # what marked it, None for the element itself
    depth, inline = 0, -1  # open elements of that name; buffer length before an inline one
    article = main = 0

    def emit(pieces: list[str], chrome: bool) -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            found.append((OUTSIDE if chrome else ARTICLE if article else MAIN if main else OPEN, text))

    def flush() -> None:
        nonlocal inline
        if skip and inline >= 0:
            emit(buffer[:inline], False)
            del buffer[:inline]
            inline = -1
        if buffer:
            emit(buffer, bool(skip))
            buffer.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            buffer.append(" ")
            continue
        closing, rest = bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        block = name in BLOCKS
        if block or name in CHROME:
            flush()
        if closing:
            if skip and name == skip:
                depth -= 1
                if not depth:
                    if inline >= 0:
                        del buffer[inline:]
                    else:
                        flush()
                    skip, inline = "", -1
            elif not skip:
                article -= name == "article" and article > 0
                main -= name == "main" and main > 0
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            continue
        if name in VOID or rest.endswith("/"):
            continue
        mark = None if name in KEEP_OPEN and name not in ("article", "main") else _marked(rest)
        if skip == "p" and block:  # a paragraph ends where the next block starts
            skip = ""
        if skip and kind not in (None, "comment") and name in ("article", "main") and not mark:
            skip = ""  # a wrapper of the text, not chrome
        if skip:
            depth += name == skip
        elif name in CHROME or (name == "header" and not article) or (mark and (name not in ("article", "main") or mark == "comment")):
            skip, depth = name, 1
            kind = None if name in CHROME or name == "header" else mark
            inline = -1 if block or name in CHROME else len(buffer)
        else:
            article += name == "article"
            main += name == "main"
    flush()
    return found


def page_streams(page: str | None) -> tuple[str | None, list[str], list[tuple[int, str]]]:
    """(text, open blocks, stream): text is None where the page has neither
    article nor main element.  The stream has all blocks in order, as (ASIDE,
    EXPOSED or VETOED, text); vetoed ones without their text, which is in the first."""
    cut = blocks(page)
    zones = {z for z, _ in cut}
    chosen = ARTICLE if ARTICLE in zones else MAIN if MAIN in zones else None
    if chosen:
        return "\n".join(t for z, t in cut if z == chosen), [], [(VETOED, "") if z == chosen else (ASIDE, t) for z, t in cut]
    return None, [t for z, t in cut if z == OPEN], [(EXPOSED if z == OPEN else ASIDE, t) for z, t in cut]


def _prefixes(stream: list[dict], run: int) -> Iterator[tuple[str, int, bool]]:
    """(first ``run`` tokens, place, whether an open block is among them) of
    the suffixes of a page's stream; places count the page's tokens."""
    tokens: list[str] = []
    exposed: list[bool] = []
    start = 0  # where the stretch behind the last veto starts

    def stretch() -> Iterator[tuple[str, int, bool]]:
        for i in range(start, len(tokens) - run + 1):
            yield " ".join(tokens[i : i + run]), i, any(exposed[i : i + run])

    for block in stream:
        if block["zone"] == VETOED:
            yield from stretch()
            start = len(tokens)
        else:
            words = block["text"].split(" ")
            tokens += words
            exposed += [block["zone"] == EXPOSED] * len(words)
    yield from stretch()


_STREAM = pa.list_(pa.struct([("zone", pa.int8()), ("text", pa.string())]))
_PARSED = "key long, text string, stream array<struct<zone:tinyint,text:string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [page_streams(x.as_py()) for x in b.column(1)]
        streams = [[{"zone": z, "text": t} for z, t in m[2]] for m in made]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array(streams, _STREAM), *b.columns[2:]],
            names=["key", "text", "stream", *b.schema.names[2:]],
        )


_SUFFIX = "host string, prefix string, page long, place int, exposed boolean"


def _suffixes(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for host, key, stream in zip(b.column(0), b.column(1), b.column(2)):
                out += [(host.as_py(), h, key.as_py(), i, mine) for h, i, mine in _prefixes(stream.as_py(), run)]
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "prefix", "page", "place", "exposed"])

    return rows


_REPEATED = "host string, prefix string, page long, place int, low long, high long"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares neighbours of a sorted part of the suffix array: (page, place)
    of the exposed suffixes that share their prefix with another page, host
    and prefix being NULL.  The part's first and last prefix may go on in
    other parts: they give a row with their lowest and highest page, and one
    for each suffix that has met no other page here."""
    now: tuple | None = None  # host and prefix of the suffixes being read
    low = high = last = None
    alone: list[int] = []  # places on the first page, until another one comes
    edge = True
    out: list[tuple] = []

    def close() -> None:
        if edge and now is not None:
            out.append((*now, None, None, low, high))
            out.extend((*now, low, i, None, None) for i in alone)

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 6
        out.clear()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "prefix", "page", "place", "low", "high"])

    for b in batches:
        for host, prefix, page, place, exposed in zip(*(c.to_pylist() for c in b.columns)):
            if (host, prefix) != now:
                if now is not None:
                    close()
                    edge = False
                now, low, last, alone = (host, prefix), page, None, []
            high = page
            if page != low and alone:
                out.extend((None, None, low, i, None, None) for i in alone)
                alone = []
            if exposed and (page, place) != last:
                if page == low:
                    alone.append(place)
                else:
                    out.append((None, None, page, place, None, None))
            last = (page, place)
        yield batch()
    edge = True
    close()
    yield batch()


def repeated_suffixes(streams: DataFrame, run: int) -> DataFrame:
    """``(page, place)``: exposed suffixes of ``streams`` (host, key, stream)
    whose first ``run`` tokens also stand on another page of the host."""
    order = ["host", "prefix", "page", "place"]
    array = streams.select("host", "key", "stream").mapInArrow(_suffixes(run), _SUFFIX).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(array.mapInArrow(_repeated, _REPEATED), "repeated_suffixes", release=True)
    edges = found.where("prefix IS NOT NULL")
    several = edges.groupBy("host", "prefix").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b").select("host", "prefix")
    late = edges.where("page IS NOT NULL").join(several, ["host", "prefix"])
    return found.where("prefix IS NULL").select("page", "place").unionByName(late.select("page", "place"))


def unique_text(stream: list[dict], places: list[int], run: int) -> str:
    """The open blocks of a stream without what the repeated substrings at
    ``places`` cover: blocks whole, or ``run`` tokens inside a block."""
    cut = [block["text"].split(" ") for block in stream]
    ends = list(accumulate(map(len, cut)))
    gone: set[int] = set()
    for place in places:
        k, stop = bisect_right(ends, place), place + run
        while k < len(cut) and ends[k] - len(cut[k]) < stop:
            start = ends[k] - len(cut[k])
            if place <= start and ends[k] <= stop or start <= place and stop <= ends[k]:
                gone.update(range(max(place, start), min(stop, ends[k])))
            k += 1
    kept = (" ".join(t for i, t in enumerate(words, end - len(words)) if i not in gone) for words, end, block in zip(cut, ends, stream) if block["zone"] == EXPOSED)
    return "\n".join(t for t in kept if t)


def _unique_texts(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [unique_text(stream.as_py(), places.as_py() or [], run) for stream, places in zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(texts, pa.string())], names=[*b.schema.names[2:], "text"])

    return rows


def extract_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id", run: int = 8) -> DataFrame:
    """``(page_id, url, text)``, one row per row of ``pages``.

    Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined in page order by one newline.  Text
    inside an article or main element is kept whole, however often it recurs.
    NULL and empty pages have an empty text.  Pages with equal markup count as
    one page of their host; NULL and malformed urls form one host.  Other
    columns are ignored; repeated rows give repeated results."""
    markup = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    host, _ = url_parts(pages[url_col])
    key = F.xxhash64(host, markup)
    source = pages.select(key.alias("key"), markup.alias("html"), host.alias("host"), pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"))
    url_type = dict(source.dtypes)["url"]
    parsed = materialise(small_batches(source).mapInArrow(_parse, f"{_PARSED}, host string, page_id long, url {url_type}"), "parsed_pages")
    covered = repeated_suffixes(parsed, run).groupBy(F.col("page").alias("key")).agg(F.collect_set("place").alias("places"))
    whole = parsed.where("text IS NOT NULL").select("page_id", "url", "text")  # vetoed
    bare = parsed.where("text IS NULL").join(covered, "key", "left").select("stream", "places", "page_id", "url")
    return whole.unionByName(bare.mapInArrow(_unique_texts(run), f"page_id long, url {url_type}, text string"))
