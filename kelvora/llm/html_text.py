"""Main text of web pages: site templates are found by counting element subtrees over a host's pages, and removed.

A page is cut into elements once, by one tokenizer; each element has a hash of its subtree (tags and text, not
attributes). What every page says of itself goes first: navigation, headers, footers, asides, forms, scripts and elements
whose class, id or role names such a part. If an article or main element is left, the page's text is inside it. Among what
is left then, Spark counts on how many pages of a host each subtree stands, and a subtree that stands on many of them
is the site's and not the page's.

What counts as many: at least ``LEAST`` pages and ``SHARE`` of the host's, but never more than ``MOST``, is enough for
boxes (div, section, list, table ...). Single paragraphs and headings are templates only outside articles and only from
``PROSE`` of the host's pages on: a sentence that many articles quote is still their text. Pages are counted as contexts: by
the least hash of the shingles outside of the subtree, so that exact copies count once and near copies seldom more; a
subtree with fewer contexts than half of its distinct pages is a repeated article and stays.

Keys are (host, subtree), counted in two levels, so a hot host or template is no hot key. The subtrees to delete are
joined to their pages by a hash of host and page; with few of them Spark broadcasts that list below its own limit, and no
page is moved.

Defined results: a null or empty page, or one of templates only, has an empty text; a null url, or one without ``://``, has
the empty host; rows that repeat are one page; null page_ids are kept as they are; pages of any length and depth are read
whole in one pass without recursion, where an element more than ``DEEPEST`` deep takes the place of the one around it;
malformed markup is read as browsers do: end tags without a start are ignored, an unclosed comment or tag swallows the rest;
where names alone would leave nothing of a page of several paragraphs, they don't count; a table without rows gives none;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvora.llm.common import materialise, table
from kelvora.llm.shingles import shingle_sets, trimmed
from kelvora.llm.url_filter import host_and_path

LEAST, SHARE, MOST = 5, 0.01, 100
PROSE = 0.5
DEEPEST = 512
OUT_BYTES = 1 << 22

# Element names of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    """address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead
    title tr ul xmp""".split()
)
#: A start tag that closes an open paragraph.
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu
    nav ol p plaintext pre search section summary table ul xmp dd dt li""".split()
)
#: A start tag closes these if they are open above the nearest of its bounds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
BOUNDS = frozenset("ul ol menu dir dl table select html body article aside div section nav main form blockquote".split())
#: Elements that are no part of an article by their name.
ASIDE_TAGS = frozenset("head script style template noscript nav aside footer header form button input select textarea fieldset menu dialog iframe object canvas svg audio video map title search noembed noframes".split())
#: Elements that are none by a word in their class or id, or by their role.
ASIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adbox banner breadcrumb breadcrumbs comment comments comentarios commentlist consent cookie cookies disqus
    footer form gdpr header infobar login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promotion promos recommendations recommended
    related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar""".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that say the element is beside such a part and not the part itself.
BESIDE = frozenset("with has no without free open closed".split())
NEVER = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption summary legend".split())
BOXES = frozenset("div section ul ol dl table figure details address center dir tbody thead tfoot hgroup article".split())

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|!--(?:>|->|.*?--!?>)|(?:!(?!--)|[?/])[^>]*+>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"class|id|role|hidden|style", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+")
#: Why an element is set aside: a header by its tag or its name (inside an article its headings stay), another part by its
#: tag or its name.
HEADER, PART, NAMED_HEADER, NAMED = 1, 2, 3, 4
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@dataclass(slots=True)
class Element:
    """An element and the pieces of text that it spans: those from begin up to end."""

    tag: str
    begin: int
    parent: int
    aside: int = 0
    end: int = -1
    code: int = 0


@dataclass(slots=True)
class Page:
    pieces: list[str] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)

    def text(self, begin: int, end: int) -> str:
        return " ".join("".join(self.pieces[begin:end]).split())


def _aside(tag: str, attributes: str) -> int:
    if tag in ASIDE_TAGS:
        return HEADER if tag == "header" else PART
    if tag in NEVER or not _NAMED.search(attributes):
        return 0
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = html.unescape(values[0] or values[1] or values[2]), name.lower()
        if name == "role" and value.strip().lower() in ASIDE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return PART
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return PART
        if name in ("class", "id"):
            for own in value.split():
                words = {w.lower() for w in _WORDS.findall(own)}
                if not BESIDE & words and (told := ASIDE_WORDS & words):
                    found = max(found, NAMED_HEADER if told == {"header"} else NAMED)
    return found


def parsed(text: str) -> Page:
    """Tokens to elements, in one pass. Block elements and line breaks part pieces; inline ones don't."""
    page, stack, at = Page(), [], 0
    pieces, elements = page.pieces, page.elements
    opened: dict[str, int] = {}

    def closed(upto: int) -> None:
        while len(stack) > upto:
            own = elements[stack.pop()]
            own.end = len(pieces)
            opened[own.tag] -= 1
            if own.tag in BLOCK:
                pieces.append("\n")

    def near(tags: tuple[str, ...]) -> int:
        """Place in the stack of the outermost of tags that no bound shields, or -1."""
        found = -1
        for k in range(len(stack) - 1, -1, -1):
            tag = elements[stack[k]].tag
            if tag in tags:
                found = k
            elif tag in BOUNDS:
                break
        return found

    while at < len(text):
        next_ = text.find("<", at)
        if next_ < 0:
            next_ = len(text)
        if next_ > at:
            pieces.append(html.unescape(text[at:next_]))
        if next_ == len(text):
            break
        match = _TAG.match(text, next_)
        if match is None:
            if next_ + 1 < len(text) and (text[next_ + 1].isascii() and text[next_ + 1].isalpha() or text[next_ + 1] in "!?/"):
                break  # a tag or comment that never ends
            pieces.append("<")
            at = next_ + 1
            continue
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if not opened.get(tag):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if elements[stack[k]].tag == tag:
                    closed(k)
                    break
            continue
        if tag in CLOSES_P and opened.get("p") and (k := near(("p",))) >= 0:
            closed(k)
        if tag in CLOSES and (k := near(CLOSES[tag])) >= 0:
            closed(k)
        if tag in BLOCK:
            pieces.append("\n")
        if tag in VOID:
            continue
        if len(stack) >= DEEPEST:
            closed(DEEPEST - 1)
        own = Element(tag, len(pieces), stack[-1] if stack else -1, _aside(tag, match[3]))
        elements.append(own)
        if tag in RAW:
            end = _END[tag].search(text, at)
            if end is None:
                own.end = len(pieces)
                break
            pieces.append("" if tag in ("script", "style") else text[at : end.start()])
            own.end = len(pieces)
            at = text.find(">", end.end())
            at = len(text) if at < 0 else at + 1
            continue
        stack.append(len(elements) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    closed(0)
    return page


def _without(ranges: list[tuple[int, int]], drop: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """ranges less drop, both ascending and neither overlapping itself."""
    out, k = [], 0
    for a, b in ranges:
        while k < len(drop) and drop[k][1] <= a:
            k += 1
        j = k
        while j < len(drop) and drop[j][0] < b:
            if drop[j][0] > a:
                out.append((a, drop[j][0]))
            a, j = max(a, drop[j][1]), j + 1
        if a < b:
            out.append((a, b))
    return out


def _outer(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Nested ranges, by begin: the outermost of each."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges, key=lambda r: (r[0], -r[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _size(page: Page, ranges: list[tuple[int, int]]) -> int:
    return sum(len("".join("".join(page.pieces[a:b]).split())) for a, b in ranges)


def content(page: Page) -> tuple[list[tuple[int, int]], bool]:
    """(what is left of a page by its own words, as ranges of pieces, whether it is inside an article or main element)."""
    out = _content(page, NAMED, PART)
    if not _size(page, out[0]) and any(e.tag == "article" and not e.aside for e in page.elements):
        return _content(page, NAMED, 0)  # an article inside a part set aside, as of an unclosed menu, is the page's
    if not _size(page, out[0]) and sum(e.tag == "p" for e in page.elements) >= 3:
        return _content(page, PART, PART)
    return out


def _content(page: Page, most: int, firm: int) -> tuple[list[tuple[int, int]], bool]:
    elements = page.elements
    why = [e.aside if e.aside <= most else 0 for e in elements]
    # What holds an article isn't set aside, unless firmly: for its tag.
    holds, inside = [False] * len(elements), [False] * len(elements)
    for k in range(len(elements) - 1, -1, -1):
        own = elements[k]
        holds[k] = holds[k] or own.tag in ("article", "main") and not why[k]
        if own.parent >= 0:
            holds[own.parent] = holds[own.parent] or holds[k]
    #: 0: kept; 1: in an article's header; 2: set aside.
    state, drop = [0] * len(elements), []
    for k, own in enumerate(elements):
        up = own.parent
        if up >= 0:
            inside[k], state[k] = inside[up] or elements[up].tag in ("article", "main"), state[up]
        header = inside[k] and why[k] in (HEADER, NAMED_HEADER)
        if own.tag in HEADINGS and state[k] < 2 and (header or not why[k]):
            if state[k]:
                drop.append((own.begin, own.end, False))
            state[k] = 0
        elif why[k] and state[k] < 2 and not (holds[k] and why[k] > firm):
            if not state[k]:
                drop.append((own.begin, own.end, True))
            state[k] = 1 if header else 2
    kept = _kept_by(drop, len(page.pieces))
    marks = {t: _outer([(e.begin, e.end) for k, e in enumerate(elements) if e.tag == t and not state[k]]) for t in ("article", "main")}
    article, main = (_common(kept, marks[t]) for t in ("article", "main"))
    if marks["article"] and (not marks["main"] or 2 * _size(page, article) >= _size(page, main)):
        return article, True
    return (main, True) if marks["main"] else (kept, False)


def _kept_by(drop: list[tuple[int, int, bool]], n: int) -> list[tuple[int, int]]:
    """Ranges that are kept, by nested ranges that drop or keep, in order of their begins; the innermost counts."""
    out, at, stack = [], 0, [(n, False)]

    def upto(place: int) -> None:
        nonlocal at
        if not stack[-1][1] and place > at:
            out.append((at, place))
        at = max(at, place)

    for begin, end, dropped in drop:
        while stack[-1][0] <= begin and len(stack) > 1:
            upto(stack[-1][0])
            stack.pop()
        upto(begin)
        stack.append((end, dropped))
    while stack:
        upto(stack[-1][0])
        stack.pop()
    return out


def _common(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        begin, end = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if begin < end:
            out.append((begin, end))
        if a[i][1] <= b[j][1]:
            i += 1
        else:
            j += 1
    return out


def _coded(page: Page) -> None:
    """The hash of each subtree: its tag, its own text between its children and their hashes, from the innermost out."""
    children: list[list[int]] = [[] for _ in page.elements]
    for k, own in enumerate(page.elements):
        if own.parent >= 0:
            children[own.parent].append(k)
    for k in range(len(page.elements) - 1, -1, -1):
        own, at = page.elements[k], page.elements[k].begin
        hashed = xxhash.xxh3_64(own.tag)
        for child in children[k]:
            inner = page.elements[child]
            hashed.update("\0" + page.text(at, inner.begin))
            hashed.update(inner.code.to_bytes(8, "little"))
            at = inner.end
        hashed.update("\0" + page.text(at, own.end))
        own.code = hashed.intdigest()


def candidates(page: Page, kept: list[tuple[int, int]], in_article: bool) -> list[Element]:
    """Elements that lie in what is kept, hold text, and may be the site's. The article itself is none."""
    tags = BOXES if in_article else BOXES | PROSE_TAGS
    solid = np.concatenate([[0], np.cumsum([not p.isspace() and p != "" for p in page.pieces])])
    found, r = [], 0
    for own in page.elements:
        while r < len(kept) and kept[r][1] <= own.begin:
            r += 1
        if r < len(kept) and own.tag in tags and own.begin >= kept[r][0] and solid[own.end] > solid[own.begin]:
            if not in_article or own.tag not in ("article", "main") or own.begin > kept[0][0]:
                found.append(own)
    return found


def _contexts(page: Page, kept: list[tuple[int, int]], found: list[Element]) -> list[int]:
    """For each element the least hash of a shingle of kept text outside of it; 0 where there is none."""
    blocks, at = [], []
    for a, b in kept:
        for k in range(a, b):
            if page.pieces[k].strip():
                blocks.append(page.pieces[k].encode())
                at.append(k)
    data = np.frombuffer(b"".join(blocks), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)
    hashes, first = shingle_sets(data, offsets)
    least = np.full(len(blocks) + 1, 2**64 - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    least[some] = hashes[first[:-1][some]]
    before = np.concatenate([[np.uint64(2**64 - 1)], np.minimum.accumulate(least)])
    after = np.minimum.accumulate(least[::-1])[::-1]
    places = np.asarray(at)
    out = []
    for own in found:
        i, j = np.searchsorted(places, [own.begin, own.end])
        least_ = min(int(before[i]), int(after[j]))
        out.append(0 if least_ == 2**64 - 1 else least_)
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def subtrees(text: str) -> list[tuple[int, int, bool]]:
    """(hash, context, prose) of each subtree of a page that may be the site's."""
    page = parsed(text)
    kept, in_article = content(page)
    found = candidates(page, kept, in_article)
    if not found:
        return []
    _coded(page)
    return sorted({own.code: (_signed(own.code), _signed(c), own.tag in PROSE_TAGS) for own, c in zip(found, _contexts(page, kept, found), strict=True)}.values())


def main_text(text: str, templates: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """(the page's text without those of its subtrees, how many were deleted)."""
    page = parsed(text)
    kept, in_article = content(page)
    drop = []
    if templates:
        _coded(page)
        drop = _outer([(own.begin, own.end) for own in candidates(page, kept, in_article) if _signed(own.code) in templates])
    return " ".join("".join("".join(page.pieces[a:b]) for a, b in _without(kept, drop)).split()), len(drop)


def _hosted(pages: DataFrame) -> DataFrame:
    host = host_and_path(F.col("url"))[0]
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host).alias("host"))
    return own.withColumn("key", F.xxhash64("host", "html"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, subtree) of the subtrees that recur across many pages of their host, and (key) of each page that holds one."""
    own = _hosted(pages)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for host, key, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                for code, context, prose in subtrees(text.as_py()):
                    for column, x in zip(out, (host, key, code, context, prose), strict=True):
                        column.append(x)
                if len(out[0]) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)
                    out = ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    names, kinds = ["host", "key", "subtree", "context", "prose"], [pa.int64()] * 4 + [pa.bool_()]
    found = materialise(own.select("host", "key", "html").mapInArrow(trimmed(find), "host bigint, key bigint, subtree bigint, context bigint, prose boolean").distinct(), "subtrees")
    contexts = found.groupBy("host", "subtree", "prose", "context").agg(F.count("*").alias("pages"))
    counted = contexts.groupBy("host", "subtree", "prose").agg(F.count("*").alias("contexts"), F.sum("pages").alias("pages"))
    sizes = own.groupBy("host").agg(F.count("*").alias("of_host"))
    many = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.ceil(F.lit(SHARE) * F.col("of_host"))))
    enough = F.when(F.col("prose"), F.greatest(F.lit(LEAST), F.ceil(F.lit(PROSE) * F.col("of_host")))).otherwise(many)
    recurring = counted.where(F.col("contexts") >= LEAST).join(sizes, "host").where((F.col("contexts") >= enough) & (2 * F.col("contexts") >= F.col("pages")))
    return found.select("host", "key", "subtree").join(recurring.select("host", "subtree").distinct(), ["host", "subtree"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_templates): the main text of each page, and how many subtrees were the site's."""
    per_page = materialise(templates(pages).groupBy("key").agg(F.collect_set("subtree").alias("subtrees")), "templates")
    joined = _hosted(pages).join(per_page, "key", "left").select("page_id", "url", "html", "subtrees")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, rows, held = 0, [], 0
            for i in range(batch.num_rows):
                rows.append(main_text(batch.column(2)[i].as_py(), {*(batch.column(3)[i].as_py() or ())}))
                held += len(rows[-1][0])
                if held >= OUT_BYTES or i == batch.num_rows - 1:
                    texts, n = zip(*rows, strict=True)
                    made = [pa.array(texts, pa.large_string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())]
                    own = batch.slice(begun, len(rows))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *made], ["page_id", "url", "text", "n_chars", "n_templates"])
                    begun, rows, held = i + 1, [], 0

    return joined.mapInArrow(trimmed(make), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint, n_templates bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
