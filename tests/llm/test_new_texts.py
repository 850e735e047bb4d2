"""Main text, fill-in-the-middle and importance resampling against plain versions, and their defined results."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = "n form output key host html subtree subtrees context prose pages contexts row part before at rank bin bucket weight score importance_id middle_n middle_form of_host text_".split()


# ---- main text

class Plain(HTMLParser):
    """Text of a well-formed page's article, or of its body, without the parts that tags and classes name, and without given boxes."""

    DROP = {"head", "nav", "footer", "header", "aside", "form", "script", "style"}

    def __init__(self, within, boxes=()):
        super().__init__()
        self.within, self.boxes, self.out, self.stack, self.found = within, boxes, [], [], []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.out.append(" ")
            return
        self.stack.append((tag, tag in self.DROP or "ad" in dict(attrs).get("class", "").split(), len(self.out)))
        if tag not in ("b", "a"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        tag, _, begun = self.stack.pop()
        own = " ".join("".join(self.out[begun:]).split())
        if tag == "div" and own in self.boxes:
            del self.out[begun:]
        if tag == "div" and own:
            self.found.append(own)
        if tag not in ("b", "a"):
            self.out.append(" ")

    def handle_data(self, data):
        if not any(d for _, d, _ in self.stack) and (not self.within or any(t == self.within for t, _, _ in self.stack)):
            self.out.append(data)

    def text(self, page):
        self.feed(page)
        self.close()
        return " ".join("".join(self.out).split())


def _pages(rng):
    """Pages of three hosts: most with an article; boxes of the site's and of the page's own; exact and near copies."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    site = {h: [f"{prose(6)} &amp; {prose(3)}" for _ in range(3)] for h in range(3)}
    own_list = "<div><b>" + prose(5) + "</b><p>" + prose(5) + "</p></div>"
    copied = [prose(60).split() for _ in range(2)]
    out = []
    for i in range(150):
        host, kind = i % 3, rng.randint(0, 9)
        body = [f"<p>{prose(rng.randint(5, 40))}</p>" for _ in range(rng.randint(1, 4))]
        if kind == 0:  # near copies of an article that holds a box of its own
            words = list(copied[host % 2])
            words[rng.randrange(60)] = word()
            body = [f"<p>{' '.join(words)}</p>", own_list]
        elif kind == 1:
            body.append(f"<div><p>{prose(9)}</p></div>")
        if rng.random() < 0.8:
            body.insert(rng.randint(0, len(body)), f"<div><p>{site[host][0]}</p><p>{site[host][1]}</p></div>")
        quoted = f"<p>{site[host][2]}</p>" if rng.random() < 0.4 else ""
        inner = f"<h1>{prose(3)}</h1>{quoted}{''.join(body)}"
        article = f"<article>{inner}</article>" if host else f"<div>{inner}</div>"
        out.append((i, f"https://H{host}.example.org/{i}", f"<html><head><title>{prose(2)}</title><script>x</p></script></head><body><nav>{prose(4)}</nav><div class=\"ad\">{prose(3)}</div>{article}<footer>{site[host][1]}</footer></body></html>"))
    return out + [(1000 + i, *out[0][1:]) for i in range(20)]


def test_main_text_against_a_plain_version(spark):
    from kelvora.llm import html_text

    pages = _pages(random.Random(4))
    shown = defaultdict(set)
    for i, url, page in pages:
        inner = Plain("article" if "<article>" in page else None)
        inner.text(page)
        for box in inner.found:
            shown[url.split("/")[2].lower(), box].add(page)
    # The site's boxes, and not the box of the near copies, which nearly always stands beside the same words.
    site = {k for k, v in shown.items() if len(v) >= 5 and len({re.sub(r"<article>.*?(<p>|<div>)", "", p)[:400] for p in v}) >= 5 and k[1].count(" ") > 12}
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    deleted = 0
    for i, url, page in pages:
        host = url.split("/")[2].lower()
        want = Plain("article" if "<article>" in page else None, {b for h, b in site if h == host}).text(page)
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == url
        deleted += got[i].n_templates
    assert deleted > 100


def test_main_text_of_given_pages(spark):
    """All given pages: their article's text, however often its lines recur on the host."""
    from kelvora.llm import html_text

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.query(spark, "/root/testdata/sf0.01").collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r.html)[1]
        import html

        want = html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", article).replace("<b>", "").replace("</b>", ""))
        assert got[r.page_id] == " ".join(want.split())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""), (None, ""), ("plain text", "plain text"), ("a < b <b>bo</b>ld", "a < b bold"), ("x</p></div>y&nbsp;&eacute;&#233;&#x41;", "xy ééA"),
        ("x <!-- a <p> b --> y <!-- never ends > z", "x y"), ("a<p", "a"), ("<p>one<p>two<br>three<i>four</i>", "one two threefour"),
        ("<ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table>", "one two 1 2 3"), ('<script>var t="</p>";</script>a<style>p{}', "a"),
        ("<nav>x<article><header><h1>T</h1><p class=by>me</p></header><p>a<p>&lt;p&gt; &amp c<div class='ad'>buy</div>tail<section class=comments><article class=comment>yo</article></section></article>", "T a <p> & c tail"),
        ("<main><h1>T</h1><article><p>the article</p></article></main>", "the article"),
        ("<main><h1>A long title of many words</h1><p>and its text</p><article>card</article></main>", "A long title of many words and its text card"),
        ("<div class='layout has-sidebar'><p>kept</p><div class='sideBar sidebar-left'>no</div></div>", "kept"),
        ("<div class='sidebar'><p>a</p><p>b</p><p>c</p></div>", "a b c"), ("<div class='cookie-banner'>We use cookies</div>", ""),
        ("<article>a<div hidden>b</div><div style='display: none'>c</div><div role=navigation>d</div><form><label>e</label></form><p>f</article>", "a f"),
        ("<p title='a>b'>x", "x"), ("<P>UP</P><DIV CLASS=AD>no</DIV>", "UP"),
    ],
)
def test_main_text_of_one_page(page, want):
    from kelvora.llm.html_text import main_text

    assert main_text(page or "")[0] == want


def test_main_text_of_odd_pages(spark):
    """Null ids, urls and pages, repeated rows, deep and long pages, clashing columns, no rows."""
    from kelvora.llm import html_text

    deep = "<div>" * 50_000 + "<p>deep</p>" + "word " * 200_000
    rows = [(1, None, "<p>a</p>"), (None, "u", None), (None, "http://h/", "<p>b</p>"), (2, "http://h/", "<p>b</p>"), (2, "http://h/", "<p>b</p>"), (3, "x", deep)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wide = df.select("*", *[F.lit("?").alias(n) for n in NAMES if n != "html"])
    want = sorted([(1, None, "a", 1), (None, "u", "", 0), (None, "http://h/", "b", 1), (2, "http://h/", "b", 1), (2, "http://h/", "b", 1), (3, "x", " ".join(["deep"] + ["word"] * 200_000), 4 + 5 * 200_000)], key=str)
    for d in (df, wide):
        assert sorted((tuple(r)[:4] for r in html_text.extract(d).collect()), key=str) == want
    assert html_text.extract(df.limit(0)).count() == 0


# ---- fill-in-the-middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def _plain_middle(doc_id, text):
    units, told = UNIT.findall(text or ""), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[i : i + 8], 16) for i in range(0, 32, 8))
    n, text = len(units), text or ""
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzAZ @[`{é中😀\n\0<>PSM0"), max_size=300), st.integers(0, 10**6))
def test_middles(text, doc_id):
    from kelvora.llm import fill_middle

    assert fill_middle.rearranged(text, fill_middle.drawn(doc_id)) == _plain_middle(doc_id, text)


def test_rank_index(monkeypatch):
    """Every rank of texts of very even, very uneven and long units, whole and by slices."""
    from kelvora.llm import fill_middle
    from kelvora.llm.fill_middle import RankIndex, boundaries

    rng = random.Random(5)
    texts = ["", "a", "a" * 5000, " " * 5000, "ab " * 3000, " ".join("x" * rng.choice((1, 1, 1, 400)) for _ in range(3000)), "é中😀a" * 700]
    texts += ["".join(rng.choice("ab .") for _ in range(20_000)), ("w" * 70_000 + " ") * 3]
    for size in (1 << 20, 777):
        monkeypatch.setattr(fill_middle, "SLICE", size)
        for text in texts:
            want = [0]
            for u in UNIT.findall(text):
                want.append(want[-1] + len(u))
            got = boundaries(text)
            assert got.tolist() == want
            index = RankIndex.fit(got)
            again = RankIndex.unpack(index.pack())
            assert again.offsets(np.arange(len(want))).tolist() == want and again.units == len(want) - 1
    long_ = " ".join("y" * rng.randint(1, 9) for _ in range(100_000))
    assert len(RankIndex.fit(boundaries(long_)).rank) < 1000  # a few segments stand for 200,000 boundaries


def test_middles_of_a_table(spark):
    from kelvora.llm import fill_middle

    rng = random.Random(6)
    rows = [(d, t) for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()]
    rows += [(None, "no id at all"), (None, None), (7, ""), (8, "has <S> in it"), (9, "twice told"), (9, "twice told"), (10, "w" * 2_000_000), (11, "".join(rng.choice("ab c") for _ in range(1_500_000))), (12, "ends in <S"), (12, "<P"), (13, "> S> M>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fill_middle.transform(df)
    got = made.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(((d, t, *_plain_middle(d, t)) for d, t in rows), key=str)
    assert all(r.restored == (r.text or "") for r in got)
    told = {(r.doc_id, r.n) for r in fill_middle.indexes(df).collect()}
    assert told == {(d, len(UNIT.findall(t or ""))) for d, t in rows}
    wide = df.select("*", *[F.lit("?").alias(n) for n in NAMES])
    applied = fill_middle.apply(wide)
    assert applied.columns == wide.columns and Counter(r.text for r in applied.collect()) == Counter(r.output for r in got)
    assert fill_middle.transform(df.limit(0)).count() == 0 and made.explain() is None


# ---- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain_features(text, grams, buckets):
    words = WORD.findall((text or "").translate(LOW))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(words) - n + 1)], len(words)


def _plain_resample(docs, target, grams, buckets, percent, least):
    s, t = Counter(), Counter()
    own = [_plain_features(x, grams, buckets) for _, x in docs]
    for f, _ in own:
        s.update(f)
    for x in target:
        t.update(_plain_features(x, grams, buckets)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for (d, _), (f, words) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize(("grams", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 500, 40, 1), (2, 7, 100, 0), (1, 50, 0, 5)])
def test_importance_against_a_plain_version(spark, grams, buckets, percent, least, monkeypatch):
    from kelvora.llm import importance

    rng = random.Random(7)
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    docs += [(None, "a few Words of ÉTÉ été 12ab!"), (None, None), (5, ""), (9, "same text " * 30), (9, "same text " * 30), (10, "x" * 1_200_000), (11, " ".join(rng.choice(("ab", "C", "été")) for _ in range(150_000)))]
    docs += [(None, "tied row " * 15)] * 7 + [(d, docs[3][1]) for d in range(3000, 3040)]
    target = [x for (x,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wide = df.select("*", *[F.lit("?").alias(n) for n in NAMES])
    got = importance.resample(wide, spark.createDataFrame([(x,) for x in target], "text string"), grams, buckets, percent=percent, least_words=least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain_resample(docs, target, grams, buckets, percent, least)


def test_features_in_parts(monkeypatch):
    """Runs of words across parts, and across the ends of documents."""
    from kelvora.llm import importance

    monkeypatch.setattr(importance, "AT_ONCE", 3)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    for grams in (1, 2, 4):
        got = defaultdict(Counter)
        for bucket, doc, _ in importance.features([t.encode() for t in texts], grams, 1000):
            for b, d in zip(bucket.tolist(), doc.tolist(), strict=True):
                got[d][b] += 1
        assert {d: c for d, c in got.items()} == {d: Counter(f) for d, t in enumerate(texts) if (f := _plain_features(t, grams, 1000)[0])}


def test_importance_of_no_rows_and_samples(spark):
    from kelvora.llm import importance

    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert importance.resample(docs.limit(0), target).count() == 0
    told = importance.resample(docs, target.limit(0))
    n, drawn = told.where("n_words >= 20").count(), told.where("rank is not null").count()
    assert told.count() == docs.count() and drawn == n // 10
    sampled = importance.sample(docs, target, percent=50)
    assert sampled.columns == docs.columns and sampled.count() == importance.resample(docs, target, percent=50).where("rank is not null").count()


# ---- mended cases

def test_every_day_moves_to_a_day(spark):
    """Of the calendar itself: the pseudonyms of all days from 1900 to 2099 are all these days."""
    from datetime import date, timedelta

    from kelvora.llm import pii

    days = [(date(1900, 1, 1) + timedelta(days=k)).isoformat() for k in range((date(2100, 1, 1) - date(1900, 1, 1)).days)]
    got = [r.x for r in spark.createDataFrame([(d,) for d in days], "d string").select(pii.date(F.col("d"), "key").alias("x")).collect()]
    assert sorted(got) == days and got != days


def test_scores_of_weights_beyond_64_bits(spark):
    from kelvora.llm import topk

    rows = [(100, [1e16, 1e16, 0.0]), (1, [1e16, -1e16, 0.001]), (2, [1e16, -1e16, -0.001]), (3, [1e-3, 1e-3, 5.0]), (4, [1e306, 0.0, 0.0]), (5, [-1e30, 1e30, 7.0])]
    whole = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: r.score for r in topk.search(whole.where("vec_id = 100"), whole).collect()}
    assert got == {1: 0, 2: 0, 3: 2**63 - 1 if 2 * int(1.024e19) > 2**63 - 1 else 2 * int(1.024e19), 5: 0}
