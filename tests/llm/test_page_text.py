"""Main texts of pages: the blocks that markup leaves, repeats against a comparison of all pairs, and whole pages."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from clustrum.llm import carries, markup, page_text
from clustrum.llm.markup import ARTICLE, CHROME, OPEN, REGION

SCHEMA = "page_id long, url string, html string, `text` string, BLOCKS int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def texts(spark, rows):
    return sorted((tuple(r) for r in page_text.extract(frame(spark, rows)).collect()), key=str)


@pytest.mark.parametrize(("page", "want"), [
    ("<p>a<p>b<!-- c > -->d<script>var x='</p>'</script> e", [("a", OPEN), ("bd e", OPEN)]),
    ("<nav>m</nav><div class='ad'>buy</div><article><h1>T</h1><p>x<br>y &amp;lt;&nbsp;z\n w</p></article><footer>f</footer>", [("m", CHROME), ("buy", CHROME), ("T", ARTICLE), ("x y &lt; z w", ARTICLE), ("f", CHROME)]),
    ("<body class='has-sidebar'><div id='content'><h1 class='header'>T</h1><ul><li>i<li>j</ul><div id='comments'><article class='comment'>c</article></div></div>", [("T", REGION), ("i", REGION), ("j", REGION), ("c", CHROME)]),
    ("<form><article><header><h1>T</h1></header>b<aside>s</aside><footer>f</footer></article></form>", [("T", ARTICLE), ("b", ARTICLE), ("s", CHROME), ("f", CHROME)]),
    ("a < b <a href='x>y'>c</a> <tit", [("a < b c", OPEN)]),
    ("<p>x<span class='advert'>buy</span>y</p><div style='display: none'>h</div>", [("xy", OPEN), ("buy", CHROME), ("h", CHROME)]),
    ("<title>t</title><main><div class='cookie-notice'>n</div><table><tr><td>1</td><td>2</td></tr></table></main>", [("n", CHROME), ("1 2", REGION)]),
    ("<div class='content-sidebar-wrap'><div class='post'>p</div><div class='ad-container'>a</div><div id='comments-wrapper'>c</div></div><ins class='adsbygoogle'>g</ins>", [("p", REGION), ("a", CHROME), ("c", CHROME), ("g", CHROME)]),
    ("<div class='layout no-sidebar'><div class='main-menu'>m</div><div class='article-header'><h1>T</h1></div><p>b</p><div class='text-center'>x</div></div>", [("m", CHROME), ("T", REGION), ("b", OPEN), ("x", OPEN)]),
    ("<p>a<!-- never closed <p>b</p>", [("a", OPEN)]),
    ("</div></p></article>x", [("x", OPEN)]),
    ("", []), (None, []), ("<br><hr>", []),
])
def test_blocks(page, want):
    assert [(p.text, p.mark) for p in markup.pieces(page)] == want


def test_broken_pages_end():
    """Text of nothing but tag starts and quotes takes time in proportion."""
    for page in ("<a" * 30_000 + ">", '<a "' * 30_000 + ">", "<div>" * 20_000 + "x", "<!--" * 30_000, "<script>" * 20_000, "<li>" * 20_000):
        markup.pieces(page)


def stream(page):
    """(words with a mark on a block's first, block of each)"""
    out = []
    for b, p in enumerate(markup.pieces(page)):
        out += [(w.lower(), k == 0, b) for k, w in enumerate(p.text.split())]
    return out


def brute_extents(rows):
    pages = {(u, h): stream(h) for _, u, h in rows if page_text.host(u)}
    heads = {k: [i for i, t in enumerate(s) if t[1]] for k, s in pages.items()}
    out = {}
    for k, s in pages.items():
        for i in heads[k]:
            best, size = 0, sum(t[2] == s[i][2] for t in s)
            for k2, s2 in pages.items():
                if k2 == k or page_text.host(k2[0]) != page_text.host(k[0]):
                    continue
                for j in heads[k2]:
                    a, b = [t[:2] for t in s[i:]] + [None] * 8, [t[:2] for t in s2[j:]] + [None] * 8
                    n = next((n for n in range(8) if a[n] != b[n]), 8)
                    rest = lambda t, at: [w for w, _, c in t[at + 8 :] if c == t[at][2]]
                    best = max(best, n + (n == 8 and rest(s, i) == rest(s2, j)))
            if best >= page_text.LONG:
                out[k, s[i][2]] = min(max(size, 8) if best > 8 else best, len(s) - i)
    return out


@pytest.mark.parametrize(("pages", "fan"), [(10_000, 1024), (4, 1024), (2, 3)])
def test_repeats_against_all_pairs(spark, monkeypatch, pages, fan):
    """In few and in many partitions, whose edges cut runs of equal suffixes and of one page."""
    monkeypatch.setattr(page_text, "PAGES", pages)
    monkeypatch.setattr(carries, "FAN", fan)
    rng = random.Random(pages)
    line = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    shared = [line(n) for n in (1, 3, 5, 8, 9, 20)] + ["x y z w v u t s r " + line(4) for _ in range(2)]
    rows = []
    for i in range(26):
        lines = [rng.choice(shared) if rng.random() < 0.5 else line(rng.choice((1, 4, 9, 14))) for _ in range(rng.randint(0, 7))]
        rows.append((i, rng.choice(("http://A.b/1", "https://a.b:80/2", "http://c.d", "nohost", None)), "".join(f"<p>{x}</p>" for x in lines)))
    rows += [rows[3], (99, *rows[3][1:])]
    df = frame(spark, rows).withColumn("page", F.xxhash64("url", "html")).withColumn("tie", F.col("page_id"))
    names = {r["page"]: (r["url"], r["html"]) for r in df.collect()}
    got = {(names[r["page"]], r["block"]): r["extent"] for r in page_text.repeated(df).collect()}
    assert got == brute_extents(rows)


def test_repeated_blocks_go_and_articles_stay(spark):
    chrome = "<div>Subscribe to our weekly letter today</div><div>All rights are kept by us</div>"
    own = [f"<p>Story {i} tells of {'one two three four five six'.split()[i]} things that nobody else knows {i}</p>" for i in range(3)]
    bare = [(i, f"http://h.x/{i}", f"{chrome}{own[i]}") for i in range(3)]
    plain = [re.sub("<.*?>", "", x) for x in own]
    assert [r[2] for r in texts(spark, bare)] == plain
    # the same story at another address, in an article: a copy is no boilerplate
    twice = [(i, f"http://h.x/{i}", f"<nav>unique {i}</nav><article>{own[0]}</article>{chrome}") for i in range(3)]
    assert [r[2] for r in texts(spark, twice)] == [plain[0]] * 3
    # bare copies: nothing on them is unique
    assert texts(spark, [(0, "http://h.x/0", own[0]), (1, "http://h.x/1", own[0])])[0][2] == plain[0]


def test_edges(spark):
    page = "<article>éè x</article>"
    rows = [(1, None, page), (1, None, page), (None, "http://a.b", None), (3, "http://a.b", ""), (4, "http://a.b", "<nav>only a menu</nav>"), (5, "", "<p>" + "long " * 30_000 + "</p>")]
    got = texts(spark, rows)
    assert [r for r in got if r[0] == 1] == [(1, None, "éè x", 4)] * 2
    assert {r[0]: r[2:] for r in got if r[0] not in (1, 5)} == {None: ("", 0), 3: ("", 0), 4: ("", 0)}
    assert next(r[3] for r in got if r[0] == 5) == 149_999
    assert texts(spark, []) == []


def test_query_against_a_plain_reading(spark, tables):
    """The given pages are of one kind, whose article a few patterns can read."""
    want = []
    for r in spark.read.parquet(f"{tables}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        text = "\n".join(x for x in lines if x)
        want.append((r["page_id"], r["url"], text, len(text)))
    assert sorted(tuple(r) for r in page_text.op11_page_text(spark, tables).collect()) == sorted(want)


def test_pages_are_parsed_once(spark, monkeypatch):
    """Finding the ranges of the suffixes doesn't parse the pages again."""
    parsed, whole = spark.sparkContext.accumulator(0), page_text._suffix_rows

    def counted(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield from whole(iter([batch]))

    monkeypatch.setattr(page_text, "_suffix_rows", counted)
    rows = [(i, i, f"http://h.org/{i}", f"<p>one two three four five six {i}</p>") for i in range(20)]
    assert page_text.repeated(spark.createDataFrame(rows, "page long, tie long, url string, html string")).count() == 20
    assert parsed.value == 20
