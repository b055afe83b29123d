"""Wrapper induction against brute force and small pages."""

import itertools
import sys

import numpy as np
import pandas as pd
import pytest

from hearthline.llm import html_extract
from hearthline.llm.html_extract import Node, align, main_text, merge, read_in, written_out

DATA = "/root/testdata/sf0.001"


def test_main_text_of_pages(spark):
    page = lambda k: f"<html><head><title>t</title><script>x</script></head><body><nav><a>Home</a></nav><div class='ad'>Buy {k}</div><article><h1>Head &amp; {k}</h1><p>Own\n text  {k}</p><p>Same line</p></article><div class='comments'><p>c{k}</p></div><footer>f</footer></body></html>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)] + [(20, None, None), (21, "http://o.example", ""), (22, "http://h.example/z", page(3))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20] == got[21] == ""
    assert got[3] == got[22]
    assert got[5].split("\n")[:2] == ["Head & 5", "Own text 5"]
    assert "Buy" not in got[5] and "Home" not in got[5] and "c5" not in got[5]


def test_constant_text_goes_from_hosts_of_few_pages(spark):
    page = lambda k: f"<body><div class='x'>Shop open daily</div><article><p>Own text {k}</p></article><div class='y'>Made with care</div><div class='z'>Extra {k}</div></body>"
    flat = lambda k: f"<body><div class='x'>Shop open daily</div><p>Own text {k}</p></body>"
    rows = [(k, f"http://two.example/{k}", flat(k)) for k in range(2)] + [(30 + k, f"http://flat.example/{k}", flat(k)) for k in range(3)] + [(10 + k, f"http://three.example/{k}", page(k)) for k in range(3)] + [(20, "http://one.example/", flat(0)), (21, "http://one.example/copy", flat(0))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[0], got[1]] == ["Shop open daily\nOwn text 0", "Shop open daily\nOwn text 1"]  # two pages that agree are no evidence
    assert [got[10], got[12]] == ["Own text 0", "Own text 2"]
    assert got[20] == got[21] == "Shop open daily\nOwn text 0"  # copies tell nothing
    assert [got[30 + k] for k in range(3)] == [f"Own text {k}" for k in range(3)]


def test_wrapper_holds_the_layouts_of_all_pages_however_many_copies(spark):
    page = lambda k: f"<body><div class='k{'abcdefghij'[k]}'><i>x</i></div><div class='x'>Shop open daily</div><p>Own text {k}</p></body>"
    rows = [(100 * k + c, f"http://many.example/{k}/{c}", page(k)) for k in range(10) for c in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = html_extract.parsed(pages)
    [wrapper] = html_extract.induce(own).collect()
    assert all(f"div.k{x}" in wrapper["tree"] for x in "abcdefghij")
    [row] = html_extract.constant(own, html_extract.placed(own, html_extract.induce(own))).collect()
    assert len(row["template"]) == 1
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert all(got[100 * k + 7] == f"x\nOwn text {k}" for k in range(10))


@pytest.mark.parametrize("html, text", [
    ("<div>" * 200 + "<script>var x = '<p>no</p>';</script><nav>menu</nav><p>Body &amp; text</p></span></section><p>more" + "</div>" * 100 + "<p>end", "Body & text\nmore\nend"),
    ('<body><div class="layout no-sidebar"><h1>T</h1><p>para one</p></div></body>', "T\npara one"),
    ('<body><div class="sidebar-layout sidebar"><h1>T</h1><p>para one and more</p></div><div class="sidebar">s</div></body>', "T\npara one and more"),
    ('<body><article><div class="entry-header"><h1>Title</h1></div><p>x y</p><section class="comments"><p>c</p></section></article></body>', "Title\nx y"),
    ('<body><form id="page"><div class="header">H</div><div class="content"><h1>Title</h1><p>long text here and more</p></div></form></body>', "Title\nlong text here and more"),
    ('<body><h1>T</h1><p>short</p><div class="comments"><p>many comments that are longer than the text</p></div><form>search here</form></body>', "T\nshort"),
    ("<ul><li>a<li>b</ul><p>c<p>d<br>e <b>f</b>g<!-- x --> h<a title='>'>i</a> 1 < 2 <table><tr><td>q<td>r</table><title>no</title> &lt;b&gt;", "a\nb\nc\nd e fg hi 1 < 2\nq\nr\n<b>"),
    ("<p title=\"a>b>c</p><p>still here</p>", "b>c\nstill here"),
    ("<script>x</scripty></script>y<style>z", "y"),
    ("a <!-- never closed <p>b</p>", "a"),
    ("", ""), (None, ""), ("   ", ""), ("<", "<"), ("<p", "<p"),
])
def test_text_of_one_page(html, text):
    assert main_text(html) == text


def _tree(rng, depth=0):
    node = Node("ab"[rng.integers(2)] if depth else "r")
    for _ in range(int(rng.integers(0, 4 - depth)) if depth < 3 else 0):
        node.kids.append(_tree(rng, depth + 1))
    return node


def _brute(a, b):
    """The most pairs, over every choice of children in order."""
    if a.kind != b.kind:
        return 0
    best = 0
    for n in range(1, min(len(a.kids), len(b.kids)) + 1):
        for x in itertools.combinations(a.kids, n):
            for y in itertools.combinations(b.kids, n):
                best = max(best, sum(_brute(p, q) for p, q in zip(x, y, strict=True)))
    return 1 + best


def _count(node):
    return 1 + sum(map(_count, node.kids))


def test_alignment_is_that_of_brute_force_and_merging_keeps_both_trees():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a, b = _tree(rng), _tree(rng)
        most, n, m = _brute(a, b), _count(a), _count(b)
        assert align(a, b, {})[0] == most
        text = written_out(b)
        merge(a, b)
        assert _count(a) == n + m - most
        whole = written_out(a)
        assert written_out(read_in(whole)[0]) == whole
        got = html_extract.slots(whole, text)
        assert len(got) == m and got[0] == 0 and len(set(got)) == m


def test_deep_and_long_pages(spark):
    sys.setrecursionlimit(1000)
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    wide = "".join(f"<p>text {k}</p>" for k in range(20_000))
    rows = [(1, "http://a.example/1", deep), (2, "http://a.example/2", wide), (3, "http://a.example/3", deep.replace("deep", "other"))]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "deep text" and got[3]["text"] == "other text"
    assert got[2]["text"].count("\n") == 19_999 and got[2]["n_chars"] == len(got[2]["text"])


def test_null_repeated_and_clashing_columns(spark):
    rows = [(None, None, None), (1, "http://a.example/", "<p>x</p>"), (1, "http://a.example/", "<p>x</p>"), (2, None, "<p>y</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS tree", "3 AS template", "4 AS layout", "5 AS blocks", "6 AS row", "7 AS key", "8 AS slots", "'old' AS text", "9 AS n_chars")
    got = html_extract.extract(pages).collect()
    assert set(got[0].asDict()) == {"page_id", "url", "host", "tree", "template", "layout", "blocks", "row", "key", "slots", "text", "n_chars"}
    assert sorted(((r["page_id"] or 0), r["text"], r["n_chars"], r["host"], r["row"], r["slots"]) for r in got) == [(0, "", 0, 1, 6, 8), (1, "x", 1, 1, 6, 8), (1, "x", 1, 1, 6, 8), (2, "y", 1, 1, 6, 8)]


def test_shuffled_join_gives_the_same_rows(spark, monkeypatch):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    want = sorted(map(tuple, html_extract.extract(pages).collect()))
    monkeypatch.setattr(html_extract, "WRAPPER_BYTES", 0)
    assert sorted(map(tuple, html_extract.extract(pages).collect())) == want and len(want) == len(pd.read_parquet(f"{DATA}/pages.parquet"))


def _pages(spark, bodies):
    return spark.createDataFrame([(k, f"http://a.example/{k}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)], "page_id long, url string, html string")


def _texts(spark, bodies):
    return [r["text"] for r in html_extract.extract(_pages(spark, bodies)).orderBy("page_id").collect()]


def test_near_copies_keep_their_text(spark):
    same = "<h1>One title</h1><p>A first paragraph that both pages hold.</p><p>A second one, which is the longest of them all here.</p><p>A third.</p>"
    whole = "One title\nA first paragraph that both pages hold.\nA second one, which is the longest of them all here.\nA third.\n"
    for n in (2, 5):
        assert _texts(spark, [f"{same}<p>Edited {k}.</p>" for k in range(n)]) == [f"{whole}Edited {k}." for k in range(n)]
        edited = [f"{same}<p>Edited {k}: now the longest paragraph of all on the page, by far and wide.</p>" for k in range(n)]
        assert _texts(spark, edited) == [f"{whole}Edited {k}: now the longest paragraph of all on the page, by far and wide." for k in range(n)]
        assert _texts(spark, [f"<article>{b}</article>" for b in edited]) == _texts(spark, edited)


def test_unnamed_boilerplate_goes_through_the_wrapper(spark):
    bodies = [f"<div><p>Our shop, open daily</p></div><div><p>Story {k} tells of {'house ' * (9 + k)}</p><p>and ends {k}.</p></div><div><p>All about us</p></div>" for k in range(4)]
    assert _texts(spark, bodies) == [f"Story {k} tells of {('house ' * (9 + k)).strip()}\nand ends {k}." for k in range(4)]
    assert all("Our shop" in t for t in _texts(spark, bodies[:2]))  # two pages are no evidence
    inside = [f"<article>{b}</article>" for b in bodies]
    assert all(t.startswith("Our shop, open daily\nStory") for t in _texts(spark, inside))


@pytest.mark.parametrize("name", ["notice-of-death", "side-effects", "menu-items", "ad-hoc"])
def test_compound_names_inside_an_article_are_its_own(name):
    assert main_text(f'<article><p>First.</p><div class="{name}"><p>Kept.</p></div></article>') == "First.\nKept."
    assert main_text(f'<article><p>First, and long enough.</p></article><div class="site-footer"><p>Gone.</p></div>') == "First, and long enough."
