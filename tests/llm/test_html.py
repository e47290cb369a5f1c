import html
import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarryline.llm import html_consensus as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><article><h1>{title}</h1><p><b>One &amp; two.<br><p>Three
  four&nbsp;five.</p></article><div class="comments"><p>First!</p></div><footer>&copy; x</footer></body></html>"""


def test_an_article_among_noise():
    assert H.extract(PAGE.format(title="Big &lt;news&gt; &am"))[0] == "Big <news> &am\nOne & two.\nThree four five."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<article><p>cut o", "cut o"), ("<article><p>x &#233;&#x41; &am", "x éA &am"),
        ("<article><p>whole</p><p cla", "whole"), ("<article>a<br>b<aside>no</aside><form>no</form><header>no? yes</header></article>", "a b\nno? yes"),
        ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>", "a\nb\n1\n2"), ("<body><div role=navigation>no</div><div hidden>no</div><p>yes", "yes"), ("<article><p>open <b>bold <i>both</p><p>next</p></article>", "open bold both\nnext"),
        ("<article>" + "<div>" * 600 + "deep", "deep"), ("<article><p>a <!-- never closed", "a"),
    ],
)
def test_small_pages(html, text):
    assert H.extract(html)[0] == text


NOISY = "<script>var leak=1;</script><nav>menu leak</nav><form>form leak</form><aside>leak</aside>"


@pytest.mark.parametrize("tag", ["div", "b", "section"])
def test_any_depth(tag):
    """Noise inside very many open elements stays noise."""
    assert H.extract("<article><p>start" + f"<{tag}>" * 100_000 + NOISY + "<p>deep</p>")[0] == "start\ndeep"
    assert H.extract("<body>" + f"<{tag}>" * 510 + NOISY + "<p>deep</p>" + f"</{tag}>" * 510 + "<footer>x</footer>")[0] == "deep"


def test_a_long_page():
    parts = [f"part {i} of the page" for i in range(30_000)]
    assert H.extract("<nav>menu</nav><article>" + "".join(f"<p>{x}" for x in parts) + "</article>" + NOISY)[0] == "\n".join(parts)


TEXT = "running text of some length. " * 12


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body><div class="page related-content"><p>hello text</p></div>', "hello text"),
        (f'<body><div class="main comments-enabled"><p>{TEXT}</p></div><div class="comments"><p>no</p></div>', TEXT.strip()),
        (f'<body><h1>Title</h1><div class="widget"><p>{TEXT}</p><nav>no</nav></div><div class="sidebar">no</div>', TEXT.strip()),
        (f'<article><p>short</p></article><div class="sidebar">{TEXT}</div>', "short"),
        (f'<article><p>short</p></article><div class="comments">{TEXT}</div>', "short"),
        ('<body><div class="comments"><p>only comments</p></div>', ""), ('<body><div role="dialog"><p>only a dialog</p></div>', ""),
    ],
)
def test_names_weigh_and_tags_decide(page, text):
    assert H.extract(page)[0] == text


HALF = "a sentence of the article. " * 9


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>The <span class="notice">word</span> matters.</p></article>', "The word matters."),
        ('<article><p>The <mark class="social">word</mark> matters.</p></article>', "The word matters."),
        ('<article><h2 id="related">Related work</h2><p>x</p><h2 id="comments">On comments</h2><p class="share">text</p></article>', "Related work\nx\nOn comments\ntext"),
        ('<article><p>x</p><div class="share">no</div><ul class="related"><li>no</ul></article>', "x"),
        (f'<body><form id="aspnetForm"><div><p>{HALF}</p><input value=no><select><option>no</select></div></form></body>', HALF.strip()),
        (f'<body><form id="f"><nav>no</nav><article><p>{HALF}</p></article></form></body>', HALF.strip()),
        (f"<body><div><p>{HALF}</p></div><form><p>Your name and mail please</p></form></body>", HALF.strip()),
        (f"<body><main><p>short</p></main><form><p>{HALF}</p></form></body>", "short"),
        (f"<body><div><div><p>{HALF}</p></div><div><p>{HALF}{HALF}</p></div></div><footer>no</footer></body>", f"{HALF.strip()}\n{(HALF + HALF).strip()}"),
        (f"<body><div><p>{HALF}</p></div><div><p>{HALF[:80]}</p></div></body>", f"{HALF.strip()}\n{HALF[:80].strip()}"),
        (f"<body><article><p>{HALF}</p></article><div><p>{HALF[:100]}</p></div></body>", HALF.strip()),
        (f'<body><div><p>{HALF}</p></div><div><a href="/">{HALF}</a></div></body>', HALF.strip()),
    ],
)
def test_names_of_small_parts_forms_and_siblings(page, text):
    assert H.extract(page)[0] == text


def by_text_share(page):
    """Pages without an article: what isn't in a nav, aside, footer, form or script, by a plain search over blocks."""
    body = re.sub(r"<(nav|aside|footer|header|form|script|style|head)\b.*?</\1>", "", page, flags=re.S)
    return "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"</?(?:b|i|a|em|span)\b[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|div|section|ul|li|body|html)\b[^>]*>", body))))


@pytest.mark.parametrize("seed", range(5))
def test_pages_without_an_article(seed):
    import random

    rng = random.Random(seed)
    sentence = lambda: " ".join(f"<span class='share'>w{rng.randrange(99)}</span>" if rng.random() < 0.1 else f"word{rng.randrange(999)}" for _ in range(rng.randrange(30, 60))) + "."
    parts = "".join(rng.choice([f"<div class='c{i}'><p>{sentence()}</p><p>{sentence()}</p></div>", f"<section><h2 id='related'>Head {i}</h2><p class='social'>{sentence()}</p></section>"]) for i in range(rng.randrange(2, 4)))
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><aside>{sentence()}</aside><div id='w'>{parts}</div><form><p>Sign here</p></form><footer>f</footer></body></html>"
    assert H.extract(page)[0] == by_text_share(page)


def by_search(page):
    """The article by plain searches in the source: no tree, no scores, no votes."""
    found = re.search(r"<article\b[^>]*>(.*)</article>", page or "", re.S)
    body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", found[1] if found else "", flags=re.S)
    parts = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", body)
    texts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub(r"</?(?:b|i|a|em|span)\b[^>]*>", "", x))).split()) for x in parts]
    return "\n".join(filter(None, texts))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_all_pages_against_a_search():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    assert len(pages) > 100 and [H.extract(p)[0] for p in pages] == [by_search(p) for p in pages]


def test_host_paths_are_voted_and_used(spark):
    page = '<body><div class="post p{0}"><p>{1}</p></div><div class="widget"><p>noise noise</p></div></body>'
    odd = '<body><div class="other"><p>{}</p></div><div class="post p9"><p>short</p></div></body>'
    rows = [(i, f"http://Host.a/{i}", page.format(i, f"text number {i} of this page")) for i in range(5)]
    rows += [(10, "http://host.a/x", odd.format("much longer text " * 20)), (11, None, "<p>lonely"), (12, "http://b/", None), (12, "http://b/", None)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["host_path"], r["text"]) for r in H.main_text(df).collect()), key=str)
    assert len(got) == len(rows)
    by_id = {p: (h, t) for p, h, t in got}
    assert by_id[3] == (">body>div.p0.post", "text number 3 of this page")
    assert by_id[10] == (">body>div.p0.post", "short")
    assert by_id[11] == (None, "lonely") and by_id[12] == (None, "")
    assert H.main_text(df.limit(0)).count() == 0


def test_every_container_votes_and_ties_are_settled(spark):
    """The fourth best container of every page is the one that all pages of the host share."""
    page = '<body><div class="t{0} x{1}"><p>{2}</p></div><div class="u{1} y{1}"><p>{2}</p></div><div class="v{1} z{1}"><p>{2}</p></div><div class="keep"><p>kept {0} words</p></div>'
    names = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    rows = [(i, "http://h/", page.format(i, names[i], "long text here " * 2)) for i in range(8)]
    votes = {r["host"]: r["path"] for r in H.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    root, by_path = H.scored(H.parsed(rows[0][2]))
    assert H.path_of(by_path[votes["h"]][0]) == ">body"  # all of it is common to all pages
    even = [(i, "http://e/", f'<div class="{c}"><p>text</p></div>') for i, c in enumerate(["one", "two"])]
    df = spark.createDataFrame(even, "page_id long, url string, html string")
    assert len({r["path"] for r in H.winning_paths(df).collect() + H.winning_paths(df.orderBy(F.desc("page_id"))).collect()}) == 1
