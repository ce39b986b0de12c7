"""Main text of pages: against the labelled elements, pages of other forms, and every odd page."""

import re
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import main_text


def labelled(html):
    """The text of the one article element, by substitution alone."""
    found = re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1]
    return " ".join(unescape(re.sub(r"</?b>", "", found).replace("<br>", " ") if "<p" not in found else re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", found))).split())


def test_every_page_has_its_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in main_text.op12_main_text(spark, sf_dir).collect()}
    assert {k: r.text for k, r in got.items()} == {p.page_id: labelled(p.html) for p in pages}
    assert all(r.n_chars == len(r.text) for r in got.values()) and {r.page_id: r.url for r in got.values()} == {p.page_id: p.url for p in pages}


def test_the_labelled_tag_itself_is_not_needed(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = main_text.learn(pages)
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    assert {r.page_id: r.text for r in main_text.extract(bare, weights).collect()} == {p.page_id: labelled(p.html) for p in pages.collect()}


P = "<p>" + "some words of a paragraph that is long enough to matter here " * 3 + "</p>"
TEXT = "some words of a paragraph that is long enough to matter here " * 3


@pytest.fixture(scope="module")
def weights(spark, sf_dir):
    return main_text.learn(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("   \n ", ""),
        ("plain text only", "plain text only"),
        ("a < b &amp; c > d", "a < b & c > d"),
        (f"<nav><a>one</a><a>two</a></nav><div id='main'><h2>Head</h2>{P}</div><footer>foot of the page</footer>", f"Head {TEXT}"),
        (f"<header>Site name and its motto</header><main>{P}<aside>see also this other page and that one</aside>{P}</main>", f"{TEXT}{TEXT}"),
        (f"<div class='sidebar'>{P}</div><div class=content>{P}{P}</div><section id=\"comments\">{P}{P}{P}{P}</section>", f"{TEXT}{TEXT}"),
        (f"<form><label>Mail</label><button>Send it now</button></form>{P}<div class='cookie-notice'>We use cookies on this page.</div>", TEXT),
        ("<p>x<b>y</b>z <i>w</i><br>v</p>", "xyz w v"),
        ("<table><tr><td>1</td><td>2</td></tr></table>", "1 2"),
        (f"{P}<script>var t='</p><p>no';</script><style>p{{}}</style><!-- no > no --><noscript>no</noscript>", TEXT),
        (f"{P}<script>never ends {P}", TEXT),
        (f"{P}<!-- never ends {P}", TEXT),
        (f"<p title=\"a > b\">{TEXT}", TEXT),
        (f"<p title=\"never ends>{TEXT}</p>", TEXT),
        ("&#65;&#x42;&copy; &amp;amp; &amp &unknown;", "AB© &amp; & &unknown;"),
        ("<p>ünï &nbsp; 日本</p>", "ünï 日本"),
        ("<nav>only a menu</nav>", ""),
        ("<p", ""),
        ("<", "<"),
        ("</p></div><3 hearts", "<3 hearts"),
    ],
)
def test_other_pages(weights, html, want):
    assert weights.extract(html) == " ".join(want.split())


def test_odd_rows(spark, weights):
    long = "<article>" + P * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (None, "v", P, "z"), (3, "w", P, "z"), (3, "w", P, "z"), (4, "w", long, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in main_text.extract(pages, weights).collect()), key=str)
    whole, every = TEXT.strip(), " ".join((TEXT * 20_000).split())
    assert got == sorted([(1, "u", "", 0), (2, "", "", 0), (0, "v", whole, len(whole)), (3, "w", whole, len(whole)), (3, "w", whole, len(whole)), (4, "w", every, len(every))], key=str)
    assert main_text.extract(pages.where("false"), weights).collect() == [] and main_text.learn(pages.where("false")).learned == {}


def test_learning_is_bounded_and_counts_equal_pages_once(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    first = pages.limit(1)
    many = pages.unionByName(first.crossJoin(spark.range(2000)).select(*pages.columns)).withColumn("page_id", F.lit(None).cast("long"))
    weights = main_text.learn(many, sample=20)
    assert {r.text for r in main_text.extract(first, weights).collect()} == {labelled(first.first().html)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_best_part_against_all_parts(scores):
    begin, end = main_text.best_part(np.array(scores, np.float64))
    sums = [(sum(scores[i:j]), -j, i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    best = max(sums, default=(0, 0, 0))
    if best[0] <= 0:
        assert (begin, end) == (0, 0)
    else:
        assert (sum(scores[begin:end]), -end, begin) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "p", "div", " class='ad'", "=", '"', "'", "<!--", "-->", "<script>", "</script>", "word ", "&amp;", "é", "/"]), max_size=30).map("".join))
def test_any_page_is_read(html):
    assert isinstance(main_text.Weights({}).extract(html), str)
