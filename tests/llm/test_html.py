"""Blocks of pages, the host suffix array and main texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import html

PAGE = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header>Site <b>name</b></header>
<article class="post"><header><h1>The&nbsp;title &amp; more</h1></header><p>First <b>para</b>graph,<br>one 3 &lt; 4 &#233;<script>var t="</p>";</script> here
<p>Second <!-- <p>no</p> --> <a href='a>b'>link</a><div id="share-box">Tweet</div><form><input name=q>Ask</form><ul><li>item</ul>
<aside>Beside</aside><blockquote>Quoted</blockquote><div class="adSlot">Buy</div><footer>By me</footer></article>
<section id="comments"><article class="comment"><p>Reader says</article></section><div class=sidebar>Side</div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_texts([PAGE]) == ["The title & more\nFirst paragraph, one 3 < 4 é here\nSecond link\nitem\nQuoted"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text only", "plain text only"),
        ("a < b and c &am", "a < b and c &am"),
        ("<p>one<p>two<div>three", "one\ntwo\nthree"),
        ("<p>open <b>bold<p>next</b> on", "open bold\nnext on"),
        ("<div>kept</div><script>never ends", "kept"),
        ("<div>kept <a href='unclosed", "kept"),
        ("<main>in</main><!-- comment never ends", "in"),
        ("</div></p>stray<p></nav>end", "stray\nend"),
        ("<NAV>x</NAV><P CLASS='Intro'>y", "y"),
        ("<p>a&#x41;&eacute;&bogus; \n\t b</p>", "aAé&bogus; b"),
        ("<table><tr><td>c1<td>c2</table>", "c1\nc2"),
        ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages_of_one(page, text):
    assert html.main_texts([page]) == [text]


def brute_repeated(streams, run):
    def windows(s):
        return {tuple(s[i : i + run]) for i in range(len(s) - run + 1)}

    out = []
    for i, s in enumerate(streams):
        others = set().union(*[windows(t) for j, t in enumerate(streams) if j != i])
        covered = [False] * len(s)
        for at in range(len(s) - run + 1):
            if tuple(s[at : at + run]) in others:
                covered[at : at + run] = [True] * run
        out.append(covered)
    return out


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=6), st.integers(1, 9))
def test_suffix_array_against_brute_force(streams, run):
    found = html.repeated([np.array(s, np.int64) for s in streams], run)
    assert [f.tolist() for f in found] == brute_repeated(streams, run)


def test_repeated_runs_go_unless_an_article_holds_them():
    draw = random.Random(1)
    menu = " ".join(f"m{i}" for i in range(12))
    pages = [f"<div>{menu} on {i}</div><div>{' '.join(draw.choice('abcdefgh') + str(i) for _ in range(20))}</div>" for i in range(4)]
    for i, text in enumerate(html.main_texts(pages)):
        assert "m3" not in text and text.split("\n")[0] == str(i) and len(text.split("\n")) == 2
    copies = [f"<div>{menu}</div><article><p>{menu}</p></article>"] * 3
    assert html.main_texts(copies) == [menu] * 3


def page_rows(n):
    menu = " ".join(f"m{i}" for i in range(12))
    rows = [(i, f"https://{'big' if i % 3 else 'h' + str(i % 5)}.example.com/{i}", f"<div>{menu}</div><div>only {i}</div>", "clash", "clash") for i in range(n)]
    return rows + [(None, None, "<p>no host", "", ""), (7, "not a url", None, "", ""), (7, "not a url", None, "", ""), (8, "http://lone.example/", "", "", "")]


@pytest.mark.parametrize("shard_pages", [512, 20])
def test_pages_by_host(spark, shard_pages):
    table = spark.createDataFrame(page_rows(150), "page_id bigint, url string, html string, text string, host string")
    found = html.extract_main(table, shard_pages=shard_pages)
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in found.collect())
    want = [(str(i), u, f"only {i}" if i is not None and h else ("no host" if h else "")) for i, u, h, *_ in page_rows(150)]
    assert got == sorted((i, str(u), t, len(t)) for i, u, t in want)


def test_no_pages(spark):
    assert html.extract_main(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_every_page_has_its_article_and_nothing_around_it(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = {r.page_id: r.text for r in html.op4(spark, folder).collect()}
    assert found.keys() == pages.keys()
    for i, text in found.items():
        source = pages[i].html
        article = source[source.index("<article>") :].split("</article>")[0]
        blocks = [b.text for b in html.page_blocks(article)]
        assert text == "\n".join(blocks) and len(text) > 10 and "track(" not in text and "<" not in text


def test_a_passage_on_two_pages_of_different_groups(spark):
    passages = [" ".join(f"p{i}w{j}" for j in range(10)) for i in range(60)]  # each on two pages of the host
    rows = [(i, f"https://big.example/{i}", f"<div>{passages[i % 60]}</div><div>{passages[i % 60]} own{i}</div><article>text {i}</article>") for i in range(120)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for shard_pages in (512, 20):
        found = {r.page_id: r.text for r in html.extract_main(table, shard_pages=shard_pages).collect()}
        assert found == {i: f"own{i}\ntext {i}" for i in range(120)}
