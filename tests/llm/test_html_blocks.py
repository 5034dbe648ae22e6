"""Blocks of pages, the recurrent labeller and the text it extracts."""

from __future__ import annotations

import html
import time

import numpy as np
import pytest
from cases import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from backhaul.llm import html_blocks
from backhaul.llm.html_blocks import Labeller, blocks, extract, features, marks, plain_labels, train
from backhaul.session import ship


def texts(page):
    return [t for _, t, _ in blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        (" \n<p> </p>", []),
        ("no markup", ["no markup"]),
        ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
        ("<p>a <b>b</b>\n\tc<br>d</p>", ["a b c d"]),
        ("x <math><mi>E</mi></math> y <noscript>z</noscript> <object>w</object>", ["x E y z w"]),
        ("<p>a<script>var t='</p>';</script>b<style>p{}</style>c<textarea>d</textarea>", ["abc"]),
        ("<p>a<!-- <p>x</p> -->b<!-->c<!DOCTYPE x>d<?y?>e</ >f", ["abcdef"]),
        ("<p>a<!-- never closed", ["a"]),
        ("<script>never closed", []),
        ("a < b <3 &lt;p&gt; &amp;amp; &copy; &#65;&#x42; &nope;", ["a < b <3 <p> &amp; © AB &nope;"]),
        ("<p title=\"it>two", ["two"]),
        ("<p title='a > b'>c</p>", ["c"]),
        ("<p don't>a</p><p class=\"x'y\">b", ["a", "b"]),
        ("<div class=\"x\" <p>hi</div> there", ["hi", "there"]),
        ("a<p", ["a"]),
        ("</div>a</p>b</section>c", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ],
)
def test_blocks_of_a_page(page, want):
    assert texts(page) == want


def test_paths_and_links():
    page = '<body><div class="Post-body x"><p>a <a href="/">bc</a></p></div><nav id=top>d</nav></body>'
    (first, _, link), (second, _, none) = blocks(page)
    assert first == marks(["body", "div", "post", "body", "x", "p"])
    assert second == marks(["body", "nav", "top"])
    assert link == pytest.approx(2 / 4) and none == 0
    assert plain_labels([first, second]) == [True, False]


def test_structure_that_shows_main_text():
    sure, likely, other = marks(["article", "p"]), marks(["div", "entry", "p"]), marks(["article", "comments"])
    neither = marks(["div", "p"])
    assert plain_labels([neither, likely, sure, other]) == [False, False, True, False]
    assert plain_labels([neither, likely, other]) == [False, True, False]
    assert plain_labels([neither, other]) == [False, False]
    assert plain_labels([neither, other], guess=True) == [True, False]
    assert plain_labels([], guess=True) == []


WORD = st.text("abc <>&\"'é ", min_size=1, max_size=8)
LEAF = st.sampled_from(["p", "h1", "li", "td", "pre"])
TREE = st.recursive(
    st.tuples(LEAF, WORD),
    lambda inner: st.tuples(st.sampled_from(["div", "section", "article", "ul"]), st.lists(inner, max_size=4)),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(TREE)
def test_well_formed_pages_give_back_their_leaves(tree):
    want = []

    def write(node, path):
        tag, inside = node
        name = f"k{len(path)}"
        if isinstance(inside, str):
            if text := " ".join(inside.split()):
                want.append((marks([*path, tag, name]), text))
            inner = html.escape(inside)
        else:
            inner = "".join(write(n, [*path, tag, name]) for n in inside)
        return f"<{tag} class='{name}' title=\"a > b\">{inner}</{tag}>"

    page = write(tree, [])
    assert [(p, t) for p, t, _ in blocks(page)] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "/", "!", "--", "'", '"', "=", "a", "p", "div", " ", "&", "#", "9", "script"]), max_size=40))
def test_any_text_is_a_page(pieces):
    for path, text, link in blocks("".join(pieces)):
        assert text == text.strip() and text and 0 <= link <= 1 and path >= 0


HOSTILE = {
    "open tags": lambda n: "<a " * (n // 3),
    "open quotes": lambda n: "<a x=\"<a y='" * (n // 12),
    "quotes after signs": lambda n: "<a " + '= "' * (n // 3),
    "unmatched ends": lambda n: "<div>" * (n // 16) + "</p>" * (n // 8),
    "deep paths": lambda n: "".join(f'<div class="c{i} d{i}">' for i in range(n // 28)),
    "declarations": lambda n: "<!" * (n // 2),
    "raw ends": lambda n: "<script></script " * (n // 16),
    "self-closed": lambda n: "<svg/>" * (n // 6),
    "numbers": lambda n: "&#" + "9" * n + " &#" + "0" * n + "65;",
    "signs": lambda n: "<" * n,
    "classes": lambda n: "<a " + "class='" * (n // 7) + ">",
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_time_grows_with_the_length_of_a_page(kind):
    # Half a megabyte. In proportion to the square these take minutes to hours.
    start = time.perf_counter()
    blocks(HOSTILE[kind](1 << 19))
    assert time.perf_counter() - start < 15


# --- network ----------------------------------------------------------------------------------


def sample(seed=1):
    draw = np.random.default_rng(seed)
    first = np.array([0, 3, 3, 4, 9])
    x = draw.random((9, html_blocks.PATH + html_blocks.WORDS + html_blocks.NUMBERS))
    return x, first, draw.integers(0, 2, 9).astype(float)


def test_gradient_is_that_of_the_loss():
    x, first, labels = sample()
    net = Labeller.fresh()
    _, slope = net.gradient(x, first, labels)
    draw = np.random.default_rng(3)
    for name, weights in net.weights.items():
        for _ in range(6):
            at = tuple(int(draw.integers(0, n)) for n in weights.shape)
            ends = []
            for step in (1e-5, -1e-5):
                weights[at] += step
                ends.append(net.gradient(x, first, labels)[0])
                weights[at] -= step
            assert slope[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_pages_are_judged_alone_but_whole():
    x, first, _ = sample()
    net = Labeller.fresh()
    together = net.logits(x, first)
    for a, b in zip(first[:-1], first[1:]):
        assert net.logits(x[a:b], np.array([0, b - a])) == pytest.approx(together[a:b])
    changed = x.copy()
    changed[8] += 1
    assert abs(net.logits(changed, first)[4] - together[4]) > 1e-6  # read backwards from the last block
    assert net.logits(changed, first)[:4] == pytest.approx(together[:4])


def test_features_of_blocks():
    x = features([marks(["p"]), 0, marks(["p"])], ["a A b", "", "é"], np.array([0, 0.5, 1]))
    assert x[:, : html_blocks.PATH].sum(1).tolist() == [1, 0, 1]
    assert x[0, html_blocks.PATH : html_blocks.PATH + html_blocks.WORDS].sum() == pytest.approx(1)
    assert x[:, -1].tolist() == [0, 0.5, 1]


# --- pages ------------------------------------------------------------------------------------

ODD_PAGES = [
    (1, None), (2, ""), (3, " \n "), (4, "plain"), (5, "<article><p>one</p></article>"), (5, "<article><p>one</p></article>"),
    (5, "<article><p>another</p></article>"), (None, "<p>no id</p>"), (None, None), (6, "\x00<p>\x01"),
    (7, "<article>" + "<p>long text here</p>" * 20_000 + "</article>"), (8, "<div " * 50_000),
]


def pages(spark, rows):
    ship(spark)
    frame = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
    clash = {"key": "x", "text": 3, "n_chars": "y", "good": False, "path": 1.5}
    return frame.withColumns({name: F.lit(value) for name, value in clash.items()})


def test_odd_pages(spark):
    frame = pages(spark, ODD_PAGES)
    for labeller in (None, train(frame, steps=5)):
        rows = extract(frame, labeller).collect()
        assert sorted(str(r.page_id) for r in rows) == sorted(str(p) for p, _ in ODD_PAGES)
        assert all(r.n_chars == len(r.text) and r.url == "u" for r in rows)
        assert all(not r.text for r in rows if r.page_id in (1, 2, 3, 8))
    plain = {r.page_id: r.text for r in extract(frame, None).where("page_id is not null and page_id <> 5").collect()}
    assert plain[4] == "plain" and plain[7] == "\n".join(["long text here"] * 20_000)


def test_empty_table_and_pages_without_structure(spark):
    assert train(pages(spark, [])) is None
    assert extract(pages(spark, []), None).collect() == []
    bare = pages(spark, [(i, f"<nav>menu</nav><div><p>text {i}</p></div>") for i in range(20)])
    assert train(bare) is None
    assert {r.page_id: r.text for r in extract(bare, None).collect()} == {i: f"text {i}" for i in range(20)}


def test_samples_are_bounded_and_repeated_rows_count_once(spark, monkeypatch):
    seen = []
    parse = html_blocks.blocks
    monkeypatch.setattr(html_blocks, "blocks", lambda page: seen.append(page) or parse(page))
    rows = [(1, f"<article>{i}</article>") for i in range(30)] + [(1, "<article>0</article>")] * 30
    rows += [(2, "<article>" + "x" * html_blocks.LONGEST_PAGE)]
    train(pages(spark, rows), sample=100, steps=1)
    assert sorted(seen) == sorted(f"<article>{i}</article>" for i in range(30))
    seen.clear()
    train(pages(spark, rows), sample=7, steps=1)
    assert len(seen) == 7


def renamed(page, container):
    """The page with its article in another container, and another column before it."""
    page = page.replace("<article>", f'<div class="{container}">').replace("</article>", "</div>")
    return page.replace("<nav>", '<div class="menu">').replace("</nav>", "</div>")


@pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")
def test_held_out_pages(spark):
    """Block errors on pages the labeller has not seen, as they are and in containers it has not seen."""
    ship(spark)
    frame = spark.read.parquet(str(SF_DIR.parent / "sf0.01" / "pages.parquet"))
    learn, rest = frame.where("page_id % 3 <> 0"), frame.where("page_id % 3 = 0")
    net = train(learn)
    wrong = {"as is": [], "renamed": []}
    for page in [r.html for r in rest.collect()]:
        truth = [(t, good) for (_, t, _), good in zip(blocks(page), plain_labels([p for p, _, _ in blocks(page)]))]
        for name, text in (("as is", page), ("renamed", renamed(page, "post-body"))):
            found = blocks(text)
            assert [t for _, t, _ in found] == [t for t, _ in truth]
            x = features([p for p, _, _ in found], [t for _, t, _ in found], np.array([link for _, _, link in found]))
            wrong[name] += ((net.logits(x, np.array([0, len(found)])) > 0) != [g for _, g in truth]).tolist()
    rates = {name: float(np.mean(w)) for name, w in wrong.items()}
    print(rates)
    assert rates["as is"] <= 0.01 and rates["renamed"] <= 0.03
