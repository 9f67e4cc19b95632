"""Wrappers of hosts whose pages differ in layout, and pages whose class names sound like furniture."""

from __future__ import annotations

import pytest

from meshledger.llm.extract import extract


def texts(spark, pages: dict) -> dict:
    rows = [(i, f"https://host.example/{i}", html) for i, html in pages.items()]
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def body(i: int) -> str:
    return "".join(f"<p>part {k} of page {i}</p>" for k in range(1 + i % 4))


@pytest.mark.parametrize("first", ["", "<div><h2>Home</h2><p>Welcome to all of it</p></div>", "<main><p>other layout</p></main>"])
def test_first_page_is_no_reference(spark, first):
    """The smallest page is empty or has another layout; a notice stands after a varying number of paragraphs."""
    notice = "<p>Sign up now for our weekly letter</p>"
    pages = {i: f"<article><h1>Title {i}</h1><p>Rights</p>{body(i)}{notice if i % 5 else ''}</article>" for i in range(1, 13)}
    got = texts(spark, {0: first, **pages})
    assert all(got[i] == "\n".join([f"Title {i}", *(f"part {k} of page {i}" for k in range(1 + i % 4))]) for i in pages)
    assert got[0] == {"": "", "<d": "Home\nWelcome to all of it", "<m": "other layout"}[first[:2]]


def test_only_the_constant_text_goes(spark):
    """A place that is constant on most pages keeps what varies on the others; short repeats elsewhere stay."""
    def cells(i):
        return [f"x{i}{k}" for k in range(i % 4)] + ["yes"] + [f"z{i}{k}" for k in range(i % 5)]

    pages = {i: f"<article><p>{'Same line here today' if i % 4 else f'own line of {i}'}</p>{body(i)}"
                f"<ul>{''.join(f'<li>{c}</li>' for c in cells(i))}</ul></article>" for i in range(12)}
    got = texts(spark, pages)
    for i in pages:
        own = [] if i % 4 else [f"own line of {i}"]
        assert got[i] == "\n".join([*own, *(f"part {k} of page {i}" for k in range(1 + i % 4)), *cells(i)])


@pytest.mark.parametrize("wrapper", ["has-sidebar", "content-sidebar-wrap", "menu-open", "header-fixed", "sidebar", "menu"])
def test_names_never_drop_an_article(spark, wrapper):
    pages = {i: f"<nav><p>home {i}</p></nav><div class='{wrapper}'><form><article><h1>T{i}</h1>{body(i)}</article></form></div>"
             for i in range(6)}
    pages[6] = f"<aside><article>{body(6)}</article></aside>"
    pages[7] = f"<main class='{wrapper}'>{body(7)}</main><aside><article>teaser</article></aside>"
    got = texts(spark, pages)
    for i in pages:
        parts = [f"part {k} of page {i}" for k in range(1 + i % 4)]
        assert got[i] == "\n".join(([f"T{i}"] if i < 6 else []) + parts)


def test_names_inside_an_article_only_vote(spark):
    """Names with other words in them are content; furniture words alone count if most pages have them."""
    pages = {i: f"<article>{body(i)}<section id='social-history'><p>history {i}</p></section>"
                f"<div class='search-results'>result {i}</div>{f'<p class=legal>law {i}</p>' if i < 2 else ''}"
                f"<div class='share-widget'><p>share {i}</p></div></article>" for i in range(8)}
    got = texts(spark, pages)
    for i in pages:
        assert got[i] == "\n".join([*(f"part {k} of page {i}" for k in range(1 + i % 4)), f"history {i}", f"result {i}",
                                    *([f"law {i}"] if i < 2 else [])])


def test_all_articles_are_kept(spark):
    got = texts(spark, {1: "<article></article><article><h1>A</h1><p>one</p></article><p>between</p><div><article><p>two</p></article></div>"})
    assert got == {1: "A\none\ntwo"}


def test_named_boxes_go_on_every_page(spark):
    """Adverts, cookie notices, comments and related boxes stand on some pages by nature, and on hosts of one page."""
    boxes = ["<div class='ad'>Buy now</div>", "<div class='cookie-notice'><p>We use cookies</p></div>",
             "<section id='comments'><h3>Comments</h3><p>reader says</p></section>", "<div class='related'><a href='x'>More</a></div>",
             "<article class='comment'><p>first</p></article>", "<div class='advertBox sponsored'><p>also content</p></div>"]
    alone = extract(spark.createDataFrame([(i, f"https://h{i}.example/", f"<body>{box}<div><p>Main text here</p></div></body>")
                                           for i, box in enumerate(boxes)], "page_id long, url string, html string"))
    assert {r.text for r in alone.collect()} == {"Main text here"}
    pages = {i: f"<article><h1>T{i}</h1>{body(i)}{boxes[i % 6] if i % 5 < 2 else ''}</article>{boxes[(i + 1) % 6]}" for i in range(20)}
    got = texts(spark, pages)
    assert got == {i: "\n".join([f"T{i}", *(f"part {k} of page {i}" for k in range(1 + i % 4))]) for i in pages}


def test_pages_go_to_python_few_at_a_time(spark, monkeypatch):
    from meshledger.llm import extract as operator

    def few(function):
        def run(frames):
            for frame in frames:
                assert len(frame) <= 1_000, f"{len(frame)} whole pages at once"
                yield from function(iter([frame]))
        return run

    for name in ("_counted", "_main_text"):
        monkeypatch.setattr(operator, name, few(getattr(operator, name)))
    rows = [(i, f"https://h.example/{i}", f"<html><body><article><p>text {i}</p></article></body></html>") for i in range(3_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in operator.extract(pages).collect()}
    assert got == {i: f"text {i}" for i in range(3_000)}
