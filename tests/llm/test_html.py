"""Main text of pages: the host's pages decide, landmarks are further evidence."""

import random
import time
from collections import Counter

from tallframe.llm.html import blocks, extract_text, windows


def texts(spark, pages, **more):
    return {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string"), **more).collect()}


def test_boilerplate_inside_articles_goes_and_text_outside_a_teaser_stays(spark):
    notice = "<p>Please support this site by telling all of your friends about it</p>"
    pages = [(k, f"https://a.org/{k}", f"<article><p>Story {k} has words of its own about topic{k}</p>{notice}</article><p>by author{k}</p>") for k in range(4)]
    body = "The main text of this page stands in plain blocks and is longer than the teaser beside it"
    pages.append((9, "https://b.org/", f"<div>{body}</div><article>Read on</article>"))
    got = texts(spark, pages)
    assert got[2] == "Story 2 has words of its own about topic2" and got[9] == f"{body}\n\nRead on"


def test_groups_of_a_host_know_what_the_host_repeats(spark):
    """In groups of about two pages, what five of forty pages hold goes, as it does in one group; short blocks too."""
    notice = "<p>Please support this site by telling all of your friends about it</p><p>Share this</p>"
    pages = [(k, f"https://a.org/{k}", f"<p>Story {k} has words of its own about topic{k}</p>{notice if k % 8 == 0 else ''}") for k in range(40)]
    got = texts(spark, pages, group=2)
    assert got == texts(spark, pages, group=300) == {k: f"Story {k} has words of its own about topic{k}" for k in range(40)}


def test_a_host_of_a_thousand_pages_against_brute_force(spark):
    """Windows of three words or more that three pages hold go wherever they stand, for groups of any size."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    common = [" ".join(rng.choices(words, k=rng.randint(3, 6))) for _ in range(30)]
    pages, blocks = [], []
    for k in range(1000):
        mine = [" ".join(rng.choices(words, k=12)) for _ in range(2)]
        mine[0] += " " + rng.choice(common)
        blocks.append(mine)
        pages.append((k, "https://a.org/x", "".join(f"<p>{b}</p>" for b in mine)))
    held = Counter(w for mine in blocks for w in {tuple(x[j : j + 3]) for b in mine for x in [b.split()] for j in range(len(x) - 2)})
    wanted = {}
    for k, mine in enumerate(blocks):
        left = []
        for b in mine:
            x = b.split()
            gone = {j + i for j in range(len(x) - 2) if held[tuple(x[j : j + 3])] >= 3 for i in range(3)}
            left.append(" ".join(w for j, w in enumerate(x) if j not in gone))
        wanted[k] = "\n\n".join(b for b in left if b)
    assert any(n >= 3 for n in held.values())
    for group in (30, 400, 4000):
        assert texts(spark, pages, least=3, group=group) == wanted


def test_broken_and_odd_pages(spark):
    """A megabyte of tags that never close, nulls, repeated rows and an empty table."""
    start = time.perf_counter()
    assert blocks("<a " * 350_000)[0] == [" ".join(["<a"] * 350_000)]
    assert time.perf_counter() - start < 5
    assert blocks("<div class=menu>x" + "<article>y" * 20_000)[0][0] == "y"
    for junk in ("<a" * 100_000, "<script" * 100_000, "<iframe>" * 100_000, "<span class=ad>" * 100_000, "<div>" * 3000 + "</p>" * 100_000, "<a \"<a' " * 50_000, "<span class=ad><div>" * 30_000 + "</span>" * 30_000, "<form>" * 2000 + "<article>x</article>" * 20_000):
        start = time.perf_counter()
        blocks(junk)
        assert time.perf_counter() - start < 2, junk[:20]
    got = extract_text(spark.createDataFrame([(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "https://a.org", None), (2, "", "")], "page_id bigint, url string, html string"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


BODY = "The main text of this page has many words that all belong to the story and are read by people"


def test_whole_pages_do_not_vanish():
    """Heads and menus that never close, elements that close themselves, a page in a form, wrappers named after what they hold."""
    for page in (
        f"<html><head><title>t</title><meta charset=utf-8><body><p>{BODY}</p>",
        f"<svg/><iframe src=x /><noscript><p>{BODY}</p>",
        f"<form action=x><nav>Home About</nav><div><p>{BODY}</p></div><footer>c</footer></form>",
        f"<div class='no-sidebar'><p>{BODY}</p></div>",
        f"<div class='content-sidebar-wrap'><article>{BODY}</article><div class=sidebar>s</div></div>",
        f"<div class='layout--sidebar'><p>{BODY}</p></div>",
        f"<div class='sidebar-left'><main>{BODY}</main></div>",
        f"<div class=menu><a href=/>Home</a><div><p>{BODY}</p></div>",
        f"<nav><a href=/>Home</a><main><p>{BODY}</p></main>",
        f"<a title='x>y'></a><a href=\"z\"\"></a><p>{BODY}</p>",
    ):
        assert blocks(page)[0] == [BODY], page


def test_what_is_no_text_of_the_page_goes():
    """Adverts and share links within a line, readers' comments longer than the text, a site's header, teasers beside an article."""
    readers = f"{BODY}. " * 5
    for page in (
        f"<p>The main text of this page has many words <span class='ad'>buy <span>now</span></span> that all belong to the story <a class=share href=x>share</a> and are read by people</p>",
        f"<div class='has-comments'><p>{BODY}<div class=comments><p>{readers}</div></div>",
        f"<article><p>{BODY}</p></article><div class=replies><p>{readers}</div><div id=responses>x</div>",
        f"<article>{BODY}</article><section id=comments><article class=comment-body>{readers}</article></section>",
        f"<div class='site-header'>Site</div><p>{BODY}</p><div id=mainNav>Home</div>",
        f"<aside><article>teaser</article></aside><article>{BODY}</article>",
        f"<table><tr><td class=sidebar>Home<td><p>{BODY}</table><select><option>a</select><video src=x>none</video>",
    ):
        assert blocks(page)[0] == [BODY], page
    assert blocks("<nav>Home About</nav><article></article><footer>f</footer>")[0] == []
    assert blocks("<article><header><h1 id=comments>T</h1></header>a<p hidden>b</p></article>")[0] == ["T", "a"]


def test_windows_against_a_plain_count():
    words = [[str(k % 7) for k in range(n)] for n in (1, 5, 8, 9, 30)]
    found = windows(words, 8)
    assert [len(x) for x in found] == [1, 1, 1, 2, 23]
    same = {}
    for w, x in zip(words, found, strict=True):
        for k, h in enumerate(x.tolist()):
            assert same.setdefault(tuple(w[k : k + 8]), h) == h
    assert len(set(same.values())) == len(same)
