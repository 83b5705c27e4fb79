"""Consensus host paths: votes that decide in bulk, boilerplate by repetition, deep nesting, empty tables."""

import random
import tracemalloc
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import html


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def talk_pages(seed=1, hosts=6, pages=40):
    """No article elements: a story in a div, and on a third of the pages a longer div of varied text beside it."""
    rng = random.Random(seed)
    out = []
    for k in range(hosts):
        for i in range(pages):
            story = words(rng, rng.randint(60, 120))
            rail = words(rng, rng.randint(200, 300) if rng.random() < 0.33 else rng.randint(5, 40))
            out.append((len(out), f"http://h{k}.io/{i}", f"<div class='k{k} c-{i}'><h1>T{i}</h1><p>{story}</p></div><div class='other'><p>{rail}</p></div>", f"T{i}\n{story}"))
    return out


def frame(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")


def test_votes_decide_in_bulk(spark):
    """Pages whose own best container is wrong are put right by their host's votes; the winners are those of a plain count."""
    rows = talk_pages()
    wrong = [r[0] for r in rows if html.extract(r[2]) != r[3]]
    assert len(wrong) > 50
    got = {r.page_id: r.text for r in html.main_text(frame(spark, rows)).collect()}
    assert got == {r[0]: r[3] for r in rows}

    tally = defaultdict(Counter)
    for _, url, page, _ in rows:
        for p, v in html.votes(page)[2].items():
            tally[url.split("/")[2]][p] += v.share
    h = F.lit(0).cast("long").alias("h")
    ballots = html._ballots(frame(spark, rows).select("page_id", h, F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "html"))
    winners = {r.host: r.winner for r in html.host_paths(ballots).collect()}
    assert winners == {host: min(t, key=lambda p: (-round(t[p], 9), p)) for host, t in tally.items()}


def test_boilerplate_is_what_repeats(spark):
    """The longest container is the same on all pages: it gets no vote, and inside the article it is left out."""
    rng = random.Random(2)
    same = words(rng, 300)
    rows = []
    for i in range(30):
        story = words(rng, 60)
        rows.append((i, f"http://a.io/{i}", f"<div class='info'><p>{same}</p></div><div class='text'><p>{story}</p></div>", story))
        rows.append((100 + i, f"http://b.io/{i}", f"<article><p>{story}</p><div class='legal'><p>{same}</p></div><p>end {i}</p></article>", f"{story}\nend {i}"))
    got = {r.page_id: r.text for r in html.main_text(frame(spark, rows)).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_copies_are_no_boilerplate(spark):
    """A host all of whose pages are the same page, and few different ones: their text stays."""
    page = "<article><p>one text for all</p><div class='x'><p>and more of it</p></div></article>"
    rows = [(i, f"http://c.io/{i}", page) for i in range(40)] + [(100 + i, f"http://d.io/{i}", page.replace("one", f"one {i % 3}")) for i in range(40)]
    got = html.main_text(frame(spark, rows)).collect()
    assert all(r.text.endswith("text for all\nand more of it") for r in got)


def test_comments_have_no_votes(spark):
    """Reader comments longer than the article, on every page."""
    rng = random.Random(3)
    rows = [(i, f"http://e.io/{i}", f"<div class='post'><p>{(story := words(rng, 50))}</p></div><div id='comments'><article><p>{words(rng, 200)}</p></article></div>", story) for i in range(20)]
    got = {r.page_id: r.text for r in html.main_text(frame(spark, rows)).collect()}
    assert got == {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "text", "<b>" * 50_000 + "text", "".join(f"<div>text {i}" for i in range(10_000)), "<p></p>" * 20_000 + "<span>" * 20_000 + "</p>" * 20_000])
def test_deep_nesting(page):
    tracemalloc.start()
    html.extract(page)
    html.votes(page)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html.main_text(none).collect() == []
    rows = [(None, None, None), (1, "http://x.io", ""), (1, "http://x.io", ""), (2, "no host", "<p>t"), (3, "http://x.io", "<script>x")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "t", 1), (3, "", 0)]


def test_main_and_sections():
    page = "<main><h1>H</h1><section><p>{}</p></section><section><p>b</p></section></main><section><p>c</p></section>".format("a " * 50)
    assert html.extract(page) == "H\n" + " ".join(["a"] * 50) + "\nb"
    nested = "<main><div><p>{}</p></div><article><p>{}</p></article></main>".format("menu " * 2, "x y z " * 9)
    assert html.extract(nested) == " ".join(["x y z"] * 9)
