"""Templates by classes: constant texts, furniture by any tag, all articles,
and the classes against gathered vectors."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mercato.llm import extraction as ex

PAGES = "page_id long, url string, html string"


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], PAGES)
    return [r["text"].split("\n\n") for r in ex.extracted(df).orderBy("page_id").collect()]


def many(body, n=12):
    return [f"<html><body><nav>menu</nav>{body.format(i=i)}<footer>f</footer></body></html>"
            for i in range(n)]


def test_main_with_a_teaser_article(spark):
    got = texts(spark, many("<main><p>body {i} one</p><p>body {i} two</p>"
                            "<article class=card>teaser {i}</article></main>"))
    assert got[3] == ["body 3 one", "body 3 two", "teaser 3"]


def test_all_articles_of_a_page(spark):
    got = texts(spark, many("<article class=first><p>a {i}</p></article><div>between {i}</div>"
                            "<article class=second><p>b {i}</p></article>"))
    assert got[5] == ["a 5", "b 5"]


@pytest.mark.parametrize("outer", ["article", "div class=post"])
def test_long_comments_go(spark, outer):
    name = outer.split()[0]
    comments = "".join(f"<p>a long comment {{i}} {j} of many more words than the post</p>"
                       for j in range(9))
    got = texts(spark, many(f"<{outer}><p>post {{i}}</p><section class=comments>{comments}</section>"
                            f"</{name}>"))
    assert got[2] == ["post 2"]


@pytest.mark.parametrize("notice", [
    "<p class=notice>old {i}", "<ul><li class='ad'>buy {i}<li>kept {i}</ul>",
    "<p>kept {i} <span class=comment>no <span>way</span> {i}</span></p>",
    "<div class='share-box'>tweet {i}</div>", "<p class='newsletter'>join {i}</p>"])
def test_furniture_by_any_tag(spark, notice):
    got = texts(spark, many(f"<article><p>first {{i}}</p>{notice}<p>last {{i}}</p></article>"))
    expected = ["first 4", "kept 4", "last 4"] if "kept" in notice else ["first 4", "last 4"]
    assert got[4] == expected


def test_constant_texts_of_a_host_go(spark):
    """Whatever their tag or class is called, and in the main slot as well;
    a text of some pages only stays."""
    pages = many("<div class=xyz>Win a prize now</div><div><p>text {i}</p><p>sometimes</p>"
                 "<p class=q>All rights <b>kept</b></p></div>")
    pages[7] = pages[7].replace("<p>sometimes</p>", "")
    got = texts(spark, pages)
    assert got[1] == ["text 1", "sometimes"] and got[7] == ["text 7"]


def test_copies_of_one_page_keep_their_text(spark):
    page = "<html><body><article><p>the only text</p></article></body></html>"
    assert texts(spark, [page] * 9) == [["the only text"]] * 9
    assert texts(spark, [page]) == [["the only text"]]


def _gathered(pages):
    """host -> {(kind, token): vector} with the vectors in full."""
    vectors = defaultdict(lambda: defaultdict(dict))
    for host, html in pages:
        for t in ex.page_tokens(html):
            vectors[host][t["kind"], t["token"]][html] = t["n"]
    return vectors


def test_classes_are_those_of_gathered_vectors(spark):
    r = random.Random(11)
    pages = []
    for host in ("a", "b"):
        for i in range(9):
            extra = "".join(f"<div class={r.choice('xyz')}><p>{r.choice('uvw')}</p></div>"
                            for _ in range(r.randint(0, 4)))
            pages.append((host, f"<html><body><p>{host}</p><article><p>{i}</p>{extra}</article>"
                          f"<p>same</p></body></html>"))
    df = spark.createDataFrame(pages, "host string, html string")
    found = defaultdict(lambda: defaultdict(set))
    constant = defaultdict(set)
    for row in ex.token_classes(df).where(F.col("host").isNotNull()).collect():
        key = (row["kind"], row["token"])
        found[row["host"]][row["pages"], row["n"], row["vector"]].add(key)
        if row["constant"]:
            constant[row["host"]].add(key)
    for host, vectors in _gathered(pages).items():
        groups = defaultdict(set)
        for key, vector in vectors.items():
            if len(vector) >= ex.SPAN * 9:
                groups[tuple(sorted(vector.items()))].add(key)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found[host].values()))
        assert constant[host] == {key for key, vector in vectors.items()
                                  if len(vector) == 9 and len(set(vector.values())) == 1}


def _seconds(html):
    best = 9.0
    for _ in range(3):
        start = time.process_time()
        ex.main_text(html)
        best = min(best, time.process_time() - start)
    return best


def test_long_pages_take_linear_time():
    for unit in ("<script>x</script><p>a</p>", "<div>", "</span>x", "<p class=ad>"):
        short, long = _seconds(unit * 1000), _seconds(unit * 8000)
        assert long < 8 * short * 3 + 0.05, unit
    words = Counter(ex.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>").split())
    assert words["word"] == 40_000
