"""Pages without an article or main tag lose no part of their text."""

from __future__ import annotations

import pytest

from mercato.llm import extraction


@pytest.mark.parametrize("inner", [("ul", "li"), ("table", "td"), ("blockquote", "p"),
                                   ("section", "p")])
def test_a_long_inner_container_is_not_the_whole_article(spark, inner):
    outer, part = inner
    rows = []
    for i in range(6):
        long = "".join(f"<{part}>long part {i} {j} of many words</{part}>" for j in range(6))
        rows.append((i, f"http://d.example/{i}", f"<html><body><nav>menu</nav><div id=content>"
                     f"<p>first {i} words</p><{outer}>{long}</{outer}><section><p>last {i}</p>"
                     "</section></div></body></html>"))
    rows.append((9, "http://lone.example/", rows[0][2]))
    got = extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for x in got.collect():
        i = x.page_id % 9
        assert x.text.split("\n\n") == [f"first {i} words", *(
            f"long part {i} {j} of many words" for j in range(6)), f"last {i}"]
