"""What the licence scan shuffles."""

from __future__ import annotations

from mercato.llm import licences


def test_licence_scan_makes_no_texts_distinct(spark, monkeypatch):
    text = "x = 1\nReleased under the MIT License.\ny = 2"
    files = spark.createDataFrame(
        [("a/LICENSE", text), ("a/LICENSE", text), ("a/b.c", "int x;"), (None, text), (None, None)],
        "path string, text string")
    seen = []
    plain = licences.matched

    def matched(units, *rest):
        seen.append(units._jdf.queryExecution().executedPlan().toString())
        return plain(units, *rest)

    monkeypatch.setattr(licences, "matched", matched)
    got = licences.scanned(files).collect()
    assert "Exchange" not in seen[0]
    one = [r for r in got if r["path"] == "a/LICENSE"]
    assert len(got) == 5 and len(one) == 2 and one[0] == one[1]
    assert (one[0]["licence"], one[0]["cosine"], one[0]["found"]) == ("MIT", 1.0, "statement")
    assert [r["found"] for r in got if r["path"] == "a/b.c"] == ["inherited"]
