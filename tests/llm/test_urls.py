"""URL rules and character models against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from mercato.llm import urls
from mercato.llm.queries_more import RULES, op11_url_filter

SCHEMA = "page_id long, url string, score string, `__url` string"


def rule(url):
    """(host, path, rule, verdict) by the rules alone."""
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0]))
            and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


class Model:
    """Blended contexts, by recursion over one counter."""

    def __init__(self, known):
        self.n, self.after = Counter(), {}
        for url, times in known.items():
            text = urls.START * urls.ORDER + url + urls.END
            for at in range(urls.ORDER, len(text)):
                for k in range(urls.ORDER + 1):
                    self.n[text[at - k:at], text[at]] += times
        for (context, c), n in self.n.items():
            self.after.setdefault(context, Counter())[c] += n

    def p(self, context, c):
        shorter = self.p(context[1:], c) if context else 1 / urls.ALPHABET
        seen = self.after.get(context)
        if not seen:
            return shorter
        return (seen[c] + len(seen) * shorter) / (sum(seen.values()) + len(seen))


def out(url):
    return hashlib.md5(url.encode()).hexdigest()[:2] < "33"


def brute(rows):
    """page -> (host, path, rule, score or None, verdict)."""
    known = {"allow": Counter(), "block": Counter()}
    for _, url in rows:
        said = rule(url)[3]
        if said:
            known[said][url] += 1
    models = {v: Model({u: n for u, n in known[v].items() if not out(u)}) for v in known}

    def score(url):
        text, total = urls.START * urls.ORDER + url + urls.END, 0
        for at in range(urls.ORDER, len(text)):
            a, r = (models[v].p(text[at - urls.ORDER:at], text[at]) for v in ("allow", "block"))
            ratio = (math.log(a) - math.log(r)) * urls.SCALE
            total += int(math.copysign(math.floor(abs(ratio) + .5), ratio))
        return math.floor(total / (len(url) + 1))

    steps = {}
    for v in known:
        for u, n in known[v].items():
            if out(u):
                steps.setdefault(score(u) // urls.STEP, Counter())[v] += n
    all_of = {v: sum(s[v] for s in steps.values()) for v in known}
    bar = 0
    if min(all_of.values()) > 0:
        def gain(step):
            up = {v: sum(s[v] for at, s in steps.items() if at >= step) for v in known}
            return up["allow"] * all_of["block"] - up["block"] * all_of["allow"]
        best = min(steps, key=lambda step: (-gain(step), step))
        lower = max((s for s in steps if s < best), default=best - 1)
        bar = (best + lower + 1) * urls.STEP // 2
    result = []
    for page, url in rows:
        host, path, by, said = rule(url)
        value = None if said else score(url or "")
        result.append((page, host, path, by, value, said or ("allow" if value >= bar else "block")))
    return bar, sorted(result, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    hosts = ["a.example.org", "b.org", "Shop.Example.COM", "m.news.com", "x.net", "blog.net",
             "casino-win.net", "example.org", "org", "borg", "user@h.com:80"]
    made = [f"http{r.choice(['', 's'])}://{r.choice(hosts)}/{r.choice(['en', 'fr', 'de', 'es', 'EN'])}"
            f"/{r.randint(1, 400)}{r.choice(['', '/', '#top', '?page=2', '.html'])}"
            for _ in range(700)]
    odd = [None, "", "no scheme", "://", "http://", "http://org", "http://ORG/", "x://y.com/fr/é日",
           "ftp://a.org?q=/", "http://e.com/de/://org/", "http://é.net/\n\u2028z", "a" * 1500,
           "https://n.net/" + "ab/" * 900, made[0], made[0], made[0]]
    return list(enumerate(made + odd)) + [(None, made[1]), (3, "http://twice.net/")]


def test_all_urls(spark, rows):
    """Scores, threshold and verdicts, with clashing column names and both
    ways to join the gram table."""
    df = spark.createDataFrame([(i, u, "kept", None) for i, u in rows], SCHEMA)
    bar, expected = brute(rows)
    for limit in (urls.BROADCAST_GRAMS, 0):
        before, urls.BROADCAST_GRAMS = urls.BROADCAST_GRAMS, limit
        try:
            got = urls.filtered(df, RULES).collect()
        finally:
            urls.BROADCAST_GRAMS = before
        assert {r["score"] for r in got} == {"kept"}
        assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["_score"], r["verdict"])
                       for r in got), key=str) == expected
        assert {r["threshold"] for r in got if r["_score"] is not None} == {bar}


def test_query_and_empty_tables(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(i, u, "<p>") for i, u in rows], "page_id long, url string, html string"
                          ).write.parquet(path + "/pages.parquet")
    got = sorted((tuple(r) for r in op11_url_filter(spark, path).collect()), key=str)
    assert got == sorted(((*r[:4], r[5]) for r in brute(rows)[1]), key=str)
    none = spark.createDataFrame([], "url string")
    assert urls.filtered(none, RULES).collect() == []
    alone = urls.filtered(spark.createDataFrame([("http://a.net/",)], "url string"), RULES)
    assert [(r["score"], r["threshold"], r["verdict"]) for r in alone.collect()] == [(0, 0, "allow")]


def test_models_tell_urls_apart(spark):
    """URLs that no rule fits are judged like the known ones they resemble."""
    known = [f"http://good.org/articles/{i}" for i in range(60)]
    known += [f"http://bad.com/de/casino-{i}" for i in range(60)]
    asked = ["http://new.net/articles/7", "http://new.net/casino-7"]
    df = spark.createDataFrame([(u,) for u in known + asked], "url string")
    said = {r["url"]: r["verdict"] for r in urls.filtered(df, RULES).collect()}
    assert said[asked[0]] == "allow" and said[asked[1]] == "block"
