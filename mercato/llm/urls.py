"""URL filters: rules by host and path, and for URLs that no rule fits the
ratio of two character language models.

*Rules* are (host, path, verdict).  A rule fits its host and all subdomains
if the URL's path starts with the rule's path; the longest fitting rule wins.

*Models.*  Two variable-order Markov models over characters, of accepted and
of rejected URLs, give each character a probability from up to ``ORDER``
characters before it.  A context of any length counts if the model has seen
it; the distributions of the longer and the shorter context are blended by
Witten and Bell's estimate (weight of the shorter: the number of different
characters seen after the context), down to one even share for each of
``ALPHABET`` characters, so that nothing has probability zero.  Grams are
counted over all accepted and rejected URLs but the held-out ones.

*Score.*  The logarithm of the ratio of both probabilities, summed over the
URL's characters (an end mark included) and divided by their number.  Log
ratios and scores are whole millionths, so sums don't depend on their order.

*Calibration.*  The threshold is where, on the held-out fifth of the known
URLs (by md5), the share of accepted URLs at or above it least the share of
rejected ones is greatest (the lowest such place, in thousandths), half way
down to the next lower score.  Without held-out URLs of both kinds it is zero.

Everything is DataFrame functions.  Repeated URLs are scored once.  The gram
table is joined by broadcast up to ``BROADCAST_GRAMS`` rows, beyond by a
salted shuffle join, since some grams are in every URL.

Null and empty URLs have an empty host and path, fit no rule and are judged
by the end mark alone.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.text import ASCII_UPPER, free_name, whole, written
from mercato.operators._util import salted_join

ORDER = 4                        # characters before, at most
ALPHABET = 256                   # characters that share the least probability
BROADCAST_GRAMS = 500_000        # rows of the gram table that may be broadcast
SCALE = 1_000_000                # log ratios and scores are in millionths
STEP = 1000                      # thresholds are tried a thousandth apart
START, END = "\u0002", "\u0003"  # marks before and after a URL
CHUNK = 512                      # characters of a URL that are cut up at once

Rule = tuple[str, str, str]      # host, path, verdict


# ------------------------------------------------------------------- rules

def _rest(url: str) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", whole(url))
    return F.when(at > 0, F.substring(whole(url), at + 3, F.length(whole(url)))).otherwise("")


def host_of(url: str) -> Column:
    """The host, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), ASCII_UPPER,
                       ASCII_UPPER.lower())


def path_of(url: str) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest of ``rules`` that fits, or null.  The
    rules are few; of equally long ones the first wins."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = (((F.col(host) == rule_host) | F.endswith(F.col(host), F.lit("." + rule_host)))
                & F.startswith(F.col(path), F.lit(rule_path)))
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"),
                                       F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


# ------------------------------------------------------------------ models

def held_out(url: str) -> Column:
    return F.substring(F.md5(F.col(url).cast("binary")), 1, 2) < "33"


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """(*keep, gram) of the distinct texts ``url``: each character and the
    end mark, with the ORDER characters before it."""
    padded = F.concat(F.lit(START * ORDER), "url", F.lit(END))
    chunks = (urls.select(*keep, padded.alias("padded"), F.explode(
        F.sequence(F.lit(1), F.length("url") + 1, F.lit(CHUNK))).alias("from"))
              .select(*keep, F.expr(f"substring(padded, from, {CHUNK + ORDER})").alias("part")))
    return (chunks.select(*keep, "part", F.explode(
        F.sequence(F.lit(1), F.length("part") - ORDER)).alias("at"))
            .select(*keep, F.expr(f"substring(part, at, {ORDER + 1})").alias("gram")))


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, a, r): how often a gram is in accepted and in rejected URLs
    that are learnt from; grams of the others have zeros.  ``urls`` is (url,
    accepted, rejected) with the number of times a URL is known as either."""
    learnt = ~F.col("out")
    return (grams(urls.withColumn("out", held_out("url")), "accepted", "rejected", "out")
            .groupBy("gram").agg(F.sum(F.when(learnt, F.col("accepted")).otherwise(0)).alias("a"),
                                 F.sum(F.when(learnt, F.col("rejected")).otherwise(0)).alias("r")))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log of accepted over rejected probability of a gram's
    last character after the rest, in millionths."""
    counts = written(counts)
    even = F.lit(1.0 / ALPHABET)
    below = None
    for order in range(ORDER + 1):
        seen = (counts.groupBy(F.expr(f"right(gram, {order + 1})").alias("gram"))
                .agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
        seen = seen.withColumn("context", F.expr(f"left(gram, {order})"))
        after = seen.groupBy("context").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"),
            F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
        level = salted_join(seen, after, ["context"])
        if below is None:
            level = level.withColumns({"pa": even, "pr": even})
        else:
            level = salted_join(level.withColumn("shorter", F.expr(f"right(gram, {order})")),
                                below.withColumnRenamed("gram", "shorter"), ["shorter"])

        def blended(n: str, total: str, kinds: str, p: str) -> Column:
            return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(p))
                          / (F.col(total) + F.col(kinds))).otherwise(F.col(p))

        below = level.select("gram", blended("a", "na", "ta", "pa").alias("pa"),
                             blended("r", "nr", "tr", "pr").alias("pr"))
    ratio = F.round((F.ln("pa") - F.ln("pr")) * SCALE).cast("long")
    return below.select("gram", ratio.alias("ratio"))


def scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(url, score) of the distinct texts of ``urls``, in millionths."""
    ratios = written(ratios)
    rows = grams(urls.select("url"), "url")
    if ratios.count() <= BROADCAST_GRAMS:
        joined = rows.join(F.broadcast(ratios), "gram")
    else:
        joined = salted_join(rows, ratios, ["gram"], buckets=64)
    return (joined.groupBy("url").agg(F.sum("ratio").alias("sum"))
            .select("url", F.floor(F.col("sum") / (F.length("url") + 1)).alias("score")))


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``threshold`` from (url, score, accepted, rejected)."""
    steps = (scored.where(held_out("url") & (F.col("accepted") + F.col("rejected") > 0))
             .groupBy(F.floor(F.col("score") / STEP).alias("step"))
             .agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")))
    # log ratios are bounded by the counts, so the steps are some thousands
    up = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()

    def total(n: str, over) -> Column:
        return F.sum(n).over(over).cast("decimal(19,0)")

    lower = F.lag("step").over(Window.orderBy("step"))
    middle = F.floor((F.col("step") + F.coalesce(lower + 1, F.col("step"))) * (STEP // 2))
    gains = steps.select(
        "step", middle.alias("middle"), (total("a", up) * total("r", every) - total("r", up) * total("a", every))
        .alias("gain"),
        (F.least(total("a", every), total("r", every)) > 0).alias("both"))
    best = gains.where("both").agg(F.min(F.struct((-F.col("gain")).alias("minus"), "step",
                                                  "middle")).alias("best"))
    return best.select(F.coalesce("best.middle", F.lit(0)).alias("threshold"))


def judged(urls: DataFrame) -> DataFrame:
    """(url, score, threshold, likely) of the unknown and the held-out of
    (url, accepted, rejected), distinct non-null texts with the times each is
    known as either: ``likely`` says that the score reaches the threshold."""
    asked = urls.where(held_out("url") | (F.col("accepted") + F.col("rejected") == 0))
    scored = written(scores(asked, log_ratios(gram_counts(urls))).join(asked, "url"))
    return (scored.crossJoin(F.broadcast(threshold(scored)))       # one row
            .select("url", "score", "threshold",
                    (F.col("score") >= F.col("threshold")).alias("likely")))


def filtered(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with the new columns host, path, rule, score (null where a
    rule decides), threshold and verdict.  The URLs that rules allow and
    block teach the models."""
    host, path, rule, verdict, score, bar, text, known = (
        free_name(pages, c) for c in ("host", "path", "rule", "verdict", "score", "threshold",
                                      "__url", "__known"))
    ruled = (pages.withColumns({host: host_of(url), path: path_of(url), text: whole(url)})
             .withColumn(known, rule_of(host, path, rules)))
    said = F.coalesce(F.col(known)["verdict"], F.lit(""))
    urls = written(ruled.groupBy(F.col(text).alias("url")).agg(
        F.count_if(said == "allow").alias("accepted"), F.count_if(said == "block").alias("rejected")))
    found = judged(urls).select(F.col("url").alias(text), F.col("score").alias(score),
                                F.col("threshold").alias(bar), "likely")
    by_rule = F.col(known).isNotNull()
    return (salted_join(ruled, found, [text], how="left")
            .withColumns({rule: F.col(known)["rule"],
                          score: F.when(~by_rule, F.col(score)),
                          verdict: F.when(by_rule, F.col(known)["verdict"])
                          .when(F.col("likely"), "allow").otherwise("block")})
            .select(*pages.columns, host, path, rule, score, bar, verdict))
