"""Benchmark items in documents: SimHash of item-sized windows.

A window has as many words as the item it may hold.  Only windows that
share a shingle with some item can be similar to any, so those alone are
fingerprinted: each shingle of a document that an item also has places one
window, where the item would start (moved inside the text at its ends; a
shorter text is one window).  A fingerprint has 64 bits, the majority over
the window's words, each as often as it occurs.

Candidates come from a multi-index: a fingerprint falls into four blocks of
16 bits, and two that differ in at most ``RADIUS`` bits differ in at most
``RADIUS // 4`` bits of some block.  Items are entered under every block
value that near, so a window looks up its own four values and meets every
item of its size within the radius.  Candidates are confirmed by the exact
similarity of their five-word shingles, each weighted by how often it
occurs: sum of the lesser over sum of the greater weights, 0.8 or more.

Words are runs of letters and digits in lower case.  An item of fewer than
five words is one shingle.  Items and documents without words (null, empty)
match nothing.  Repeated rows count once; rows without a doc_id give
findings without one.

Items are broadcast in blocks of at most ``BLOCK_ROWS`` shingles; a longer
benchmark takes one pass over the documents for each block.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.text import plain_words, whole
from mercato.operators._util import salted_join
from mercato.session import materialize

WORDS = 5
PERCENT = 80
RADIUS = 19
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
BLOCK_ROWS = 1_000_000


def _grams(words: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, in text order."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)),
                       lambda i: F.xxhash64(*[F.element_at(words, (i + j).cast("int"))
                                              for j in range(k)]))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def _grams_of(words: Column, k: Column) -> Column:
    """The same with a column ``k`` between 1 and ``WORDS``."""
    return reduce(lambda rest, j: F.when(k == j, _grams(words, j)).otherwise(rest),
                  range(1, WORDS), _grams(words, WORDS))


def simhash(words: Column) -> Column:
    """64 bits, each set where most of the words' hashes have it set."""
    ones = F.aggregate(
        words, F.array_repeat(F.lit(0), 64),
        lambda counts, w: F.transform(
            counts, lambda n, bit: n + F.getbit(F.xxhash64(w), bit).cast("int")))
    return F.aggregate(
        F.transform(ones, lambda n: 2 * n > F.size(words)), F.lit(0).cast("long"),
        lambda bits, most: F.shiftleft(bits, 1).bitwiseOR(most.cast("long")))


def _block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, i * BLOCK_BITS).bitwiseAND(
        F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")


def _blocks(fingerprint: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(fingerprint, i).alias("value"))
                     for i in range(BLOCKS)])


def _near_masks() -> list[int]:
    """Every set of at most ``RADIUS // BLOCKS`` bits of a block."""
    return [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1)
            for bits in combinations(range(BLOCK_BITS), n)]


def _counted(grams: str) -> Column:
    """A sorted bag as a set: the hash of each gram with the number of its
    occurrence."""
    return F.transform(F.col(grams), lambda g, i: F.xxhash64(
        g, (i - F.array_position(F.col(grams), g)).cast("long")))


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words, n_words, k) of the items that have words."""
    words = benchmark.select(F.col(item_id).alias("item_id"),
                             plain_words(whole(text)).alias("words"))
    return (words.withColumn("n_words", F.size("words")).where("n_words > 0")
            .withColumn("k", F.least(F.lit(WORDS), F.col("n_words"))).distinct())


def _windows(docs: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(doc_id, start, n_words, window): the item-sized windows of the texts
    that a ``k``-word shingle places."""
    n = F.size("words")
    hits = (docs.select("doc_id", "words", F.posexplode(_grams(F.col("words"), k))
                        .alias("pos", "gram"))
            .join(F.broadcast(places.where(F.col("k") == k).drop("k")), "gram"))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("item_pos"), n - F.col("n_words")))
    return hits.select("doc_id", start.alias("start"), "n_words",
                       F.concat_ws(" ", F.slice("words", start + 1, F.col("n_words")))
                       .alias("window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                 text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, word_start, item_words): the best window
    of each document for each item it holds."""
    spark = docs.sparkSession
    items = materialize(items_of(benchmark, item_id, item_text))
    grams = items.select("item_id", "n_words", "k", F.posexplode(_grams_of(F.col("words"), F.col("k")))
                         .alias("item_pos", "gram"))
    # the first place of a shingle in an item aligns the window with it
    places = materialize(grams.groupBy("item_id", "n_words", "k", "gram")
                         .agg(F.min("item_pos").alias("item_pos")).drop("item_id").distinct())
    blocks = max(1, -(-places.count() // BLOCK_ROWS))
    sizes = [r.k for r in places.select("k").distinct().collect()]      # 1 to 5 at most
    words = docs.select(F.col(doc_id).alias("doc_id"), plain_words(whole(text)).alias("words"))
    parts = [_windows(words, places.where(F.pmod(F.hash("gram"), F.lit(blocks)) == block), k)
             for block in range(blocks) for k in sizes]
    none = spark.createDataFrame([], words.select("doc_id", F.lit(0).alias("start"),
                                                  F.lit(0).alias("n_words"),
                                                  F.lit("").alias("window")).schema)
    windows = materialize(reduce(DataFrame.union, parts, none).distinct())

    texts = (windows.select("window", "n_words").distinct()
             .withColumn("words", F.split("window", " ")))
    probes = texts.withColumn("f", simhash(F.col("words"))).select(
        "window", "n_words", "f", F.explode(_blocks(F.col("f"))).alias("b"))
    # the words of an item are joined to its candidates, not kept in each entry;
    # the entries are 10,068 an item, so they are dealt out and never broadcast
    entries = (items.withColumn("g", simhash(F.col("words")))
               .select("item_id", "n_words", "g", F.explode(_blocks(F.col("g"))).alias("b"))
               .withColumn("mask", F.explode(F.array(*map(F.lit, _near_masks()))))
               .select("item_id", "n_words", "g", F.col("b.block").alias("block"),
                       F.col("b.value").bitwiseXOR(F.col("mask")).alias("value")))
    close = (probes.select("window", "n_words", "f", "b.block", "b.value")
             .join(entries.hint("merge"), ["n_words", "block", "value"])
             .where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS)
             .select("window", "n_words", "item_id", "g").distinct())
    own = (items.withColumn("g", simhash(F.col("words")))
           .select("item_id", "n_words", "g", "k", F.col("words").alias("item")))
    near = (salted_join(close, own, ["item_id", "n_words", "g"])
            .withColumn("words", F.split("window", " "))
            .select("window", "words", "n_words", "item_id", "k", "item"))
    k = F.col("k")
    counted = near.select(
        "window", "n_words", "item_id",
        _grams_of(F.col("words"), k).alias("x"), _grams_of(F.col("item"), k).alias("y"))
    counted = counted.withColumns({c: F.array_sort(c) for c in "xy"})
    counted = counted.withColumns({c: _counted(c) for c in "xy"})
    both = F.size(F.array_intersect("x", "y"))
    alike = materialize(
        counted.withColumn("lesser", both)
        .withColumn("greater", F.size("x") + F.size("y") - F.col("lesser"))
        .where(100 * F.col("lesser") >= PERCENT * F.col("greater"))
        .select("window", "n_words", "item_id",
                (F.col("lesser") / F.col("greater")).alias("similarity")))
    found = salted_join(windows, alike, ["window", "n_words"])
    return (found.groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("similarity", -F.col("start"))).alias("best"),
                 F.max("n_words").alias("item_words"))
            .select("doc_id", "item_id", "best.similarity",
                    (-F.col("best.col2")).cast("long").alias("word_start"),
                    F.col("item_words").cast("long").alias("item_words")))
