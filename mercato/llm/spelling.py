"""Groups of spelling variants: Bloom-guided neighbourhoods.

Two words are near if they differ by exactly one inserted, deleted or
replaced code point.  The words of a vocabulary go into blocked Bloom filters
sharded by word length (64-byte blocks of eight lanes, one bit a lane), which
are broadcast.  Every word then generates its edits and probes the filters:

- its deletions against the shard of the next smaller length (this also finds
  the insertions, which are deletions of the longer word);
- its replacements by a greater letter against the shard of its own length
  (the smaller letters are found from the other word).

A filter never misses a word, so only positives shuffle, to an exact join
with the vocabulary that removes the false ones.

The hash of a word is a polynomial in its code points, so the hash of an edit
follows from that of the word by a few operations on whole arrays and no
edited string is built unless a filter says yes.

Bound of the broadcast: ``max_bytes`` a pass (16 bits a word).  A larger
vocabulary is split by hash into as many passes as it needs, each with its
own filters; every pass probes all edits and none is left out.

A word's *form* is its near word of largest count (ties: the smallest in
code-point order) if that count is at least ``times`` its own.  Its *root* is
the last word that forms lead to from it.  Counts grow ``times``-fold along a
chain, so chains are short.

Null and empty words don't count as words; repeated rows of a word add up
their counts; an empty vocabulary gives an empty table.  Letters of any
script work; the number of probes grows with the alphabet, which is the set
of code points in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.text import ASCII_UPPER, written
from mercato.session import ship_package

BITS_A_WORD = 16                # filter bits for each word of the vocabulary
MAX_BYTES = 64 << 20            # filter bytes of one broadcast
TIMES = 10                      # a form occurs at least so many times as often
LONGEST_SHARD = 64              # words of this length and more share a shard
PROBES = 1 << 18                # edits tested at once in a task
WORDS_A_TASK = 20_000           # small in bytes, but each makes hundreds of edits

_LANES = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)                     # any odd number: powers are invertible
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))

PAIR = "word string, n long, other string"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    np.multiply.accumulate(np.full(n, _ODD), out=out[1:]) if n else None
    return out


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)


def _strings(codes: np.ndarray) -> list[str]:
    n, length = codes.shape
    flat = np.ascontiguousarray(codes, np.uint32).tobytes().decode("utf-32-le")
    return [flat[i * length:(i + 1) * length] for i in range(n)]


def _letters(codes: np.ndarray) -> np.ndarray:
    return _mixed(codes.astype(np.uint64) + np.uint64(1))


class Filters:
    """Where the filters of each length lie: a power of two of blocks for
    every length, one after another, and the pass that a hash belongs to."""

    def __init__(self, words_of_length: dict[int, int], max_bytes: int = MAX_BYTES):
        block = 64 * _LANES
        total = sum(words_of_length.values()) * BITS_A_WORD // 8
        self.passes = max(1, -(-2 * total // max_bytes))     # twice: powers of two
        self.blocks = {s: 1 << max(0, (-(-n * BITS_A_WORD // (block * self.passes)) - 1)
                                   .bit_length()) for s, n in words_of_length.items()}
        self.first, at = {}, 0
        for shard in sorted(self.blocks):
            self.first[shard] = at
            at += self.blocks[shard]
        self.size = at

    def block_of(self, hashes: np.ndarray, length: int) -> np.ndarray:
        shard = min(length, LONGEST_SHARD)
        return (np.int64(self.first[shard])
                + (hashes & np.uint64(self.blocks[shard] - 1)).astype(np.int64))

    def in_pass(self, hashes: np.ndarray, turn: int) -> np.ndarray:
        return (hashes >> np.uint64(32)) % np.uint64(self.passes) == np.uint64(turn)

    @staticmethod
    def bit(hashes: np.ndarray, lane: int) -> np.ndarray:
        """The bit of a lane, from six bits of a second hash."""
        again = hashes * np.uint64(0xD6E8FEB86659FD93)
        return np.uint64(1) << ((again >> np.uint64(16 + 6 * lane)) & np.uint64(63))

    def hits(self, lanes: np.ndarray, hashes: np.ndarray, length: int, turn: int) -> np.ndarray:
        """Places in ``hashes`` (flat) that the filter of ``length`` may hold."""
        if min(length, LONGEST_SHARD) not in self.blocks:
            return np.empty(0, np.int64)
        left = (np.flatnonzero(self.in_pass(hashes, turn)) if self.passes > 1
                else np.arange(len(hashes)))
        some = hashes[left]
        place = self.block_of(some, length)
        for lane in range(_LANES):
            yes = (lanes[lane, place] & self.bit(some, lane)) != 0
            left, some, place = left[yes], some[yes], place[yes]
        return left


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row, before it is mixed."""
    length = codes.shape[1]
    return (_letters(codes) * _powers(length)[:length]).sum(axis=1, dtype=np.uint64)


def final(hashes: np.ndarray, length: int) -> np.ndarray:
    return _mixed(hashes + np.uint64(length))


def by_length(words: list[str]) -> dict[int, list[int]]:
    places: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(len(word), []).append(i)
    return places


def near_positives(words: list[str], filters: Filters, lanes: np.ndarray, turn: int,
                   alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places of words, edited strings) that the filters may hold."""
    spread = _letters(alphabet)
    for length, at in by_length(words).items():
        step = max(1, PROBES // max(length, len(alphabet)))
        powers = _powers(length)
        for start in range(0, len(at), step):
            rows = np.array(at[start:start + step])
            codes = _codes([words[i] for i in rows], length)
            terms = _letters(codes) * powers[:length]
            total = terms.sum(axis=1, dtype=np.uint64)
            # deletions, once for each run of equal letters
            upto = np.cumsum(terms, axis=1, dtype=np.uint64)
            shorter = (upto - terms) + (total[:, None] - upto) * _INVERSE
            first = np.ones(codes.shape, bool)
            first[:, 1:] = codes[:, 1:] != codes[:, :-1]
            row, place = np.nonzero(first)
            found = filters.hits(lanes, final(shorter[row, place], length - 1), length - 1, turn)
            for cut in range(0, len(found), max(1, PROBES // length)):
                some = found[cut:cut + max(1, PROBES // length)]
                keep = np.arange(length - 1)[None, :]
                keep = keep + (keep >= place[some][:, None])
                yield rows[row[some]], _strings(codes[row[some][:, None], keep])
            # replacements by a greater letter
            for i in range(length):
                row, letter = np.nonzero(alphabet[None, :] > codes[:, i, None])
                hashes = total[row] - terms[row, i] + spread[letter] * powers[i]
                found = filters.hits(lanes, final(hashes, length), length, turn)
                for cut in range(0, len(found), max(1, PROBES // length)):
                    some = found[cut:cut + max(1, PROBES // length)]
                    edited = codes[row[some]].copy()
                    edited[:, i] = alphabet[letter[some]]
                    yield rows[row[some]], _strings(edited)


def _filled(vocabulary: DataFrame, filters: Filters, turn: int) -> np.ndarray:
    """The lanes of one pass: every word sets its bits, Spark merges the
    blocks, and the driver gathers them (``MAX_BYTES`` at most)."""
    schema = "block long, " + ", ".join(f"l{i} long" for i in range(_LANES))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in by_length(words).items():
                hashes = final(word_hashes(_codes([words[i] for i in at], length)), length)
                hashes = hashes[filters.in_pass(hashes, turn)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(filters.block_of(hashes, length))]
                    + [pa.array(filters.bit(hashes, i).view(np.int64)) for i in range(_LANES)],
                    names=["block"] + [f"l{i}" for i in range(_LANES)])

    merged = (vocabulary.select("word").mapInArrow(bits, schema).groupBy("block")
              .agg(*[F.bit_or(f"l{i}").alias(f"l{i}") for i in range(_LANES)]).toArrow())
    lanes = np.zeros((_LANES, filters.size), np.uint64)
    blocks = merged.column("block").to_numpy()
    for i in range(_LANES):
        lanes[i, blocks] = merged.column(f"l{i}").to_numpy().view(np.uint64)
    return lanes


def near_pairs(vocabulary: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(word, n, other, other_n) for each unordered pair of near words of a
    written vocabulary (word, n) of distinct words, once."""
    spark = vocabulary.sparkSession
    ship_package(spark)
    dealt = vocabulary.repartition(-(-vocabulary.count() // WORDS_A_TASK) or 1, "word")
    shard = F.least(F.length("word"), F.lit(LONGEST_SHARD))
    sizes = {r["shard"]: r["n"] for r in
             vocabulary.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    letters = sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.split("word", "")).alias("c"))
                     .where(F.col("c") != "").distinct().collect())
    alphabet = np.array(letters, np.uint32)
    filters = Filters(sizes, max_bytes)

    def probed(shared, turn: int):
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lanes = shared.value
            for batch in batches:
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for rows, edited in near_positives(words, filters, lanes, turn, alphabet):
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("word").take(pa.array(rows)).cast(pa.string()),
                             pa.array(n[rows]), pa.array(edited, pa.string())],
                            names=["word", "n", "other"])
        return probe

    positives = None
    for turn in range(filters.passes if sizes else 0):
        shared = spark.sparkContext.broadcast(_filled(vocabulary, filters, turn))
        some = dealt.select("word", "n").mapInArrow(probed(shared, turn), PAIR)
        if filters.passes > 1:          # so that one pass's filters are in memory at a time
            some = written(some)
            shared.unpersist()
        positives = some if positives is None else positives.union(some)
    if positives is None:
        positives = spark.createDataFrame([], PAIR)
    known = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return positives.join(known, "other").select("word", "n", "other", "other_n")


def counted(words: DataFrame, word: str | Column = "word", shortest: int = 1,
            least: int = 1) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` code points that occur
    at least ``least`` times."""
    return (words.select((F.col(word) if isinstance(word, str) else word).alias("word"))
            .where(F.length("word") >= max(1, shortest))
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; the table look-up runs only where something changes."""
    return F.when(F.lower(word) == word, word).otherwise(
        F.translate(word, ASCII_UPPER, ASCII_UPPER.lower()))


def variants(vocabulary: DataFrame, times: int = TIMES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    vocabulary = written(vocabulary.where(F.length("word") > 0).groupBy("word")
                         .agg(F.sum("n").cast("long").alias("n")))
    pairs = near_pairs(vocabulary, max_bytes)
    sides = pairs.select(F.explode(F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"),
                 F.col("n").alias("near_n")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    form = F.when(-F.col("best.minus") >= times * F.col("n"), F.col("best.near"))
    formed = written(vocabulary.join(best, "word", "left").select(
        "word", form.alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(form.isNotNull(), -F.col("best.minus")).alias("form_n")))
    roots = last_forms(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return (formed.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"),
                    "n", "n_near", "form_n"))


def last_forms(steps: DataFrame) -> DataFrame:
    """(word, root): where the chains word -> root end, by pointer doubling."""
    steps = written(steps)
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(steps.join(onward, "root", "left"))
        if longer.where("further IS NOT NULL").isEmpty():
            return steps
        steps = longer.select("word", F.coalesce("further", "root").alias("root"))
