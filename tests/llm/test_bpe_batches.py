"""Merging many pieces at once against merging them one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import bpe
from mercato.llm.queries import rank_codec


def made_ranks(r, letters, n):
    """Byte ranks and ``n`` tokens, each of two that exist."""
    ranks = {bytes([i]): i for i in range(256)}
    known = [bytes([c]) for c in letters]
    while n:
        token = r.choice(known) + r.choice(known)
        if token not in ranks and len(token) < 9:
            ranks[token] = len(ranks) + 40
            known.append(token)
            n -= 1
    return ranks


@pytest.mark.parametrize("seed", range(4))
def test_rows_of_an_array_merge_like_single_pieces(seed):
    r = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abcde\x00"
    ranks = made_ranks(r, letters, 25)
    pairs, byte_ids = bpe.PairRanks(ranks), np.arange(256)
    for width in (2, 4, 8, 16, 64):
        pieces = [bytes(r.choices(letters, k=r.randint(2, width))) for _ in range(200)]
        got = bpe.merge_pieces(pieces, width, byte_ids, pairs)
        for piece, ids in zip(pieces, got, strict=True):
            own = dict(ranks)
            own.pop(piece, None)                 # a whole token is looked up, never merged
            if piece not in ranks:
                assert np.frombuffer(ids, "<i4").tolist() == bpe.merge_piece(piece, own), piece


def test_pairs_that_make_no_token():
    pairs = bpe.PairRanks({b"a": 5, b"b": 6, b"ab": 900, b"aba": 70})
    left, right = np.array([5, 6, 900, 5, 5]), np.array([6, 5, 5, 5, 900])
    assert pairs.of(left, right).tolist()[:1] == [900] and pairs.of(left, right)[2] == 70
    assert (pairs.of(left, right)[[1, 3, 4]] == bpe._NONE >> bpe._SHIFT).all()


def test_every_text_is_encoded_once(spark):
    df = spark.createDataFrame([("x",)], "text string")
    coded = bpe.encoded(df, rank_codec(spark)).select(
        F.size("ids"), F.sha2("decoded", 256), F.sha2(F.concat_ws(" ", F.col("ids").cast(
            "array<string>")).cast("binary"), 256))
    plan = coded._jdf.queryExecution().executedPlan().toString()
    calls = [line for line in plan.splitlines() if "ArrowEvalPython [" in line]
    assert len(calls) == 1 and calls[0].count("both(") == 1


def test_memory_of_pieces_turns_over(monkeypatch):
    """Ids stay right while the remembered pieces are replaced, and long
    pieces are not kept."""
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "AT_ONCE", 40)
    r = random.Random(9)
    ranks = made_ranks(r, b"abc", 30)
    vocabulary = bpe.Vocabulary(b"", r"\w+|\s+")
    vocabulary.ranks, vocabulary.pairs = ranks, bpe.PairRanks(ranks)
    vocabulary.byte_ids = np.arange(256)
    texts = [" ".join("".join(r.choices("abc", k=r.randint(1, 90))) for _ in range(r.randint(0, 30)))
             for _ in range(120)] + ["", None]
    for text, ids in zip(texts, vocabulary.encode(texts), strict=True):
        expected = [i for piece in vocabulary.pattern.findall(text or "")
                    for i in bpe.merge_piece(piece.encode(), ranks)]
        assert np.frombuffer(ids, "<i4").tolist() == expected
    assert max(map(len, vocabulary.known), default=0) <= bpe.LONGEST_REMEMBERED
