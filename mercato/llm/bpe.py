"""Byte-level BPE encoding and decoding with a rank file.

Each piece that the split pattern matches is merged by itself.  The pair
ranks of a piece lie in the leaves of a segment tree over its byte
positions; every inner node holds the smaller of its children, so the root
names the leftmost pair of the lowest rank.  A merge changes three leaves
(the pair itself, its left and its right neighbour among the live tokens),
each a walk of log2(n) steps, so a piece of n bytes takes O(n log n).

The pieces of many texts merge together: those of equal tree width lie in the
rows of one array, and each round makes one merge in every row, with the
three walks of all rows taken level by level.  Long pieces and small groups
merge one by one.  Ids and the bytes they decode to come from one function,
so that every text is encoded once.

Nulls and empty texts have no ids and decode to no bytes.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.text import free_name, whole
from mercato.session import ship_package

# Fixed value: the white space of the Unicode property White_Space, which the
# split pattern means by \s.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

# Pieces whose ids a worker remembers, in two generations of this size: once
# the newer is full it becomes the older one, and pieces met again move over.
REMEMBERED = 250_000
LONGEST_REMEMBERED = 64          # characters

AT_ONCE = 200_000                # pieces that are looked up together
WIDEST = 64                      # leaves of the trees that merge together
FEWEST = 16                      # pieces that are worth an array
CELLS = 1 << 20                  # leaves of one array at most

_NONE = 1 << 62
_SHIFT = 32
_MASK = (1 << _SHIFT) - 1


def split_pattern(pattern: str) -> regex.Pattern:
    """``pattern`` with its white-space classes spelled out."""
    spelled = (pattern.replace(r"[^\s", f"[^{WHITE_SPACE}")
               .replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))
    return regex.compile(spelled)


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in blob.splitlines() if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the lowest-ranked pair merges first, the leftmost
    of equals, until no adjacent pair has a rank."""
    known = ranks.get(piece)
    if known is not None:
        return [known]
    n = len(piece)
    if n == 0:
        return []
    size = 1 << max(0, (n - 2).bit_length())
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank << _SHIFT | i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def update(pos: int, value: int) -> None:
        node = size + pos
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    end = list(range(1, n + 1))      # live token at i covers i .. end[i]
    before = list(range(-1, n))      # start of the live token left of i
    while tree[1] != _NONE:
        i = tree[1] & _MASK
        j = end[i]
        k = end[j]
        end[i] = k
        update(j, _NONE) if j < n - 1 else None
        if k < n:
            before[k] = i
            rank = ranks.get(piece[i:end[k]])
            update(i, _NONE if rank is None else rank << _SHIFT | i)
        else:
            update(i, _NONE)
        p = before[i]
        if p >= 0:
            rank = ranks.get(piece[p:k])
            update(p, _NONE if rank is None else rank << _SHIFT | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class PairRanks:
    """(left id, right id) -> rank of the token that both make, by open
    addressing in arrays, for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << _SHIFT | right)
                    values.append(rank)
        bits = max(4, (4 * len(keys)).bit_length())
        self.down = np.uint64(64 - bits)
        self.last = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE >> _SHIFT, np.int64)
        todo, value = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._home(todo)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = todo[free]             # the last of equal places stays
            done = self.keys[at] == todo
            self.values[at[done]] = value[done]
            todo, value, at = todo[~done], value[~done], (at[~done] + 1) & self.last

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.down).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or that of _NONE where the pair makes no token."""
        keys = left.astype(np.int64) << _SHIFT | right
        at = self._home(keys)
        out = self.values[at]
        other = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(other):
            at[other] = (at[other] + 1) & self.last
            out[other] = self.values[at[other]]
            held = self.keys[at[other]]
            other = other[(held != keys[other]) & (held != -1)]
        out[self.keys[at] == -1] = _NONE >> _SHIFT
        return out


def merge_pieces(pieces: list[bytes], width: int, byte_ids: np.ndarray,
                 pairs: PairRanks) -> list[bytes]:
    """Ids (32-bit, as bytes) of pieces of at most ``width`` bytes, a power
    of two: a segment tree of ``width`` leaves in each row of one array."""
    rows = len(pieces)
    length = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
    token = byte_ids[flat].astype(np.int64)              # of the live token at each place
    place = np.arange(width, dtype=np.int64)
    end = np.tile(place + 1, rows)
    before = np.tile(place - 1, rows)
    tree = np.full((rows, 2 * width), _NONE, np.int64)
    ids = token.reshape(rows, width)
    first = pairs.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1)
    held = (first << _SHIFT) + place[:-1]
    tree[:, width:-1] = np.where((place[:-1] + 1 < length[:, None])
                                 & (first != _NONE >> _SHIFT), held, _NONE)
    low = width
    while low > 1:
        tree[:, low // 2:low] = np.minimum(tree[:, low:2 * low:2], tree[:, low + 1:2 * low:2])
        low //= 2
    tree = tree.ravel()
    live = np.arange(rows)
    while True:
        root = tree[live * (2 * width) + 1]
        live = live[root != _NONE]
        if not len(live):
            break
        root = root[root != _NONE]
        base, node = live * width, live * (2 * width) + width
        i = root & _MASK
        j = end[base + i]
        k = end[base + j]
        end[base + i], token[base + i] = k, root >> _SHIFT
        follows = k < length[live]
        next_ = np.where(follows, k, i)
        before[(base + k)[follows]] = i[follows]
        p = before[base + i]
        precedes = p >= 0
        p = np.where(precedes, p, i)
        new = pairs.of(np.concatenate([token[base + i], token[base + p]]),
                       np.concatenate([token[base + next_], token[base + i]]))
        n = len(live)
        right = np.where(follows & (new[:n] != _NONE >> _SHIFT), (new[:n] << _SHIFT) + i, _NONE)
        left = np.where(new[n:] != _NONE >> _SHIFT, (new[n:] << _SHIFT) + p, _NONE)
        tree[node + j] = _NONE
        tree[(node + p)[precedes]] = left[precedes]
        tree[node + i] = right
        start = np.concatenate([node - width] * 3)
        walk = np.concatenate([i, j, p]) + width
        while walk[0] > 1:
            walk >>= 1
            tree[start + walk] = np.minimum(tree[start + 2 * walk], tree[start + 2 * walk + 1])
    # live tokens: places that the tokens before them end at
    starts = np.zeros((rows, width + 1), bool)
    starts[:, 0] = True
    end = end.reshape(rows, width)
    at = np.zeros(rows, np.int64)
    going = np.arange(rows)
    while len(going):
        at[going] = end[going, at[going]]
        going = going[at[going] < length[going]]
        starts[going, at[going]] = True
    counts = starts.sum(axis=1)
    out = token.reshape(rows, width)[starts[:, :width]].astype("<i4").tobytes()
    cuts = [0, *np.cumsum(counts * 4).tolist()]
    return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Vocabulary:
    """Ranks, split pattern and token bytes, built once in each worker from
    the broadcast rank file (its size is that of the vocabulary, never of
    the data)."""

    _loaded: dict = {}

    def __init__(self, blob: bytes, pattern: str):
        self.ranks = read_ranks(blob)
        self.pattern = split_pattern(pattern)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)])
        self.pairs = PairRanks(self.ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, shared, pattern: str) -> Vocabulary:
        key = (shared.id, pattern) if hasattr(shared, "id") else (id(shared), pattern)
        if key not in cls._loaded:
            cls._loaded.clear()
            cls._loaded[key] = cls(shared.value, pattern)
        return cls._loaded[key]

    def _learn(self, pieces: set[str]) -> None:
        """Merge the pieces that are not remembered."""
        same_width: dict[int, list[str]] = {}
        for piece in pieces:
            got = self.older.get(piece)
            raw = b"" if got is not None else piece.encode()
            if got is None and raw in self.ranks:
                got = np.int32(self.ranks[raw]).tobytes()
            if got is not None:
                self.known[piece] = got
            else:
                width = 1 << (len(raw) - 1).bit_length()
                same_width.setdefault(width, []).append(piece)
        for width, group in same_width.items():
            if width > WIDEST or len(group) < FEWEST:
                for piece in group:
                    self.known[piece] = array("i", merge_piece(piece.encode(),
                                                               self.ranks)).tobytes()
                continue
            step = CELLS // width
            for at in range(0, len(group), step):
                some = group[at:at + step]
                self.known.update(zip(some, merge_pieces(
                    [p.encode() for p in some], width, self.byte_ids, self.pairs), strict=True))

    def _ids(self, found: list[list[str]]) -> list[bytes]:
        """The ids of texts, given as their pieces."""
        new = set().union(*found).difference(self.known)
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in found]
        for piece in new:
            if len(piece) > LONGEST_REMEMBERED:
                del self.known[piece]
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        return out

    def encode(self, texts) -> list[bytes]:
        """Ids (32-bit, as bytes) of each text; null like empty."""
        out: list[bytes] = []
        found: list[list[str]] = []
        held = 0
        for text in texts:
            found.append(self.pattern.findall(text) if text else [])
            held += len(found[-1])
            if held >= AT_ONCE:
                out += self._ids(found)
                found, held = [], 0
        return out + self._ids(found)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _id_lists(rows: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [len(r) // 4 for r in rows])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                    pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))


class BytePairCodec:
    """Column expressions that encode texts to ids and decode ids to bytes."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        ship_package(spark)
        with open(rank_file, "rb") as f:
            shared = spark.sparkContext.broadcast(f.read())

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return _id_lists(Vocabulary.of(shared, pattern).encode(t.as_py() for t in texts))

        @F.arrow_udf("binary")
        def decode(rows: pa.Array) -> pa.Array:
            vocabulary = Vocabulary.of(shared, pattern)
            return pa.array([vocabulary.decode(ids.values.to_pylist()) if ids.is_valid else b""
                             for ids in rows], pa.binary())

        @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
        def both(texts: pa.Array) -> pa.Array:
            vocabulary = Vocabulary.of(shared, pattern)
            rows = vocabulary.encode(t.as_py() for t in texts)
            decoded = [vocabulary.decode(np.frombuffer(r, "<i4").tolist()) for r in rows]
            return pa.StructArray.from_arrays([_id_lists(rows), pa.array(decoded, pa.binary())],
                                              ["ids", "decoded"])

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: str | Column) -> Column:
        return self._encode(text)

    def decode(self, ids: str | Column) -> Column:
        return self._decode(ids)

    def both(self, text: str | Column) -> Column:
        """Ids and the bytes that they decode to, of one encoding."""
        return self._both(text)


def encoded(df: DataFrame, codec: BytePairCodec, text: str = "text", ids: str = "ids",
            decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of its texts and the bytes they decode to.  An
    existing column of either name is replaced."""
    coded = free_name(df, "__coded")
    return (df.withColumn(coded, codec.both(whole(text)))
            .withColumns({ids: F.col(coded)["ids"], decoded: F.col(coded)["decoded"]})
            .drop(coded))
