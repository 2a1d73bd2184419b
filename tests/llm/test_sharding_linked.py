"""Sharding of tables whose rows nearly all have a copy."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mercato.llm import sharding


@pytest.mark.parametrize("size, alone", [(2, 0), (6, 0), (50, 0), (6, 24)])
def test_groups_stay_whole_where_every_row_has_a_copy(spark, size, alone):
    n = 2400
    group = F.when(F.col("id") < alone, F.concat(F.lit("s"), "id")).otherwise(
        F.concat(F.lit("g"), F.floor(F.col("id") / size)))
    docs = spark.range(n).withColumns({"same": group, "spread": F.xxhash64("id")})
    out = sharding.balanced_shards(docs, "same", "spread").collect()
    homes, counts = {}, {}
    for x in out:
        homes.setdefault(x["same"], set()).add(x["shard"])
        counts[x["shard"]] = counts.get(x["shard"], 0) + 1
    assert len(out) == n and set(counts.values()) == {n // 8}
    assert sum(len(h) > 1 for h in homes.values()) <= 7      # one at each inner end of a shard


def test_moves_keep_every_shard_within_its_places():
    wanted = {(0, 1): 5, (1, 2): 3, (2, 0): 4, (3, 0): 9, (1, 3): 2}
    moves = sharding.admitted_moves(wanted, [0, 0, 0, 1])
    assert moves and all(n <= wanted[k] for k, n in moves.items())
    for s, free in enumerate([0, 0, 0, 1]):
        grown = sum(n for (f, t), n in moves.items() if t == s) - sum(
            n for (f, t), n in moves.items() if f == s)
        assert grown <= free
