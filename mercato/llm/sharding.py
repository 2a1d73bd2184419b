"""Balanced label propagation: documents into shards of even counts, with
linked documents together as far as capacity allows.

Documents that share a group are linked.  Linked documents start evenly
dealt.  In each round, one join gives every document the count of its group
in each shard, and it asks to move to the shard that holds most of them
(ties by a hash of group and shard, so that a whole group asks for the same
one).  The driver balances the moves asked between each two shards: moves
into free places and exchanges, also around several shards, so that no shard
grows beyond its quota.  Those admitted go in a fixed order found by
two-level counting, never by sorting a shard in one task.  Rounds end when
no move can be made.  Groups that are then still divided are dealt one after
another into the places that the whole ones leave, so that at most one group
is divided at the end of each shard.  Documents without links then fill what
the quotas leave, so counts are at most one apart, whatever the groups: one
larger than a shard fills whole shards.

Each round is written to the shared checkpoint folder; the driver sees one
number for each shard and each two shards.  Repeated rows are rows of their own, linked with
each other by their text; null texts have no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators._util import ordered_index, salted_join
from mercato.session import materialize

PLACES_PER_TASK = 4096


def _dealt(df: DataFrame, order: str, out: str, within: tuple = ()) -> DataFrame:
    """Gapless number of each row by ``order``, a unique number itself."""
    return ordered_index(df, order, within, F.floor(F.col(order) / PLACES_PER_TASK), out)


def _by_quota(index: str, quotas: list[int]) -> Column:
    """The shard whose share of the numbers 0, 1, 2 ... holds ``index``."""
    out, upto = F.lit(None).cast("int"), sum(quotas)
    for s in reversed(range(len(quotas))):
        out = F.when(F.col(index) < upto, F.lit(s)).otherwise(out)
        upto -= quotas[s]
    return out


def admitted_moves(wanted: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the ``wanted`` moves (from, to) -> rows are made at once:
    paths that end in a shard with free places, and cycles of exchanges,
    until none is left.  No shard takes more than it has free and gives."""
    left, free = dict(wanted), list(free)
    shards = range(len(free))

    def route() -> list[int] | None:
        for start in shards:
            paths, seen = [[start]], {start}
            while paths:
                path = paths.pop(0)
                for to in shards:
                    if left.get((path[-1], to), 0) <= 0:
                        continue
                    if to == start or free[to] > 0:
                        return [*path, to]
                    if to not in seen:
                        seen.add(to)
                        paths.append([*path, to])
        return None

    while path := route():
        steps = list(zip(path, path[1:]))
        n = min(left[step] for step in steps)
        if path[0] != path[-1]:
            n = min(n, free[path[-1]])
            free[path[-1]] -= n
            free[path[0]] += n
        for step in steps:
            left[step] -= n
    return {step: n - left[step] for step, n in wanted.items() if n > left[step]}


def propagate(linked: DataFrame, room: list[int]) -> DataFrame:
    """(place, group, shard) for the linked rows (place, group, shard).  A
    row only ever moves to the shard that holds most of its group, so each
    round leaves fewer rows outside it than the last, and the rounds end."""
    shards = range(len(room))
    labels = linked
    while True:
        tally = labels.groupBy("group", "shard").agg(F.count("*").alias("n"))
        tally = materialize(tally.withColumn("tie", F.xxhash64("group", "shard")))
        load = {r["shard"]: r["n"] for r in tally.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        goal = tally.groupBy("group").agg(F.max(F.struct("n", "tie", "shard")).alias("goal"))
        wishes = materialize(tally.join(goal, "group")
                             .where(F.struct("n", "tie", "shard") < F.col("goal"))
                             .select("group", "shard", "n", F.col("goal.shard").alias("to")))
        wanted = {(r["shard"], r["to"]): r["n"] for r in
                  wishes.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        moves = admitted_moves(wanted, [room[s] - load.get(s, 0) for s in shards])
        if not moves:
            return labels
        wishing = salted_join(labels, wishes.drop("n"), ["group", "shard"])
        if moves != wanted:
            quota = F.coalesce(*[F.when((F.col("shard") == f) & (F.col("to") == t), F.lit(n))
                                 for (f, t), n in moves.items()], F.lit(0))
            order = F.xxhash64("group")
            block = F.struct(F.shiftright(order, 54), F.floor(F.col("place") / PLACES_PER_TASK))
            ranked = ordered_index(materialize(wishing).withColumn("order", order), "order",
                                   ["shard", "to"], block, "rank", ["place"])
            wishing = ranked.where(F.col("rank") < quota)
        labels = materialize(labels.join(wishing.select("place", "to"), "place", "left")
                             .select("place", "group", F.coalesce("to", "shard").alias("shard")))


def gathered(labels: DataFrame, room: list[int]) -> DataFrame:
    """``labels`` with the groups that are still divided dealt anew, one after
    another, into the places that the whole groups leave: each shard's end
    divides one group at most."""
    tally = labels.groupBy("group", "shard").agg(F.count("*").alias("n"))
    homes = materialize(tally.groupBy("group").agg(F.count("*").alias("homes"), F.sum("n").alias("n")))
    divided = homes.where("homes > 1").select("group", "n")
    if divided.isEmpty():
        return labels
    divided = divided.withColumn("order", F.xxhash64("group")).withColumn(
        "block", F.shiftright("order", 52))
    blocks = divided.groupBy("block").agg(F.sum("n").alias("of"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("of").over(before.orderBy("block")), F.lit(0))
                           .alias("offset"))
    inside = F.coalesce(F.sum("n").over(before.partitionBy("block").orderBy("order", "group")),
                        F.lit(0))
    starts = materialize(divided.withColumn("inside", inside).join(blocks, "block")
                         .select("group", (F.col("offset") + F.col("inside")).alias("start")))
    kept = labels.join(starts, "group", "left_anti")
    load = {r["shard"]: r["count"] for r in kept.groupBy("shard").count().collect()}
    left = [room[s] - load.get(s, 0) for s in range(len(room))]
    rows = materialize(salted_join(labels.select("place", "group"), starts, ["group"]))
    at = ordered_index(rows, "place", ["group"], F.floor(F.col("place") / PLACES_PER_TASK), "at")
    dealt = at.withColumn("at", F.col("start") + F.col("at"))
    return kept.select("place", "group", "shard").union(
        dealt.select("place", "group", _by_quota("at", left).alias("shard")))


def balanced_shards(docs: DataFrame, group: str, order: str, shards: int = 8) -> DataFrame:
    """``docs`` with ``place`` (a unique number), ``shard`` and ``slot``
    (gapless from 0 in each shard).  Rows of equal ``group`` are linked;
    ``order`` is a 64-bit hash column that spreads the rows."""
    buckets = 12
    numbered = materialize(ordered_index(docs, order, (), F.shiftright(F.col(order), 64 - buckets),
                                         "place"))
    n = numbered.count()
    room = [n // shards + (s < n % shards) for s in range(shards)]
    groups = (numbered.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group"))
              .agg(F.count("*").alias("n")).where("n > 1").select("group"))
    member = numbered.where(F.col(group).isNotNull()).select("place", F.col(group).alias("group"))
    linked = materialize(_dealt(salted_join(member, groups, ["group"]), "place", "at"))
    linked = linked.select("place", "group", (F.col("at") % shards).cast("int").alias("shard"))
    labels = materialize(gathered(propagate(linked, room), room))
    load = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}
    left = [room[s] - load.get(s, 0) for s in range(shards)]
    rest = numbered.select("place").join(labels, "place", "left_anti")
    filled = (_dealt(rest, "place", "at")
              .select("place", _by_quota("at", left).alias("shard")))
    placed = materialize(labels.select("place", "shard").union(filled))
    slots = _dealt(placed, "place", "slot", ("shard",))
    return numbered.join(slots, "place")
