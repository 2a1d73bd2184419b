"""Merkle manifest of a table: bitmap ranks place the leaves, keyed slots
reduce the levels.

Every group of rows (for example a language) has its own tree, in which the
leaves stand in ascending order of an integer id; the subroots of the groups,
in order of the group's name (null first), make the tree of the root.

*Places without sorting leaves.*  The ids of a group form a compressed
bitmap: one 64-bit word for every 64 ids that holds at least one, merged by
``bit_or``.  Above the words lies a directory of popcounts, three further
levels of 2^16 children each, so that whatever the ids are, no window sees
more than 65,536 rows.  The place of a row is the count before its word plus
the popcount of the bits below its own.

*Levels.*  A cell is the 512 consecutive places (three levels of eight) under
one node.  A task takes the rows of a cell, puts each into the slot of its
place and hashes up; the next pass does the same with the cells' nodes, until
every group has one node.  On the way down each cell learns the siblings on
its path to the root, and a last pass over the cells' rows gives every leaf
its proof and folds it up to the root again.

Rows with a null id come first in their group.  Rows that share an id are in
order of their leaves; identical rows are counted and take one place each, so
that no key is numbered by one task.  A null group is a group like any other.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.text import written
from mercato.operators._util import salted_join
from mercato.session import ship_package

FAN = 8
LEVELS = 3                       # levels of one cell
CELL = FAN ** LEVELS
WORD_BITS = 6                    # ids of a word: 64
STEP_BITS = 16                   # children of a directory node: 65,536
STEPS = 3                        # directory levels above the words
COPIES = 4096                    # identical rows that are written out at once

_PATH = "array<struct<place:int,others:array<string>>>"
_CELLS = "grp string, cell long, full string, alone string, last long"
_PATHS = f"grp string, slot long, path {_PATH}, top string"
_PROOFS = ("grp string, key long, leaf string, subroot string, root string, "
           "proof_sha256 string, folded_root string, verified boolean")


# ------------------------------------------------------------------ leaves

def leaf_hash(values: Sequence[Column]) -> Column:
    """Digest of a row: every value as its byte count, a colon and itself
    (integers decimal), ``-`` for a null, one after another."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text),
                                F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_name(group: Column) -> Column:
    """A non-null name of a group that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


# ------------------------------------------------------------------ places

def _word(key: str = "key") -> Column:
    return F.shiftright(key, WORD_BITS)


def _bit(key: str = "key") -> Column:
    return (F.col(key).bitwiseAND(F.lit((1 << WORD_BITS) - 1))).cast("int")


def id_bitmaps(ids: DataFrame) -> DataFrame:
    """(grp, word, bits, extra, n) from (grp, key): the bitmap words, the
    rows that ids have beyond their first (place in the word and number),
    and the number of rows of the word."""
    words = (ids.withColumns({"word": _word(), "bit": _bit()}).groupBy("grp", "word")
             .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("n")))
    extra = (ids.groupBy("grp", "key").agg(F.count("*").alias("n")).where("n > 1")
             .groupBy("grp", _word().alias("word"))
             .agg(F.collect_list(F.struct(_bit().alias("bit"), (F.col("n") - 1).alias("n")))
                  .alias("extra")))
    return words.join(extra, ["grp", "word"], "left")


def with_offsets(words: DataFrame, first: DataFrame) -> DataFrame:
    """Words with ``before``, the rows of the group that stand ahead of
    them; ``first`` (grp, before) starts each group."""
    levels = [words.select("grp", F.col("word").alias("node"), "n")]
    for _ in range(STEPS):
        levels.append(levels[-1].groupBy("grp", F.shiftright("node", STEP_BITS).alias("node"))
                      .agg(F.sum("n").alias("n")))
    start = first.select("grp", F.col("before").alias("start"))
    for step in range(STEPS, -1, -1):
        level = levels[step]
        parents = ["grp"] if step == STEPS else ["grp", "parent"]
        level = level.withColumn("parent", F.shiftright("node", STEP_BITS))
        ahead = F.sum("n").over(Window.partitionBy(*parents).orderBy("node")
                                .rowsBetween(Window.unboundedPreceding, -1))
        start = (level.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
                 .join(start, parents)
                 .select("grp", F.col("node").alias("parent" if step else "word"),
                         (F.col("start") + F.col("ahead")).alias("start")))
    return words.join(start, ["grp", "word"]).withColumnRenamed("start", "before")


def placed(leaves: DataFrame) -> DataFrame:
    """(grp, key, leaf, probe, slot): ``leaves`` (grp, key, leaf, probe) with
    the place of each row in its group, from 0 without gaps."""
    ids = leaves.select("grp", "key").where("key IS NOT NULL")
    nulls = leaves.groupBy("grp").agg(F.count_if(F.col("key").isNull()).alias("before"))
    words = written(with_offsets(id_bitmaps(ids), nulls).drop("n"))
    rows = leaves.where("key IS NOT NULL").withColumn("word", _word())
    below = F.expr("bits & ~shiftleft(-1L, bit)")
    extra_below = F.expr("coalesce(aggregate(filter(extra, e -> e.bit < bit), 0L, "
                         "(s, e) -> s + e.n), 0L)")
    found = (salted_join(rows, words, ["grp", "word"]).withColumn("bit", _bit())
             .select("grp", "key", "leaf", "probe",
                     (F.col("before") + F.bit_count(below) + extra_below).alias("slot"),
                     F.expr("coalesce(exists(extra, e -> e.bit = bit), false)").alias("again")))
    first = leaves.where("key IS NULL").select("grp", "key", "leaf", "probe",
                                               F.lit(0).cast("long").alias("slot"),
                                               F.lit(True).alias("again"))
    found = written(found.union(first))
    return found.where("NOT again").drop("again").union(_spread(found.where("again")))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows that share an id, all with the id's first place as ``slot``, in
    order of their leaves.  Identical rows are one row with a count until
    the end; the leaf's first digits split an id's rows."""
    kinds = rows.groupBy("grp", "key", "leaf", "probe", "slot").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("part", F.substring("leaf", 1, 3))
    same = ["grp", "key"]
    parts = kinds.groupBy(*same, "part").agg(F.sum("n").alias("m"))
    ahead = F.sum("m").over(Window.partitionBy(*same).orderBy("part")
                            .rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("grp").alias("g"), F.col("key").alias("k"),
                         F.col("part").alias("p"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy(*same, "part").orderBy("leaf")
                             .rowsBetween(Window.unboundedPreceding, -1))
    kinds = kinds.withColumn("inside", F.coalesce(inside, F.lit(0)))
    joined = kinds.join(parts, (kinds["grp"] == F.col("g")) & (kinds["part"] == F.col("p"))
                        & kinds["key"].eqNullSafe(F.col("k")))
    start = F.col("slot") + F.col("ahead") + F.col("inside")
    chunks = joined.select("grp", "key", "leaf", "probe", start.alias("start"), "n",
                           F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("chunk"))
    last = F.least(F.col("n"), (F.col("chunk") + 1) * COPIES) - 1
    return (chunks.repartition("grp", "start", "chunk")
            .select("grp", "key", "leaf", "probe",
                    F.explode(F.sequence(F.col("start") + F.col("chunk") * COPIES,
                                         F.col("start") + last)).alias("slot")))


# ------------------------------------------------------------------ levels

def _digest(texts: Sequence[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _levels(slots: list[str], levels: int | None) -> list[list[str]]:
    """The levels above ``slots``, them first: so many, or until one node is left."""
    out = [slots]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_digest(below[i:i + FAN]) for i in range(0, len(below), FAN)])
    return out


def _in_slots(table: pa.Table, value: str, slot: str = "slot") -> list[str]:
    """The values of a cell by place: an array with a slot for each."""
    out = [None] * table.num_rows
    for place, text in zip(table.column(slot).to_pylist(), table.column(value).to_pylist(),
                           strict=True):
        out[place % CELL] = text
    return out


def _path(levels: list[list[str]], place: int) -> list[tuple[int, list[str]]]:
    """(place in the run, the run's other nodes) at each level but the top."""
    steps = []
    for nodes in levels[:-1]:
        first = place - place % FAN
        run = nodes[first:first + FAN]
        steps.append((place % FAN, run[:place - first] + run[place - first + 1:]))
        place //= FAN
    return steps


def _cell_nodes(table: pa.Table) -> pa.Table:
    """The node above a cell, both if it is its group's only cell and if not."""
    slots = _in_slots(table, "hash")
    cell = table.column("slot")[0].as_py() // CELL
    return pa.table({"grp": table.column("grp")[:1], "cell": [cell],
                     "full": _levels(slots, LEVELS)[-1], "alone": _levels(slots, None)[-1],
                     "last": [cell]})


def _cells(nodes: DataFrame) -> DataFrame:
    return (nodes.withColumn("cell", F.floor(F.col("slot") / CELL))
            .groupBy("grp", "cell").applyInArrow(_cell_nodes, _CELLS))


def paths(nodes: DataFrame) -> DataFrame:
    """(grp, slot, path, top) of ``nodes`` (grp, slot, hash): the siblings
    on the way up to the group's top node, and that node."""
    def join_paths(below: pa.Table, above: pa.Table) -> pa.Table:
        if not below.num_rows:
            return pa.Table.from_pylist([], _ARROW_PATHS)
        more, top, only = (above.column(c)[0].as_py() for c in ("path", "top", "only"))
        levels = _levels(_in_slots(below, "hash"), None if only else LEVELS)
        places = below.column("slot").to_pylist()
        return pa.table({
            "grp": below.column("grp"), "slot": below.column("slot"),
            "path": pa.array([[{"place": a, "others": b} for a, b in _path(levels, s % CELL)]
                              + more for s in places], _ARROW_PATHS.field("path").type),
            "top": [top] * len(places)}).cast(_ARROW_PATHS)

    return (_by_cell(nodes).cogroup(_by_cell(upper(nodes)))
            .applyInArrow(join_paths, _PATHS))


_ARROW_PATHS = pa.schema([
    ("grp", pa.string()), ("slot", pa.int64()),
    ("path", pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))),
    ("top", pa.string())])


def _by_cell(df: DataFrame):
    if "cell" not in df.columns:
        df = df.withColumn("cell", F.floor(F.col("slot") / CELL))
    return df.groupBy("grp", "cell")


def upper(nodes: DataFrame) -> DataFrame:
    """(grp, cell, path, top, only): for each cell of ``nodes`` its path
    from the cell's node to the group's top, and whether it is the only
    cell of its group.  Each pass has a 512th of the rows of the last."""
    cells = written(_cells(nodes))
    groups = cells.groupBy("grp").agg(F.max("last").alias("last"))
    with_last = salted_join(cells.drop("last"), groups, ["grp"])
    none = F.expr(f"cast(array() as {_PATH})")
    single = with_last.where("last = 0").select("grp", "cell", none.alias("path"),
                                                F.col("alone").alias("top"),
                                                F.lit(True).alias("only"))
    many = with_last.where("last > 0").select("grp", F.col("cell").alias("slot"),
                                              F.col("full").alias("hash"))
    if many.isEmpty():
        return written(single)
    return written(single.union(paths(many).select(
        "grp", F.col("slot").alias("cell"), "path", "top", F.lit(False).alias("only"))))


def proofs(rows: DataFrame, above: DataFrame) -> DataFrame:
    """For ``rows`` (grp, key, leaf, probe, slot): the digest of the proof,
    the root folded from ``probe`` (or else the leaf) and the original
    siblings, and whether it equals the root.  ``above`` is :func:`upper` of
    the leaves with the root's path (``root_path``) and ``root``."""
    def prove(cell: pa.Table, about: pa.Table) -> pa.Table:
        n = cell.num_rows
        if not n:
            return pa.Table.from_pylist([], _ARROW_PROOFS)
        path, top, only, root_path, root = (
            about.column(c)[0].as_py() for c in ("path", "top", "only", "root_path", "root"))
        levels = _levels(_in_slots(cell, "leaf"), None if only else LEVELS)
        shared = [(s["place"], s["others"]) for s in path + root_path]
        tail = "".join("".join(others) for _, others in shared)
        proof, folded, ends = [], [], {}
        for slot, leaf, probe in zip(*(cell.column(c).to_pylist()
                                       for c in ("slot", "leaf", "probe")), strict=True):
            own = _path(levels, slot % CELL)
            proof.append(_digest([h for _, others in own for h in others] + [tail]))
            node = leaf if probe is None else probe
            for place, others in own:
                node = _digest(others[:place] + [node] + others[place:])
            if node not in ends:                 # the way up from here is the cell's
                end = node
                for place, others in shared:
                    end = _digest(others[:place] + [end] + others[place:])
                ends[node] = end
            folded.append(ends[node])
        return pa.table({"grp": cell.column("grp"), "key": cell.column("key"),
                         "leaf": cell.column("leaf"), "subroot": [top] * n, "root": [root] * n,
                         "proof_sha256": proof, "folded_root": folded,
                         "verified": [f == root for f in folded]}).cast(_ARROW_PROOFS)

    return _by_cell(rows).cogroup(_by_cell(above)).applyInArrow(prove, _PROOFS)


_ARROW_PROOFS = pa.schema(
    [("grp", pa.string()), ("key", pa.int64())]
    + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    + [("verified", pa.bool_())])


def group_places(groups: DataFrame) -> DataFrame:
    """``groups`` (grp, ...) with ``slot``, their place by name: sorted by
    ranges, numbered inside each range and offset by the ranges before it."""
    sorted_rows = written(groups.repartitionByRange("grp")
                          .withColumn("part", F.spark_partition_id()))
    sizes = sorted_rows.groupBy("part").agg(F.count("*").alias("m"))
    ahead = F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("grp")) - 1
    return (sorted_rows.withColumn("inside", inside).join(sizes, "part")
            .withColumn("slot", (F.col("ahead") + F.col("inside")).cast("long"))
            .drop("part", "inside", "ahead"))


def manifest(leaves: DataFrame, group: str, key: str, leaf: str, probe: str) -> DataFrame:
    """(grp, key, leaf, subroot, root, proof_sha256, folded_root, verified),
    a row for each of ``leaves``: ``leaf`` is its digest, ``probe`` the digest
    to verify against the tree in its stead (null: the leaf itself), ``key``
    an integer.  ``grp`` is the group as :func:`group_name` writes it."""
    ship_package(leaves.sparkSession)
    rows = leaves.select(group_name(F.col(group)).alias("grp"),
                         F.col(key).cast("long").alias("key"),
                         F.col(leaf).alias("leaf"), F.col(probe).alias("probe"))
    slots = written(placed(rows))
    cells = upper(slots.select("grp", "slot", F.col("leaf").alias("hash")))
    tops = group_places(cells.groupBy("grp").agg(F.max("top").alias("hash")))
    tops = written(tops)
    root = paths(tops.select(F.lit("").alias("grp"), "slot", "hash"))
    about = written(root.join(tops.select(F.col("grp").alias("name"), "slot"), "slot").select(
        F.col("name").alias("grp"), F.col("path").alias("root_path"), F.col("top").alias("root")))
    return proofs(slots, salted_join(cells, about, ["grp"]))
