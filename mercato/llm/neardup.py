"""Near-duplicate documents by one-permutation MinHash.

Every distinct shingle of a document is hashed once.  The hash picks one of
``BANDS * ROWS`` bins and competes there for the least value; bins left
empty copy a non-empty bin, found by a fixed sequence of pseudo-random
probes of their own (optimal densification), so that two sets agree in a bin
with the probability of their similarity however small they are.  ``ROWS``
bins together are a band key; documents that share a key share a bucket.

Documents with equal sets are one class, whose smallest id stands for it.
A bucket gives star-shaped candidates: its centre with every other member,
so their number is linear in its size.  The centre is the member whose
buckets are fullest, which among copies of one text is the text that they
all resemble most.  Each candidate is confirmed on the full sets.

What a star may miss is a link between two members that are both too far
from the centre.  So the buckets that the stars leave in several components
are joined into clusters, and there every member outside the cluster's main
component is held against all others: in cells of ``CELL`` by ``CELL``
documents, those that share a bucket in full; the comparison is part of the
join, so no list of pairs is ever made and no link that a bucket holds is lost.

Similarity: intersection over union of the sets of ``words``-word shingles.
At 0.8 a pair shares no bucket with probability 1.9e-6.  Null and empty
texts (no words) have the empty set and link with nothing.  Rows without a
doc_id link with nothing; repeated rows are one class.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.components import components
from mercato.llm.text import shingles, space_words, whole, written
from mercato.operators._util import salted_join
from mercato.session import ship_package

ROWS = 4
BANDS = 25
BINS = ROWS * BANDS
CELL = 256
STEP = 1 << 17
BROADCAST_IDS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SIGNATURE = T.StructType([T.StructField("set_key", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA5CB9243F0AED3B5)
    return x ^ (x >> np.uint64(32))


def one_permutation(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` x ``BINS`` least values per bin, densified; ``rows`` gives the
    set of each hash, and every set has one hash at least."""
    mixed = _mixed(hashes)
    at = rows * BINS + (mixed % np.uint64(BINS)).astype(np.int64)
    value = mixed // np.uint64(BINS)
    order = np.argsort(value, kind="stable")[::-1]
    table = np.zeros(n * BINS, np.uint64)
    full = np.zeros(n * BINS, bool)
    table[at[order]] = value[order]           # the least is written last
    full[at] = True
    empty = np.flatnonzero(~full)
    probe = 0
    while len(empty):
        probe += 1
        own = empty % BINS
        target = empty - own + (_mixed(own.astype(np.uint64) * _MIX + np.uint64(probe))
                                % np.uint64(BINS)).astype(np.int64)
        hit = full[target]
        table[empty[hit]] = table[target[hit]]
        empty = empty[~hit]
    return table.reshape(n, BINS)


def signatures(sets: pa.Array) -> pa.Array:
    """Key and bands of every set of a batch.  ``STEP`` hashes are worked on
    at once, so a worker's memory does not grow with the batch."""
    lengths = np.diff(sets.offsets.to_numpy()).astype(np.int64)
    values = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    some = np.flatnonzero(lengths)
    keys = [None] * len(lengths)
    band_lengths = np.where(lengths > 0, BANDS, 0)
    start = np.concatenate([[0], np.cumsum(lengths)])
    flat = [np.zeros(0, np.int64)]
    steps = np.split(some, np.flatnonzero(np.diff(start[some] // STEP)) + 1) if len(some) else []
    for part in steps:
        for i in part:
            keys[i] = hashlib.blake2b(np.sort(values[start[i]:start[i + 1]]).tobytes(),
                                      digest_size=16).digest()
        rows = np.repeat(np.arange(len(part)), lengths[part])
        # the sets between the part's are empty
        own = values[start[part[0]]:start[part[-1] + 1]]
        bins = one_permutation(own.view(np.uint64), rows, len(part))
        band = np.zeros((len(part), BANDS), np.uint64)
        for r in range(ROWS):
            band = _mixed(band * _MIX + bins[:, r::ROWS][:, :BANDS])
        flat.append(band.reshape(-1).view(np.int64))
    offsets = np.concatenate([[0], np.cumsum(band_lengths)]).astype(np.int32)
    return pa.StructArray.from_arrays(
        [pa.array(keys, pa.binary()),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat), pa.int64()))],
        ["set_key", "bands"])


_signature = F.arrow_udf(signatures, _SIGNATURE)


def shingle_sets(docs: DataFrame, words: int, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, shingles): the distinct shingle hashes of every document."""
    split = docs.select(F.col(doc_id).alias("doc_id"), space_words(whole(text)).alias("words"))
    return split.select("doc_id", F.array_distinct(shingles(F.col("words"), words))
                        .alias("shingles"))


def _similar(x: str, y: str, percent: int) -> Column:
    # 100 * both >= percent * (x + y - both), so that both is computed once
    return (100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.size(x) + F.size(y))


def _near_sizes(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between the centre of each bucket and its other
    members.  ``members``: band, key, rep, n, size (of the bucket)."""
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = members.join(weights, "rep")
    centres = (weighed.groupBy("band", "key")
               .agg(F.max(F.struct("weight", (-F.col("rep")).alias("back"), "n")).alias("c"))
               .select("band", "key", (-F.col("c.back")).alias("centre"), F.col("c.n").alias("m")))
    pairs = (salted_join(members, centres, ["band", "key"])
             .where((F.col("rep") != F.col("centre")) & _near_sizes(F.col("n"), F.col("m"), percent))
             .select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    return (pairs.join(right, "b").join(left, "a").where(_similar("sa", "sb", percent))
            .select("a", "b"))


def cluster_links(members: DataFrame, roots: DataFrame, sets: DataFrame, bands: DataFrame,
                  percent: int) -> DataFrame | None:
    """Confirmed links between components (a, b, named by their roots) that
    the stars have missed, by cells; None if no bucket is left open."""
    rooted = (members.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
              .withColumn("root", F.coalesce("root", "rep")).drop("size"))
    open_buckets = (rooted.groupBy("band", "key")
                    .agg(F.min("root").alias("least"), F.max("root").alias("most"),
                         F.min("rep").alias("first")).where("least <> most")
                    .select("band", "key", "first"))
    rest = written(salted_join(rooted, open_buckets, ["band", "key"]))
    if rest.isEmpty():
        return None
    clusters = components(rest.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    clusters = clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    placed = written(rest.select("rep", "root", "n").distinct().join(clusters, "rep"))
    sizes = placed.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "root")).alias("main"),
        F.ceil(F.sum("n") / CELL).cast("int").alias("cells"))
    docs = (salted_join(placed, mains, ["cluster"]).join(sets, "rep").join(bands, "rep")
            .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
            .withColumn("all", F.sequence(F.lit(0), F.col("cells") - 1)))
    docs = written(docs)
    left = (docs.where("root <> main.root")
            .select("cluster", F.col("own").alias("i"), F.explode("all").alias("j"),
                    F.col("root").alias("ra"), F.col("n").alias("na"),
                    F.col("bands").alias("ba"), F.col("shingles").alias("sa")))
    right = docs.select("cluster", F.explode("all").alias("i"), F.col("own").alias("j"),
                        F.col("root").alias("rb"), F.col("n").alias("nb"),
                        F.col("bands").alias("bb"), F.col("shingles").alias("sb"))
    cells = [left[c] == right[c] for c in ("cluster", "i", "j")]
    fits = ((F.col("ra") != F.col("rb")) & _near_sizes(F.col("na"), F.col("nb"), percent)
            & F.arrays_overlap("ba", "bb") & _similar("sa", "sb", percent))
    return written(left.join(right, [*cells, fits])
                       .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own
    included; kept marks the rows whose component bears their own id."""
    ship_package(docs.sparkSession)
    sets = shingle_sets(docs, words, doc_id, text)
    signed = written(
        sets.withColumn("s", _signature("shingles"))
        .select("doc_id", F.size("shingles").cast("long").alias("n_shingles"), "s.set_key", "s.bands"))
    linked = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    # equal sets have equal bands, so a class is one group of the aggregate
    classes = written(linked.groupBy("set_key", "n_shingles", "bands")
                          .agg(F.min("doc_id").alias("rep")))
    placed = classes.select("rep", F.col("n_shingles").alias("n"),
                            F.posexplode("bands").alias("band", "key"))
    shared = placed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(salted_join(placed, shared, ["band", "key"]))
    ids = members.select("rep").distinct()
    few = ids.count() <= BROADCAST_IDS
    needed = written(sets.withColumnRenamed("doc_id", "rep")
                         .join(F.broadcast(ids) if few else ids, "rep", "left_semi")
                         .dropDuplicates(["rep"]))
    roots = components(written(star_links(members, needed, percent)))
    more = cluster_links(members, roots, needed, classes.select("rep", "bands"), percent)
    if more is not None and not more.isEmpty():
        # between components: their roots are the nodes now
        above = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        lone = above.join(roots, "root", "left_anti").select(F.col("root").alias("node"), "top")
        roots = (roots.join(above, "root", "left")
                 .select("node", F.coalesce("top", "root").alias("root"))
                 .union(lone.withColumnRenamed("top", "root")))
        roots = written(roots)
    homes = (classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .select("set_key", F.coalesce("root", "rep").alias("component")))
    homed = salted_join(signed.drop("bands"), homes, ["set_key"], how="left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return homed.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
