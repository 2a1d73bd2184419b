"""Training-corpus pipeline: quality, toxicity, near-duplicates, benchmark
decontamination, byte-pair tokens.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's
docs.  All but the last return the columns of ``documents``, whatever they
are; the last adds the token ids.

Rows without a doc_id can't be told apart by it: the scoring stages judge
them like any other, near-dedup keeps them, and decontamination drops them
only if some document without an id holds a benchmark item.  Repeated rows
(same id, same text) are one document: near-dedup keeps one of them; rows that
share only their id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import bpe, decontaminate, neardup, quality, toxicity
from mercato.llm.queries import rank_codec
from mercato.llm.text import free_name, written
from mercato.session import scratch_path
from mercato.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules don't reject."""
    score = free_name(docs, "__score")
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) >= quality.KEEP_FROM).drop(score)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic."""
    score = free_name(docs, "__score")
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) < toxicity.TOXIC_FROM).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words,
    similarity 0.8): that of the smallest id.  Rows that share an id and a
    text are one document; rows that share an id but not the text are
    documents of their own, which stand behind those whose id is theirs alone
    (before them where ids reach 2^61 and leave no room above)."""
    key = free_name(docs, "__key")
    often = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"))
    often = written(often.where("rows > 1").select("doc_id"))
    if often.isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        again = (docs.join(often, "doc_id", "left_semi").groupBy("doc_id", "text")
                 .agg(F.min(F.struct(F.lit(0), *rest)).alias("row"))
                 .select("doc_id", "text", *[F.col("row")[c].alias(c) for c in rest]))
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        number = F.monotonically_increasing_id()
        own = number + (high + 1) if high < 1 << 61 else F.lit(low - 1) - number
        again = written(again.withColumn(key, own))
        once = docs.join(often, "doc_id", "left_anti").withColumn(key, F.col("doc_id"))
        keyed = once.unionByName(again)
    found = neardup.near_duplicates(keyed, doc_id=key)
    dropped = found.where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(dropped, key, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    ids = found.select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__held"]), "left_anti")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and number; ``exact`` says that the
    ids decode to the text."""
    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    coded = bpe.encoded(docs, rank_codec(spark), ids=ids, decoded=decoded)
    same = F.col(decoded) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return (coded.withColumn(free_name(docs, "n_tokens"), F.size(ids).cast("long"))
            .withColumn(free_name(docs, "exact"), same).drop(decoded))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

# The classifiers and the tokenizer are beyond SQL; tests hold the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
