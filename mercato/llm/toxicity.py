"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and the prefixes of its longer words, each
hashed to one of ``FEATURES`` places, with the number of distinct words there.  The ``SELECTED``
places that go most with either label (chi-square over the sample) take
part.  Beside a weight of its own, every such place has a vector of
``FACTORS`` numbers; the products of the vectors of two present terms add
what the pair means beyond its parts, which linear weights miss.

The machine learns from at most ``SAMPLE`` labelled documents (the bound of
the classifier's sample, chosen by a hash of the id; the rarer label is
weighted up by repetition); its size is that of ``SELECTED``, never of the data.  Scoring reads every whole text inside Spark.  Empty and
null texts have no terms and score by the intercept.  Without labels of both
kinds the score is the label that there is, and 0 without any.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.text import free_name, labelled_sample, plain_words, whole
from mercato.session import materialize

SAMPLE = 20_000
FEATURES = 1 << 18
SELECTED = 256
LEAST_SEEN = 3
FACTORS = 4
ROUNDS = 50
STEP = 0.05
SHRINK = 1e-3
PREFIX = 5
SEED = 23
TOXIC_FROM = 0.5


def places(text: Column) -> Column:
    """The places of the terms of a text: one for each distinct word, and one
    for the prefix of each distinct longer word."""
    words = F.array_distinct(plain_words(text))
    own = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)))
    stems = F.transform(F.filter(words, lambda w: F.length(w) > PREFIX),
                        lambda w: F.pmod(F.xxhash64(F.lit("^"), F.substring(w, 1, PREFIX)),
                                         F.lit(FEATURES)))
    return F.concat(own, stems)


def telling(data: DataFrame, n: int, ones: float) -> list[int]:
    """The ``SELECTED`` places whose presence goes most with either label,
    by chi-square (``data``: places, label)."""
    seen = (data.select("label", F.explode(F.array_distinct("places")).alias("place")).groupBy("place")
            .agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
            .where(F.col("n") >= LEAST_SEEN))
    a, b = F.col("ones"), F.col("n") - F.col("ones")
    c, d = F.lit(ones) - a, F.lit(n - ones) - b
    chi = (a * d - b * c) ** 2 / (F.col("n") * (F.lit(n) - F.col("n") + 1))
    return [r.place for r in seen.orderBy(chi.desc(), "place").limit(SELECTED)
            .select("place").collect()]


class Machine:
    """A fitted machine, or a constant where there was nothing to tell apart."""

    def __init__(self, vectors=None, model=None, constant: float = 0.0):
        self.vectors, self.model, self.constant = vectors, model, constant

    def score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.lit(self.constant))
        listed, x, raw, prob, label = (free_name(df, f"__{c}")
                                       for c in ("terms", "x", "raw", "prob", "label"))
        found = df.withColumn(listed, places(whole(text)).cast("array<string>"))
        vectors = self.vectors.copy().setInputCol(listed).setOutputCol(x)
        model = (self.model.setFeaturesCol(x).setRawPredictionCol(raw).setProbabilityCol(prob)
                 .setPredictionCol(label))
        scored = model.transform(vectors.transform(found))
        return scored.withColumn(out, vector_to_array(prob)[1]).drop(listed, x, raw, prob, label)


def fit(sample: DataFrame) -> Machine:
    data = materialize(sample.select(places(F.col("text")).alias("places"), "label"))
    n, ones = data.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or ones in (0, n):
        return Machine(constant=1.0 if n and ones == n else 0.0)
    chosen = telling(data, n, ones)
    if not chosen:
        return Machine(constant=ones / n)
    listed = data.select("label", F.col("places").cast("array<string>").alias("terms"))
    vectors = CountVectorizerModel.from_vocabulary([str(p) for p in chosen], inputCol="terms",
                                                   outputCol="x")
    rare = 1.0 if ones * 2 <= n else 0.0
    times = max(1, int(max(ones, n - ones) // min(ones, n - ones)) // 2)
    even = vectors.transform(listed).select("x", "label", F.explode(F.sequence(
        F.lit(1), F.when(F.col("label") == rare, times).otherwise(1)))).drop("col")
    learner = FMClassifier(featuresCol="x", labelCol="label", factorSize=FACTORS, maxIter=ROUNDS,
                           stepSize=STEP, regParam=SHRINK, initStd=0.01, seed=SEED)
    return Machine(vectors, learner.fit(materialize(even.coalesce(8))))


def toxicity_scores(docs: DataFrame, labels: DataFrame, out: str = "score", text: str = "text",
                    doc_id: str = "doc_id", label: str = "toxic",
                    sample: int = SAMPLE) -> DataFrame:
    """``docs`` with the score of its texts in the new column ``out``."""
    model = fit(labelled_sample(docs, labels, label, sample, doc_id, text))
    return model.score(docs, text, out)
