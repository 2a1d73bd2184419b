"""Document quality by a sparse rule ensemble over text statistics.

A small forest is grown on the statistics of labelled documents; every path
from a root to one of its nodes is a rule, a conjunction of comparisons.  A
lasso logistic regression on the 0/1 values of the rules keeps the few that
matter, and those become one column expression of Spark, which scores any
number of documents without leaving the query.

Learning reads at most ``SAMPLE`` labelled documents (the bound of the
classifier's sample, chosen by a hash of the id); scoring reads every whole
text.  Empty and null texts have statistics of 0 and get a score as well.
Without labels of both kinds the score is the share of 1 among the labels,
and 1 (keep) without any label.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.text import free_name, labelled_sample, whole
from mercato.session import materialize

SAMPLE = 20_000
FIT_TASKS = 8
TREES = 12
DEPTH = 3
LASSO = 0.0005
SEED = 17
KEEP_FROM = 0.3

SYMBOLS = "#$%&*+/<=>@[]^_{|}~"
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def statistics(df: DataFrame, text: str, prefix: str = "") -> tuple[DataFrame, list[str]]:
    """``df`` with one column for each statistic of ``text``, and their
    names, which begin with ``prefix`` and avoid the columns that exist."""
    t = whole(text)
    words, lines = free_name(df, f"{prefix}words"), free_name(df, f"{prefix}lines")
    df = df.withColumns({words: F.filter(F.split(t, "\\s+"), lambda w: w != ""),
                         lines: F.filter(F.split(t, "\n"), lambda x: x != "")})
    n = F.length(t)
    n_words, n_lines = F.size(words), F.size(lines)

    def share(part: Column, of: Column) -> Column:
        return F.when(of > 0, part / of).otherwise(F.lit(0.0))

    def of_chars(letters: str) -> Column:
        return share(n - F.length(F.translate(t, letters, "")), n)

    values = {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(n, n_words),
        "upper": of_chars(UPPER),
        "symbols": of_chars(SYMBOLS),
        "bangs": of_chars("!?"),
        "digits": of_chars(DIGITS),
        "stops": of_chars(".,;:"),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "words_per_line": share(n_words, n_lines),
    }
    names = {free_name(df, prefix + k): v.cast("double") for k, v in values.items()}
    return df.withColumns(names).drop(words, lines), list(names)


Rule = tuple[tuple[int, str, float], ...]


def tree_rules(node, path: Rule = ()) -> list[Rule]:
    """The paths to all nodes below ``node`` as conjunctions of (feature,
    comparison, threshold)."""
    if "Leaf" in node.getClass().getSimpleName():
        return [path] if path else []
    split = node.split()
    at, cut = split.featureIndex(), split.threshold()
    return (([path] if path else [])
            + tree_rules(node.leftChild(), (*path, (at, "<=", cut)))
            + tree_rules(node.rightChild(), (*path, (at, ">", cut))))


def rule_column(rule: Rule, names: list[str]) -> Column:
    out = F.lit(True)
    for at, sign, cut in rule:
        value = F.col(names[at])
        out = out & ((value <= cut) if sign == "<=" else (value > cut))
    return out


class RuleEnsemble:
    """Weighted rules; ``score`` compiles them into one column."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        kept = [(r, w) for r, w in zip(rules, weights) if w]
        self.rules, self.weights = [r for r, _ in kept], [w for _, w in kept]
        self.intercept = intercept

    def score(self, names: list[str]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule_column(rule, names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(sample: DataFrame) -> RuleEnsemble:
    """Rules and weights from (text, label)."""
    data, names = statistics(sample.select("text", "label"), "text")
    # the statistics of a bounded sample are a few numbers a row: the many
    # short steps of the fit need no more tasks than this
    data = materialize(materialize(data.drop("text")).coalesce(FIT_TASKS))
    n, ones = data.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or ones in (0, n):
        share = 1.0 if n == 0 else ones / n
        return RuleEnsemble([], [], math.log((share * n + 1) / ((1 - share) * n + 1)) if n else 40.0)
    assembled = VectorAssembler(inputCols=names, outputCol="x").transform(data)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES,
                                    maxDepth=DEPTH, seed=SEED).fit(assembled)
    rules = list(dict.fromkeys(r for tree in forest.trees
                               for r in tree_rules(tree._java_obj.rootNode())))
    if not rules:
        return RuleEnsemble([], [], math.log(ones / (n - ones)))
    flags = data.select("label", *[rule_column(r, names).cast("double").alias(f"r{i}")
                                   for i, r in enumerate(rules)])
    vectors = VectorAssembler(inputCols=flags.columns[1:], outputCol="x").transform(flags)
    model = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0,
                               regParam=LASSO, maxIter=40).fit(vectors.select("x", "label"))
    return RuleEnsemble(rules, model.coefficients.toArray().tolist(), float(model.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame, out: str = "score", text: str = "text",
                   doc_id: str = "doc_id", label: str = "quality",
                   sample: int = SAMPLE) -> DataFrame:
    """``docs`` with the score of its texts in the new column ``out``."""
    model = fit(labelled_sample(docs, labels, label, sample, doc_id, text))
    scored, names = statistics(docs, text, "__")
    return scored.withColumn(out, model.score(names)).drop(*names)
