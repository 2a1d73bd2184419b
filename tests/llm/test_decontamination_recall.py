"""Items whose last words are replaced or cut off, as far as 0.8 allows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mercato.llm import decontaminate


def test_all_similar_windows_pass_the_multi_index(spark):
    r = random.Random(17)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
             for _ in range(3000)]
    items, docs = [], []
    for i in range(200):
        n = r.randint(15, 59)
        item = [r.choice(words) for _ in range(n)]
        items.append((i, " ".join(item)))
        grams = n - 4
        gone = max(c for c in range(n) if 10 * (grams - c) >= 8 * (grams + c))
        docs.append((2 * i, " ".join(item[:n - gone] + [f"new{i}x{j}" for j in range(gone)])))
        cut = max(c for c in range(n) if 10 * (grams - c) >= 8 * grams)
        docs.append((2 * i + 1, " ".join(item[:n - cut])))
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"))
    assert found.where(F.floor(F.col("doc_id") / 2) == F.col("item_id")).count() == len(docs)
