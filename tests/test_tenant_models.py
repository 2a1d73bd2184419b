"""Models of all tenants at once against one tenant at a time."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from mercato.operators import tenant_models as tm

FEATURES = ("a", "b", "c")
SCHEMA = "tenant_id string, customer_id long, a double, b double, c double, churned int"


@pytest.fixture(scope="module")
def customers():
    r = random.Random(6)
    rows, i = [], 0
    for tenant, n in (("small", 30), ("hot", 900), (None, 60), ("few", 9), ("one", 40)):
        for _ in range(n):
            a, b = r.gauss(3, 2), r.gauss(0, 100)
            churned = 1 if tenant == "one" else int(a + b / 50 + r.gauss(0, 2) > 3)
            if tenant != "few" and r.random() < .1:
                churned = None
            rows.append((tenant, i, None if r.random() < .05 else a, b, 7.0, churned))
            i += 1
    return rows


def _newton(x, y, steps=tm.STEPS):
    """Weights by plain Newton steps on standardised inputs."""
    x = np.nan_to_num(np.array(x, float))
    mean, spread = x.mean(axis=0), x.std(axis=0)
    z = np.where(spread > 0, (x - mean) / np.where(spread > 0, spread, 1), 0)
    z, y = np.hstack([np.ones((len(z), 1)), z]), np.array(y, float)
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    ridge = np.diag([1e-9] + [tm.RIDGE] * (z.shape[1] - 1))
    keep = np.diag([0.0] + [tm.RIDGE] * (z.shape[1] - 1))
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ beta))
        bend = (z * (w * p * (1 - p))[:, None]).T @ z + ridge
        beta = beta + np.linalg.solve(bend, z.T @ (w * (y - p)) - keep @ beta)
    return beta


def test_same_weights_as_alone(spark, customers):
    labelled = [r for r in customers if r[-1] is not None and r[0] in ("small", "hot", None)]
    got = tm.fit_tenants(spark.createDataFrame(labelled, SCHEMA), features=FEATURES).collect()
    assert {r["tenant_id"] for r in got} == {"small", "hot", None}
    for row in got:
        own = [r for r in labelled if r[0] == row["tenant_id"]]
        expected = _newton([r[2:5] for r in own], [r[-1] for r in own])
        assert np.allclose(row["weights"], expected, atol=1e-6)
        assert row["last_step"] < 1e-6 and row["training_rows"] == len(own)


def test_gate_split_scores_and_rejects(spark, customers):
    df = spark.createDataFrame(customers, SCHEMA)
    done = tm.train_tenants(df, features=FEATURES)
    status = {r["tenant_id"]: r["status"] for r in done.gate.collect()}
    assert status == {"small": tm.TRAINED, "hot": tm.TRAINED, None: tm.TRAINED,
                      "few": tm.TOO_FEW, "one": tm.ONE_CLASS}
    models = {r["tenant_id"]: r for r in done.models.collect()}
    assert set(models) == {"small", "hot", None} and models["hot"]["auc"] > 0.7
    assert {r["split"] for r in done.parts.where("tenant_id = 'small'").collect()} == \
        {"train", "validation", "test"}
    scored, rejected = tm.score_tenants(done.models, df, features=FEATURES)
    assert scored.count() + rejected.count() == len(customers)
    assert {r["tenant_id"] for r in rejected.select("tenant_id").distinct().collect()} == {"few", "one"}
    assert scored.where("churn_probability NOT BETWEEN 0 AND 1").count() == 0


def test_ten_labels_and_separable_labels_train(spark):
    rows = [("ten", i, float(i), 0.0, 1.0, int(i >= 9)) for i in range(10)]
    rows += [("clear", i, float(i), 0.0, 1.0, int(i >= 20)) for i in range(40)]
    done = tm.train_tenants(spark.createDataFrame(rows, SCHEMA), features=FEATURES)
    assert done.models.count() == 2
    assert done.models.where("last_step < 0.001").count() == 2
    none = tm.train_tenants(spark.createDataFrame([], SCHEMA), features=FEATURES)
    assert none.models.collect() == [] and none.gate.collect() == []


def test_two_trainings_at_once_make_two_versions(spark, customers, tmp_path):
    done = tm.train_tenants(spark.createDataFrame(customers, SCHEMA), features=FEATURES)
    with ThreadPoolExecutor(2) as pool:
        runs = set(pool.map(lambda _: tm.save_models(done, str(tmp_path)), range(2)))
    log = tm.model_log(spark, str(tmp_path))
    assert len(runs) == 2
    for tenant in ("small", "hot"):
        own = log.where(log["tenant_id"] == tenant).collect()
        assert sorted(r["version"] for r in own) == [1, 2]
        assert [r["version"] for r in own if r["is_active"]] == [2]
