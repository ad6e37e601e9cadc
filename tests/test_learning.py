"""Folds, linear models, searches, scoring and workflows against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import learning
from lodestone.plans import workflows


def plain_ridge(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    b = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return my - b @ mx, b


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g, n in (("a", 60), ("b", 41), ("c", 3), (None, 20)):
        x = rng.normal(size=(n, 3))
        y = x @ [2.0, -1.0, 0.5] + 3 + rng.normal(size=n) * 0.1
        rows += [(g, k, *map(float, x[k]), float(y[k])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "g string, t int, x1 double, x2 double, x3 double, y double").repartition(5)


def folds_of(n, folds):
    size = n // (folds + 1)
    return [max(0, folds - (n - 1 - k) // size) for k in range(n)]


def test_grouped_time_folds(series):
    rows, df = series
    found = {(r.g, r.t): r.fold for r in learning.grouped_time_folds(df, "g", ["t"], 3).collect()}
    wanted = {(g, k): f for g, n in (("a", 60), ("b", 41), (None, 20)) for k, f in enumerate(folds_of(n, 3))}
    assert found == wanted  # "c" has too few rows


def test_ridge_over_time_equals_numpy(series):
    rows, df = series
    found = learning.ridge_over_time(df, "y", ["x1", "x2", "x3"], "g", ["t"], 3, 0.7).collect()
    assert len(found) == 9
    for r in found:
        own = sorted(x for x in rows if x[0] == r.g)
        fold = np.array(folds_of(len(own), 3))
        x, y = np.array([o[2:5] for o in own]), np.array([o[5] for o in own])
        a, b = plain_ridge(x[fold < r.fold], y[fold < r.fold], 0.7)
        e = y[fold == r.fold] - (a + x[fold == r.fold] @ b)
        assert r.n == (fold < r.fold).sum() and r.tested == (fold == r.fold).sum()
        assert [r.intercept, *r.coefficients] == pytest.approx([a, *b])
        assert (r.mae, r.rmse, r.r2) == pytest.approx((abs(e).mean(), (e**2).mean() ** 0.5, 1 - (e**2).mean() / y[fold == r.fold].var()))


def test_ridge_of_dependent_columns_and_of_nothing(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k, 3.0 * k) for k in range(10)], "x double, z double, y double")
    row = learning.ridge(learning.moments(df, "y", ["x", "z"]), 0.0).head()
    assert row.coefficients[0] + 2 * row.coefficients[1] == pytest.approx(3) and row.intercept == pytest.approx(0, abs=1e-9)
    assert learning.ridge(learning.moments(df.limit(0), "y", ["x", "z"])).head().coefficients is None


def test_hashed_folds_keep_rows_of_a_key_together(spark):
    df = spark.range(200).withColumn("k", F.col("id") % 50)
    found = learning.hashed_folds(df, "k", 4).collect()
    assert {r.k: r.fold for r in found} == {k: int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 4 for k in range(50)}
    assert all(r.fold == {x.k: x.fold for x in found}[r.k] for r in found)


def test_settings_differ_and_follow_the_seed():
    space = {"a": (1, 2, 3), "b": ("x", "y")}
    one = learning.drawn(space, 4, 9)
    assert one == learning.drawn(space, 4, 9) and len({tuple(s.items()) for s in one}) == 4
    assert len(learning.drawn(space, 99, 9)) == 6


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(240, 2))
    y = np.where(x[:, 0] > 0.5, 10.0, 0.0) + x[:, 1]
    rows = [(k, float(a), float(b) if k % 20 else None, float(c) if k % 30 else None) for k, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    space = {"RandomForest": {"numTrees": (3, 6), "maxDepth": (2, 4)}, "GBT": {"maxIter": (2, 3), "maxDepth": (2,)}}
    args = dict(draws=2, tune_folds=2, folds=2, seed=5)
    return df, space, args, learning.train(df, ["y"], ["a", "b"], "k", space, **args)


def test_search_finds_a_model_and_its_seed_finds_it_again(trained, tmp_path):
    df, space, args, first = trained
    rows = first.results.orderBy("model").collect()
    assert [r.model for r in rows] == ["GBT", "RandomForest"] and all(r.rmse < 4 and r.r2 > 0.4 for r in rows)
    again = learning.train(df, ["y"], ["a", "b"], "k", {"RandomForest": space["RandomForest"]}, **args)
    assert again.results.head() == rows[1]
    first.save(str(tmp_path / "models"))
    best = learning.load_best(str(tmp_path / "models"), "y")
    name = first.best().head().model
    ask = df.na.drop().select("k", "a", "b")
    score = lambda m: [round(r.prediction, 9) for r in m.transform(ask).orderBy("k").collect()]
    assert score(best) == score(first.models["y", name])


def test_scoring_answers_for_every_row(spark, trained):
    model = trained[3].models["y", "RandomForest"]
    rows = [(1, "0.9", 0.5), (2, "n/a", 0.5), (3, None, 0.5), (4, "0.1", float("inf")), (5, "0.1", None), (6, "7", 0.2), (7, " 0.2 ", float("nan"))]
    df = spark.createDataFrame(rows, "k int, a string, b double")
    found = {r.k: r for r in learning.predict(df, learning.by_model(model), {"a": (0.0, 1.0), "b": None}).collect()}
    assert {k: r.valid for k, r in found.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}
    assert found[1].prediction > 5 and all((r.prediction is None) != r.valid for r in found.values())
    assert found[2].issue == "Invalid values: a" and found[3].issue == "Missing values: a" and found[4].issue == "Invalid values: b" and found[5].issue == "Missing values: b"
    assert found[6].warnings == ["'a' is outside [0, 1]"] and found[1].warnings == [] and found[2].a == "n/a"


def test_lines_by_group(spark):
    df = spark.createDataFrame([("a", float(k), 2.0 * k + 1) for k in range(20)] + [(None, float(k), -1.0 * k) for k in range(20)], "g string, x double, y double")
    models = learning.ridge(learning.moments(df, "y", ["x"], "g"), 1e-9)
    asked = spark.createDataFrame([("a", 3.0), (None, 3.0), ("z", 3.0)], "g string, x double")
    found = {r.g: r.prediction for r in learning.predict(asked, learning.by_line(models, ["x"], ["g"]), {"x": None}).collect()}
    assert found["a"] == pytest.approx(7) and found[None] == pytest.approx(-3) and found["z"] is None


def test_workflow_of_a_forest(spark, trained):
    found = {(r.section, r.name): r.value for r in workflows.productivity(trained[0], "y", ["a", "b"], "k", {"low": "a < 0.1", "none": "a < 0"}, trees=5, depth=3, folds=3).collect()}
    assert found["statistics", "rows"] == 240 and found["evaluation", "folds"] == 3 and found["evaluation", "r2"] > 0.5
    assert found["correlations", "a"] > 0.7 and ("anomalies", "low") in found and ("anomalies", "none") not in found


def shuffled_rows(spark):
    """How many rows all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_ridge_over_time_moves_rows_once(spark):
    df = spark.range(20_000).selectExpr("id % 40 AS g", "id AS t", "CAST(id % 7 AS double) AS x", "CAST(id % 13 AS double) AS y")
    before = shuffled_rows(spark)
    assert len(learning.ridge_over_time(df, "y", ["x"], "g", ["t"]).collect()) == 120
    assert 20_000 <= shuffled_rows(spark) - before < 30_000


def test_folds_of_large_groups(spark, series, monkeypatch):
    rows, df = series
    models = lambda: sorted(map(str, learning.ridge_over_time(df, "y", ["x1", "x2", "x3"], "g", ["t"]).select("g", "fold", "n", "tested").collect()))
    plain = models()
    monkeypatch.setattr(learning, "PLAIN_ROWS", 5)
    parted, cells = learning._parted(df, "g", ["t"], 3, "fold")
    assert cells.count() > cells.select("_g").distinct().count() == 3  # dealt out by their keys
    assert {(r.g, r.t): r.fold for r in parted.collect()} == {(g, k): f for g, n in (("a", 60), ("b", 41), (None, 20)) for k, f in enumerate(folds_of(n, 3))}
    assert models() == plain
    tied = df.withColumn("t", (F.col("t") / 8).cast("int"))  # ties count as the last of them
    wanted = {("a", k // 8): max(0, 3 - (60 - min(60, (k // 8 + 1) * 8)) // 15) for k in range(60)}
    assert {(r.g, r.t): r.fold for r in learning.grouped_time_folds(tied, "g", ["t"]).collect() if r.g == "a"} == wanted
