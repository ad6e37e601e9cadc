"""What the driver holds: no learning runs in it, and plans that are run again and again stay small."""

import re

import numpy as np
import pytest

from lodestone.llm import bytecnn, centroids, components
from lodestone.llm.common import Workspace

from .conftest import SMALL


def refuse(*args, **kwargs):
    raise AssertionError("learning runs in the driver")


def test_models_are_learned_in_a_task(spark, monkeypatch):
    documents, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(bytecnn.ByteNet, "fit", refuse)  # workers import the module anew
    monkeypatch.setattr(centroids.Centroids, "fit", refuse)
    net, model = bytecnn.train(documents, labels), centroids.train(documents)
    assert (net.table != bytecnn.ByteNet().table).any() and net.base != 0
    assert len(set(model.langs)) == documents.select("lang").distinct().count() and len(model.matrix) == len(model.langs)


def test_learning_from_nothing(spark, nothing):
    documents, labels = (spark.read.parquet(f"{nothing}/{t}.parquet") for t in ("documents", "labels"))
    assert bytecnn.train(documents, labels).score(np.frombuffer(b"text", np.uint8)) == pytest.approx(0.5)
    assert centroids.train(documents).predict(b"text") == (centroids.UNKNOWN, 0.0, True)


def test_rounds_of_components_have_small_plans(spark):
    plans = []

    class Seen(Workspace):
        def table(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().table(df, name)

    found = components.connected_components(spark.range(1, 60).selectExpr("id AS u", "id - 1 AS v"), Seen(spark, "t")).collect()
    assert {r.component for r in found} == {0} and {r.node for r in found} == set(range(60))
    assert len(plans) > 2 and max(len(re.findall(r"\bExchange ", p)) for p in plans) <= 10
