"""Workflows of a domain as one call: figures of a target, groups, anomalies, a model.

A report is long: section, name, value, one row for each figure, so that reports of
any table can be stored and compared alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import answers, evaluate, learning, profile, relate
from ..operators.query import nan_free, q

REPORT = "section string, name string, value double"


def _rows(frame: DataFrame, section: str, **named: Column) -> DataFrame:
    """A row of the report for each named figure of a one-row frame."""
    cells = F.array(*(F.struct(F.lit(section).alias("section"), F.lit(k).alias("name"), F.round(v.cast("double"), 4).alias("value")) for k, v in named.items()))
    return frame.select(F.explode(cells).alias("r")).select("r.*")


def _figures(df: DataFrame, target: str) -> DataFrame:
    s = profile.plain_descriptives(df, [target]).crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))
    return _rows(s, "statistics", rows=F.col("rows"), mean=F.col("mean"), std=F.col("std"), min=F.col("min"), max=F.col("max"), total=F.col("sum"))


def _anomalies(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows each rule, a condition in SQL, names; rules without any are left out."""
    s = df.agg(*(F.count_if(F.expr(rule)).alias(name) for name, rule in rules.items()))
    return _rows(s, "anomalies", **{name: F.col(name) for name in rules}).where("value > 0")


@nan_free
def demand(df: DataFrame, target: str, features: Sequence[str], regime: str, keys: Sequence[str], rules: dict[str, str], folds: int = 3, alpha: float = 1.0) -> DataFrame:
    """The report of a quantity over time: its figures, its means by regime, anomalies, and
    the mean errors of a ridge model over expanding folds in the order of ``keys``."""
    by = learning.regimes(df, regime, target).select(F.lit("regimes").alias("section"), F.coalesce(q(regime).cast("string"), F.lit("")).alias("name"), F.round("mean", 4).alias("value"))
    errors = learning.ridge_over_time(df.withColumn("_whole", F.lit(0)), target, features, "_whole", keys, folds, alpha)
    found = errors.agg(*(F.avg(m).alias(m) for m in ("mae", "rmse", "r2")), F.count("*").alias("folds"))
    model = _rows(found, "evaluation", folds=F.col("folds"), mae=F.col("mae"), rmse=F.col("rmse"), r2=F.col("r2"))
    return reduce(DataFrame.unionByName, [_figures(df, target), by, _anomalies(df, rules), model])


@nan_free
def productivity(df: DataFrame, target: str, features: Sequence[str], key: str, rules: dict[str, str], trees: int = 100, depth: int = 6, folds: int = 5, seed: int = 42) -> DataFrame:
    """The report of a process: figures of its target, the features that go with it most
    and least, anomalies, and the errors of a random forest over hashed folds."""
    ends = relate.target_correlations(df, target, list(features))
    named = ends.select(F.lit("correlations").alias("section"), F.col("feature").alias("name"), F.round("r", 4).alias("value"))
    family = learning.FAMILIES["RandomForest"](featuresCol=learning.FEATURES, labelCol="_label", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    rows = learning.hashed_folds(df.where(q(target).isNotNull()), key, folds, "_fold").select(q(target).cast("double").alias("_label"), "_fold", *(q(f).cast("double").alias(f) for f in features))
    scored = learning.scored_over_folds(learning.prepared(rows, features), family, folds)
    e = evaluate.fold_metrics(scored, "_label", "prediction", "_fold")
    model = _rows(e, "evaluation", folds=F.col("folds"), mae=F.col("mae_mean"), rmse=F.col("rmse_mean"), r2=F.col("r2_mean"), r2_std=F.col("r2_std"))
    return reduce(DataFrame.unionByName, [_figures(df, target), named, _anomalies(df, rules), model])


def explained_predictions(df: DataFrame, key: str, score, features: dict, training: DataFrame, training_key: str, passages: DataFrame, target: str, top_n: int = 3) -> DataFrame:
    """``learning.calculate`` of every row with question, state, answer and sources: what the
    passages say of the target at the row's features that are furthest from the middle of
    their range.  Rows that aren't valid aren't asked about."""
    done = learning.calculate(df, key, score, features, training, training_key)
    kinds, ranged = dict(df.dtypes), {c: r for c, r in features.items() if r}
    value = lambda c: q(c).try_cast("double") if kinds[c] == "string" else q(c).cast("double")
    off = F.array(*(F.struct(F.abs(value(c) * 2 - (r[0] + r[1])).alias("d"), F.lit(c.replace("_", " ")).alias("c")) for c, r in ranged.items()))
    most = F.transform(F.slice(F.reverse(F.sort_array(off)), 1, 2), lambda x: x["c"])
    question = F.concat(F.lit(f"Explain {target.replace('_', ' ')} and the effect of "), F.array_join(most, " and "))
    asked = done.where("valid").select(q(key), question.alias("question"))
    told = answers.answer_all(asked, passages, key, "question", top_n).join(asked, key)
    return done.join(told, key, "left")
