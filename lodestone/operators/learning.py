"""Models over tables: linear models from sufficient statistics, searches over tree
ensembles, and scoring that answers for every row.

A linear model needs one pass: sums and products of its columns by part, added up before
the shuffle.  Models of many groups and folds come from one small row each; only these
rows meet numpy, in tasks.  Trees are those of ``pyspark.ml``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import evaluate, order, retrieval
from .query import nan_free, q

# --- folds ----------------------------------------------------------------------


def hashed_folds(df: DataFrame, key: str, folds: int = 5, name: str = "fold") -> DataFrame:
    """``df`` with a fold from 0 for each row, the same in every run: by the MD5 of its
    key, so that rows of one key share a fold."""
    digest = F.conv(F.substring(F.md5(q(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn(name, (F.coalesce(digest, F.lit(0)) % folds).cast("int"))


#: Groups of at most so many rows are no burden for one task.
PLAIN_ROWS = 100_000


def _parted(df: DataFrame, by: str, keys: Sequence[str], folds: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``name`` (see ``grouped_time_folds``), ``_g`` (a struct of the group's
    value, which null values have too) and ``_range``, dealt out by these two; and the
    ``_g`` and ``_range`` of groups with several ranges (others: range 0)."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(q(by).alias("by"))
    sizes = df.groupBy(group.alias("_g")).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    large = sizes.crossJoin(F.broadcast(total)).where((F.col("_n") > PLAIN_ROWS) & (F.col("_n") * ranges > F.col("_all"))).select("_g", F.lit(True).alias("_large"))
    marked = df.withColumn("_g", group).join(F.broadcast(large), "_g", "left")
    placed = order.in_ranges(marked.withColumn("_place", F.when(F.col("_large"), F.struct(q(by), *map(q, keys)))), "_place", repeated=True)

    # Large groups, fewer than there are ranges: what the ranges before hold, and the whole.
    own = Window.partitionBy("_g")
    cells = placed.where("_large").groupBy("_g", "_range").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(own.orderBy("_range")) - F.col("_k")
    cells = cells.select("_g", "_range", before.alias("_before"), F.sum("_k").over(own).alias("_n"))

    here = Window.partitionBy("_g", "_range").orderBy(*map(q, keys))
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = placed.select("_g", "_range", *map(q, df.columns), F.count("*").over(here).alias("_upto"), F.count("*").over(whole).alias("_own"))
    ranked = ranked.join(F.broadcast(cells), ["_g", "_range"], "left")
    n = F.coalesce("_n", "_own")
    later = F.floor((n - F.coalesce("_before", F.lit(0)) - F.col("_upto")) / F.floor(n / (folds + 1)))
    return ranked.where(n > folds).select("_g", "_range", *map(q, df.columns), F.greatest(F.lit(0), folds - later).cast("int").alias(name)), cells.select("_g", "_range")


def grouped_time_folds(df: DataFrame, by: str, keys: Sequence[str], folds: int = 3, name: str = "fold") -> DataFrame:
    """``df`` with the fold of each row within its group: fold f tests the f-th of
    ``folds`` last equal parts in the order of ``keys``, 0 is only ever trained on;
    rows that ``keys`` don't tell apart count as the last of them.

    Rows move once.  Groups are ranked in the task that they are dealt to; one that is
    more than such a task's share, and than ``PLAIN_ROWS``, is dealt out by ranges of its
    keys, so it is no task's.  Groups with fewer rows than ``folds`` + 1 have no folds and
    go."""
    return _parted(df, by, keys, folds, name)[0].drop("_g", "_range")


# --- linear models ----------------------------------------------------------------


@nan_free
def moments(df: DataFrame, target: str, features: Sequence[str], *parts: str) -> DataFrame:
    """parts, n, sums and products: what a linear model of the target needs to know of
    each part, from complete rows.  Products are the upper triangle, target last."""
    columns = [q(c).cast("double") for c in (*features, target)]
    complete = df.where(sum((c.isNull().cast("int") for c in columns), F.lit(0)) == 0)
    k = range(len(columns))
    return complete.groupBy(*map(q, parts)).agg(
        F.count("*").alias("n"), F.array(*(F.sum(c) for c in columns)).alias("sums"), F.array(*(F.sum(columns[i] * columns[j]) for i in k for j in k if i <= j)).alias("products"),
    )


def before_folds(found: DataFrame, by: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    """Moments of all folds before each fold, that is what it is trained on; a row for
    each group and fold is all that moves."""
    folds = F.sort_array(F.collect_list(F.struct(q(fold), "n", "sums", "products")))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def upto(all_: Column, f: Column) -> Column:
        earlier = F.filter(all_, lambda x: x[fold] < f)
        start = F.get(earlier, F.lit(0))
        return F.aggregate(F.slice(earlier, 2, F.greatest(F.lit(0), F.size(earlier) - 1)), F.struct(start["n"].alias("n"), start["sums"].alias("sums"), start["products"].alias("products")), lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), add(a["sums"], x["sums"]).alias("sums"), add(a["products"], x["products"]).alias("products")))

    grouped = found.groupBy(*map(q, by)).agg(folds.alias("_all"))
    each = grouped.select(*map(q, by), "_all", F.explode("_all").alias("_f"))
    return each.select(*map(q, by), F.col("_f").getField(fold).alias(fold), upto(F.col("_all"), F.col("_f").getField(fold)).alias("_u")).where("_u.n is not null").select(*map(q, by), q(fold), "_u.n", "_u.sums", "_u.products")


def ridge(found: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``found`` (of ``moments``) with intercept and coefficients of the least squares with
    a penalty of ``alpha`` on the coefficients, not on the intercept.  Null where there
    are no rows; without a penalty and where columns depend on each other, the shortest
    solution."""
    keep = [f for f in found.schema if f.name not in ("sums", "products")]
    schema = T.StructType([*keep, T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            solved = [_solved(*row, alpha) for row in zip(frame["n"], frame["sums"], frame["products"])]
            out = frame.drop(columns=["sums", "products"])
            yield out.assign(intercept=[a for a, _ in solved], coefficients=[b for _, b in solved])

    return found.mapInPandas(solve, schema)


def _solved(n: int, sums: np.ndarray, products: np.ndarray, alpha: float) -> tuple[float | None, list[float] | None]:
    if not n:
        return None, None
    k = len(sums)
    table = np.zeros((k, k))
    table[np.triu_indices(k)] = products
    means = np.asarray(sums) / n
    centred = table[:-1, :-1] + np.triu(table[:-1, :-1], 1).T - n * np.outer(means[:-1], means[:-1])
    along = table[:-1, -1] - n * means[:-1] * means[-1]
    b = np.linalg.lstsq(centred + alpha * np.eye(k - 1), along, rcond=None)[0]
    return float(means[-1] - b @ means[:-1]), b.tolist()


def linear_score(features: Sequence[str]) -> Column:
    """intercept + coefficients . features; null where a feature is."""
    terms = F.zip_with("coefficients", F.array(*(q(f).cast("double") for f in features)), lambda b, x: b * x)
    return F.aggregate(terms, F.col("intercept"), lambda a, x: a + x)


@nan_free
def ridge_over_time(df: DataFrame, target: str, features: Sequence[str], by: str, keys: Sequence[str], folds: int = 3, alpha: float = 1.0) -> DataFrame:
    """by, fold, n (rows trained on), intercept, coefficients, tested, mae, rmse, r2: for
    every group and fold a model of the folds before it, and its errors on the fold.
    A group's models come to where its rows are, which move once for both passes."""
    parted, cells = _parted(df, by, keys, folds, "fold")
    models = ridge(before_folds(moments(parted, target, features, by, "fold"), [by]), alpha)
    lines = models.groupBy(F.struct(q(by).alias("by")).alias("_g")).agg(F.map_from_entries(F.collect_list(F.struct("fold", F.struct("intercept", "coefficients")))).alias("_lines"))
    lines = lines.join(F.broadcast(cells), "_g", "left").select("_g", F.coalesce("_range", F.lit(0)).alias("_range"), "_lines")
    met = parted.join(lines, ["_g", "_range"]).withColumn("_line", F.try_element_at("_lines", F.col("fold")))
    scored = met.select(q(by), "fold", *(q(c) for c in dict.fromkeys((target, *features)) if c not in (by, "fold")), "_line.intercept", "_line.coefficients")
    scored = scored.select(q(by), "fold", q(target).cast("double").alias("_truth"), linear_score(features).alias("_guess")).where("_truth is not null and _guess is not null")
    e = F.col("_truth") - F.col("_guess")
    errors = scored.groupBy(q(by).alias("_by"), F.col("fold").alias("_fold")).agg(F.count("*").alias("tested"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.nullif(F.var_pop("_truth"), F.lit(0.0)))).alias("r2"))
    return models.join(errors, q(by).eqNullSafe(F.col("_by")) & (F.col("fold") == F.col("_fold"))).drop("_by", "_fold")


# --- tree ensembles ---------------------------------------------------------------

#: Families and what a search draws from.
SPACE = {
    "RandomForest": {"numTrees": (100, 200, 300, 400, 500), "maxDepth": (5, 10, 15, 20), "minInstancesPerNode": (1, 2, 4), "featureSubsetStrategy": ("sqrt", "log2", "all")},
    "GBT": {"maxIter": (100, 200, 300, 400), "maxDepth": (3, 5, 7, 9), "stepSize": (0.01, 0.05, 0.1, 0.2), "subsamplingRate": (0.7, 0.8, 0.9)},
}
FAMILIES = {"RandomForest": RandomForestRegressor, "GBT": GBTRegressor}
FEATURES = "_features"


def drawn(space: Mapping[str, Sequence], times: int, seed: int) -> list[dict]:
    """``times`` different settings of a space at random, fewer if it has no more; the same
    for the same seed."""
    names, found, rng = sorted(space), [], random.Random(seed)
    size = 1
    for name in names:
        size *= len(space[name])
    for k in rng.sample(range(size), min(times, size)):
        setting = {}
        for name in names:
            k, at = divmod(k, len(space[name]))
            setting[name] = space[name][at]
        found.append(setting)
    return found


@dataclass(frozen=True)
class Trained:
    """``results``: target, model, setting, mae, rmse, r2 and their deviations over
    folds, rounded as they are compared; ``models``: fitted on all rows, by (target,
    model)."""

    results: DataFrame
    models: dict = field(default_factory=dict)

    def best(self) -> DataFrame:
        return evaluate.best_models(self.results)

    def save(self, folder: str) -> None:
        """Each model, the best of each target, and the results, below one folder."""
        for (target, name), model in self.models.items():
            model.write().overwrite().save(f"{folder}/{name}_{target.replace('-', '_')}")
        for row in self.best().collect():  # one row for each target
            self.models[row.target, row.model].write().overwrite().save(f"{folder}/best_{row.target.replace('-', '_')}")
        self.results.write.mode("overwrite").parquet(f"{folder}/results")


def load_best(folder: str, target: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/best_{target.replace('-', '_')}")


def preparation(features: Sequence[str]) -> list:
    """The stages before a model: gaps become the column's mean over the learned rows, as
    trees take no gaps, and the features one vector."""
    filled = [f"{FEATURES}_{i}" for i in range(len(features))]
    return [Imputer(inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol=FEATURES)]


def prepared(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with its features as one vector."""
    return Pipeline(stages=preparation(features)).fit(df).transform(df)


@nan_free
def train(df: DataFrame, targets: Sequence[str], features: Sequence[str], key: str, space: Mapping[str, Mapping[str, Sequence]] = SPACE, draws: int = 25, tune_folds: int = 3, folds: int = 5, seed: int = 42, parallel: int = 4) -> Trained:
    """For every target and family: ``draws`` settings at random are compared by their
    error over ``tune_folds`` folds, the best one is measured over ``folds`` others and
    fitted on all rows.  Rows without the target go; features without a value get the
    mean of all rows, folds included.  Fits run ``parallel`` at a time on the cluster."""
    rows, models = [], {}
    for target in targets:
        data = df.where(q(target).isNotNull()).withColumn("_label", q(target).cast("double"))
        data = hashed_folds(hashed_folds(data, key, tune_folds, "_tune"), key, folds, "_fold")
        raw = data.select("_label", "_tune", "_fold", *(q(f).cast("double").alias(f) for f in features))
        data = prepared(raw, features).cache()
        try:
            for name, spread in space.items():
                settings = drawn(spread, draws, seed)
                family = FAMILIES[name](featuresCol=FEATURES, labelCol="_label", seed=seed)
                grid = [{family.getParam(p): v for p, v in s.items()} for s in settings]
                rmse = RegressionEvaluator(labelCol="_label", metricName="rmse")
                search = CrossValidator(estimator=family, estimatorParamMaps=grid, evaluator=rmse, numFolds=tune_folds, foldCol="_tune", parallelism=parallel)
                found = search.fit(data)
                best = int(np.argmin(found.avgMetrics))
                chosen = family.copy(grid[best])
                rows.append((target, name, str(sorted(settings[best].items())), *_measured(data, chosen, folds)))
                models[target, name] = Pipeline(stages=[*preparation(features), chosen]).fit(raw)
        finally:
            data.unpersist()
    fields = ", ".join(f"{m} double, {m}_std double" for m in ("mae", "rmse", "r2"))
    return Trained(df.sparkSession.createDataFrame(rows, f"target string, model string, setting string, {fields}"), models)


def scored_over_folds(data: DataFrame, family, folds: int) -> DataFrame:
    """_fold, _label, prediction of every row by a model of the other folds.  ``data``:
    _fold, _label and the assembled features."""
    parts = []
    for f in range(folds):
        tested = data.where(F.col("_fold") == f)
        if not tested.isEmpty():
            parts.append(family.fit(data.where(F.col("_fold") != f)).transform(tested).select("_fold", "_label", "prediction"))
    return reduce(DataFrame.unionByName, parts)


def _measured(data: DataFrame, family, folds: int) -> list[float]:
    """mae, rmse, r2, each with its deviation, over the folds that have rows."""
    s = evaluate.fold_metrics(scored_over_folds(data, family, folds), "_label", "prediction", "_fold").head()
    return [s[f"{m}_{n}"] for m in ("mae", "rmse", "r2") for n in ("mean", "std")]


# --- scoring ----------------------------------------------------------------------


def input_checks(features: Mapping[str, tuple[float, float] | None], texts: Mapping[str, str] | None = None) -> tuple[Column, Column, Column]:
    """What a row's inputs are worth: issue (null if it can be scored), warnings (an
    array), valid.  ``features`` has a range, or None, for each name; a text is read
    as a number.  Missing and unreadable or infinite values are issues, values outside
    the range warnings."""
    read = {c: _read(c, (texts or {}).get(c)) for c in features}
    none = lambda name, on: F.when(on, F.lit(name))
    listed = lambda cells: F.array_join(F.array_compact(F.array(*cells)), ", ")
    missing = listed([none(c, q(c).isNull()) for c in features])
    invalid = listed([none(c, q(c).isNotNull() & ~_finite(x)) for c, x in read.items()])
    parts = F.array_compact(F.array(F.when(missing != "", F.concat(F.lit("Missing values: "), missing)), F.when(invalid != "", F.concat(F.lit("Invalid values: "), invalid))))
    outside = [F.when(_finite(read[c]) & ((read[c] < r[0]) | (read[c] > r[1])), F.lit(f"'{c}' is outside [{r[0]:g}, {r[1]:g}]")) for c, r in features.items() if r]
    warnings = F.array_compact(F.array(*outside)) if outside else F.array().cast("array<string>")
    return F.nullif(F.array_join(parts, "; "), F.lit("")), warnings, F.size(parts) == 0


def _read(column: str, kind: str | None) -> Column:
    return q(column).try_cast("double") if kind == "string" else q(column).cast("double")


def _finite(x: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def predict(df: DataFrame, score, features: Mapping[str, tuple[float, float] | None], name: str = "prediction") -> DataFrame:
    """``df`` with prediction, valid, issue and warnings.  ``score`` maps a frame whose
    features are doubles, null where a row isn't valid, to one with ``name``; rows
    that aren't valid keep their place, with a null for a prediction, and no row stops
    the others."""
    issue, warnings, valid = input_checks(features, dict(df.dtypes))
    checked = df.withColumns({"issue": issue, "warnings": warnings, "valid": valid})
    kinds = dict(df.dtypes)
    inputs = {c: F.when(F.col("valid"), _read(c, kinds[c])) for c in features}
    # The inputs as they were come back after scoring.
    kept = {f"_in_{i}": q(c) for i, c in enumerate(features)}
    scored = score(checked.withColumns(kept).withColumns(inputs))
    back = {c: F.col(f"_in_{i}") for i, c in enumerate(features)}
    return scored.withColumns(back).withColumn(name, F.when(F.col("valid"), F.col(name))).select(*map(q, df.columns), name, "valid", "issue", "warnings")


def by_model(model: PipelineModel):
    """A score by a fitted pipeline of ``train``."""
    own = [FEATURES, *model.stages[0].getOutputCols()]
    return lambda df: model.transform(df).drop(*own)


def by_line(models: DataFrame, features: Sequence[str], by: Sequence[str] = ()):
    """A score by linear models (of ``ridge``): one for all rows, or one for each group."""
    small = models.select(*(q(c).alias(f"_{c}") for c in by), "intercept", "coefficients")

    def score(df: DataFrame) -> DataFrame:
        if not by:
            joined = df.crossJoin(F.broadcast(small))  # one row
        else:
            on = [q(c).eqNullSafe(F.col(f"_{c}")) for c in by]
            joined = df.join(small, on, "left")
        return joined.withColumn("prediction", linear_score(features)).drop("intercept", "coefficients", *(f"_{c}" for c in by))

    return score


def calculate(df: DataFrame, key: str, score, features: Mapping[str, tuple[float, float] | None], training: DataFrame, training_key: str) -> DataFrame:
    """``predict`` with distance and confidence beside it: how far the nearest row of
    ``training``, whose features are numbers, is from each row's inputs, and what that
    makes of the prediction (high, medium, low; failed for rows that aren't valid).  Keys
    are whole numbers that differ in each table."""
    kinds = dict(df.dtypes)
    done = predict(df, score, features)
    inputs = F.array(*(_read(c, kinds[c]) for c in features))
    asked = done.where("valid").select((-1 - q(key).cast("long")).alias("query_id"), inputs.alias("q"))  # no row is its own neighbour
    known = training.select(q(training_key).cast("long").alias("id"), F.array(*(q(c).cast("double") for c in features)).alias("v"))
    near = retrieval.nearest_in_blocks(known, asked, "v", "id").select((-1 - F.col("query_id")).alias("_key"), "distance")
    sure = F.when(F.col("valid"), F.coalesce(retrieval.confidence(F.col("distance")), F.lit("low"))).otherwise("failed")
    return done.join(near, q(key).cast("long") == F.col("_key"), "left").drop("_key").withColumn("confidence", sure)


# --- workflows --------------------------------------------------------------------


def regimes(df: DataFrame, by: str, column: str) -> DataFrame:
    """by, mean, std, n of a column in every regime, null among them."""
    return df.groupBy(q(by)).agg(F.round(F.avg(q(column)), 6).alias("mean"), F.round(F.stddev_samp(q(column)), 6).alias("std"), F.count(q(column)).alias("n"))
