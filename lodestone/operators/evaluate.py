"""Evaluation: retrieval metrics, folds, regression errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import order


def retrieval_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """hit rate, recall and mean reciprocal rank; ``ranked``: query_id, rank,
    relevant (boolean), n_relevant."""
    by_query = ranked.groupBy("query_id").agg(F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("hits"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.max("n_relevant").alias("n"))
    return by_query.agg(
        F.count("*").alias("queries"), F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.try_divide("hits", "n")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def coverage_metrics(queries: DataFrame, required: DataFrame, retrieved: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """metric, value of a retrieval over passages that are a source and a section.

    ``queries``: query_id, answerable, and elapsed_ms if it was measured; ``required``:
    query_id, source, section; ``retrieved``: query_id, rank, source, section.  Over
    answerable queries: recall@k, the mean share of required passages within k;
    hit_rate@k; source_coverage@k, the same share of sources; complete@k, the share of
    queries all of whose passages are within k (division of the one set by the other);
    mrr.  Over the others: nonempty_rate, the share that found anything.  Null where there
    are no such queries."""
    if not ks or any(isinstance(k, bool) or not isinstance(k, int) or k < 1 for k in ks) or list(ks) != sorted(set(ks)):
        raise ValueError("ks must be different positive whole numbers in order")
    first = retrieved.groupBy("query_id", "source", "section").agg(F.min("rank").alias("rank"))
    passages = required.select("query_id", "source", "section").distinct().join(first, ["query_id", "source", "section"], "left")
    by_source = first.groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    sources = required.select("query_id", "source").distinct().join(by_source, ["query_id", "source"], "left")

    def shares(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("query_id").agg(F.min("rank").alias(f"{name}_first"), *((F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"{name}{k}") for k in ks))

    anything = retrieved.select("query_id").distinct().withColumn("_any", F.lit(True))
    each = queries.join(shares(passages, "p"), "query_id", "left").join(shares(sources, "s"), "query_id", "left").join(anything, "query_id", "left")
    asked = lambda c: F.when(F.col("answerable"), F.coalesce(c.cast("double"), F.lit(0.0)))
    metrics = {"query_count": F.count("*").cast("double"), "answerable_count": F.count_if("answerable").cast("double")}
    for k in ks:
        share = F.col(f"p{k}")
        metrics |= {f"recall@{k}": F.avg(asked(share)), f"hit_rate@{k}": F.avg(asked((share > 0))), f"source_coverage@{k}": F.avg(asked(F.col(f"s{k}"))), f"complete@{k}": F.avg(asked(share == 1))}
    metrics |= {"mrr": F.avg(asked(1 / F.col("p_first"))), "nonempty_rate": F.avg(F.when(~F.col("answerable"), F.coalesce(F.col("_any"), F.lit(False)).cast("double")))}
    if "elapsed_ms" in queries.columns:
        # Medians of measured times: a figure of a report, no result that must be exact.
        metrics |= {"mean_ms": F.avg("elapsed_ms"), "median_ms": F.percentile_approx("elapsed_ms", 0.5, 10_000).cast("double")}
    row = each.agg(*(c.alias(f"m{i}") for i, c in enumerate(metrics.values())))
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), F.round(f"m{i}", 6).alias("value")) for i, name in enumerate(metrics)))).alias("r")).select("r.*")


def time_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """key, fold: fold f tests the f-th of ``folds`` last equal parts; 0 is only ever
    trained on.  Keys differ.  Fewer rows than parts, found when the plan runs, are an error."""
    ranked = order.running(df.select(key, F.lit(1).cast("long").alias("one")), key, "one")
    sized = ranked.crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))
    enough = F.when(F.col("n") > folds, F.floor(F.col("n") / (folds + 1))).otherwise(F.raise_error(F.lit(f"Too few rows for {folds} folds")))
    size = F.greatest(F.lit(1), enough)
    return sized.select(key, F.greatest(F.lit(0).cast("long"), folds - F.floor((F.col("n") - F.col("upto_one")) / size)).alias("fold"))


def fold_metrics(scored: DataFrame, truth: str, guess: str, fold: str = "fold") -> DataFrame:
    """One row: mean and deviation over folds of mae, rmse and r2."""
    e = F.col(truth) - F.col(guess)
    each = scored.groupBy(fold).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.nullif(F.var_pop(truth), F.lit(0.0)))).alias("r2"))
    return each.agg(F.count("*").alias("folds"), *(f(m).alias(f"{m}_{n}") for m in ("mae", "rmse", "r2") for n, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("std", lambda c: F.round(F.stddev_pop(c), 6)))))


def best_models(results: DataFrame) -> DataFrame:
    """target, model, rmse: the model with the least error of each target; ties go to
    the name that sorts first.  ``results``: target, model, rmse."""
    return results.groupBy("target").agg(F.min(F.struct("rmse", "model")).alias("b")).select("target", "b.model", "b.rmse")


def pass_rates(checked: DataFrame) -> DataFrame:
    """check, n, pass_rate.  ``checked``: check, passed."""
    return checked.groupBy("check").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    e = F.col(truth) - F.col(guess)
    s = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(truth).alias("v"))
    return s.select(F.round("mae", 6).alias("mae"), F.round(F.sqrt("mse"), 6).alias("rmse"), F.round(1 - F.try_divide("mse", F.nullif("v", F.lit(0.0))), 6).alias("r2"))
