"""Registered queries of conditions in words, features, anomalies and models' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain
from ..operators import evaluate
from .catalog import SQL, _r, register

_WORDS = {
    0: ("concat('Use CO=', p_size, '% and ', p_size % 10, '% h2; sinter at 60%, 30% ore')", "p_size, p_size % 10, CASE WHEN p_size + p_size % 10 < 100 THEN 100 - p_size - p_size % 10 ELSE 0 END, 60, 30, 0"),
    1: ("concat('Nitrogen is ', p_size, '% with a pellet burden')", "0, 0, p_size, 0, 0, 100"),
    2: ("concat('Completely ore, 40% CO, hydrogen at ', p_size, '%, n2: 20%')", "40, p_size, 20, 0, 100, 0"),
    3: ("'Sinter and ore, nothing else'", "0, 0, 0, 0, 0, 0"),
}
_TEXT = "CASE p_partkey % 4 " + " ".join(f"WHEN {k} THEN {words}" for k, (words, _) in _WORDS.items()) + " END"
_NAMES = ("co", "h2", "n2", "sinter", "ore", "pellet")
_PARSED = "(" + " UNION ALL ".join(f"SELECT p_partkey, CAST(v[1] AS DOUBLE) AS co, CAST(v[2] AS DOUBLE) AS h2, CAST(v[3] AS DOUBLE) AS n2, CAST(v[4] AS DOUBLE) AS sinter, CAST(v[5] AS DOUBLE) AS ore, CAST(v[6] AS DOUBLE) AS pellet FROM (SELECT p_partkey, [{values}] AS v FROM part WHERE p_partkey % 4 = {k})" for k, (_, values) in _WORDS.items()) + ")"
register("condition_words", f"SELECT p_partkey, {', '.join(_NAMES)} FROM {_PARSED}")(lambda t: t("part").select("p_partkey", domain.condition_numbers(F.expr(_TEXT)).alias("c")).select("p_partkey", *(f"c.{n}" for n in _NAMES)))


def _sql_group(names):
    total = " + ".join(names)
    return [f"round(CASE WHEN abs({total} - 100) < 0.001 OR {total} = 0 THEN {n} ELSE {n} * (100.0 / ({total})) END, 2)" for n in names]


def _sql_warned(names, label):
    total = "(" + " + ".join(names) + ")"
    said = f"'{label} percentages summed to ' || printf('%.1f', {total}) || ' %'"
    return f"CASE WHEN {total} = 0 OR abs({total} - 100) <= 5 THEN NULL WHEN abs({total} - 100) <= 15 THEN {said} || ' (expected 100 %). Auto-normalised to 100 %.' ELSE '⚠ ' || {said} || ', which is far from 100 %. Check your input — values were auto-normalised.' END"


_GAS, _LOAD = _NAMES[:3], _NAMES[3:]
_SHARES = ", ".join(f"{v} AS {n}" for n, v in zip(("co_pct", "h2_pct", "n2_pct", "sinter_pct", "ore_pct", "pellet_pct"), [*_sql_group(_GAS), *_sql_group(_LOAD)]))
_EXACT = [v[len("round("):-len(", 2)")] for v in (*_sql_group(_GAS), *_sql_group(_LOAD))]
_BOUNDS = ", ".join(f"CASE WHEN {v} < 0 OR {v} > 100 THEN '⚠ {n}=' || printf('%.1f', {v}) || ' is outside the expected range [0.0, 100.0].' END" for n, v in zip(("CO_pct", "H2_pct", "N2_pct", "sinter_pct", "ore_pct", "pellet_pct"), _EXACT))
_CO = "CASE WHEN abs(co + h2 + n2 - 100) < 0.001 OR co + h2 + n2 = 0 THEN co ELSE co * (100.0 / (co + h2 + n2)) END"
_FEW = f"CASE WHEN {_CO} < 30 AND co + h2 + n2 > 0 THEN 'CO_pct=' || printf('%.1f', {_CO}) || ' % is below 30 %. Most training data has CO >= 30 %; predictions may be less reliable.' END"
register("condition_normalised", f"""SELECT p_partkey, {_SHARES}, CAST((sinter > 0)::INT + (ore > 0)::INT + (pellet > 0)::INT AS INT) AS num_components, CASE WHEN pellet > 0 AND sinter = 0 AND ore = 0 THEN 'P' WHEN sinter > 0 AND ore > 0 AND pellet > 0 THEN 'SOP' ELSE 'SO' END AS test_type,
concat_ws(' | ', {_sql_warned(_GAS, 'Atmosphere')}, {_sql_warned(_LOAD, 'Burden')}, {_BOUNDS}, {_FEW}) AS warned FROM {_PARSED}""")(
    lambda t: t("part").select("p_partkey", domain.condition(domain.condition_numbers(F.expr(_TEXT))).alias("c")).select("p_partkey", *(F.col(f"c.{a}").alias(a.lower()) for a in ("CO_pct", "H2_pct", "N2_pct", "sinter_pct", "ore_pct", "pellet_pct", "num_components", "test_type")), F.array_join("c.warnings", " | ").alias("warned")))
_FORMULA = "CASE p_partkey % 3 WHEN 0 THEN concat('s1-', p_size, '%+o1-', 100 - p_size, '%') WHEN 1 THEN '100% p' ELSE concat('S2=20%+P/X1 ', 10, '%+q3-', p_size, '.5%') END"
register("burden_parts", "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 0 ELSE 20 END AS DOUBLE) AS sinter_pct, CAST(CASE p_partkey % 3 WHEN 0 THEN 100 - p_size ELSE 0 END AS DOUBLE) AS ore_pct, CAST(CASE p_partkey % 3 WHEN 1 THEN 100 ELSE 0 END AS DOUBLE) AS pellet_pct, CAST(CASE p_partkey % 3 WHEN 2 THEN p_size + 0.5 ELSE 0 END AS DOUBLE) AS other_pct, CASE p_partkey % 3 WHEN 1 THEN 1 ELSE 2 END AS num_components FROM part")(
    lambda t: t("part").select("p_partkey", domain.burden_parts(F.expr(_FORMULA)).alias("b")).select("p_partkey", "b.*"))
register("interactions", "SELECT p_partkey, round(p_size * 1.5, 6)::DOUBLE AS CO_x_Basicity, round((p_size + 5) / (60 - p_size + 0.00001), 6)::DOUBLE AS Reducibility_Ratio, round(1.5 * p_size, 6)::DOUBLE AS Basicity_x_Sinter FROM part")(
    lambda t: _r(t("part").select("p_partkey", *domain.interactions(F.col("p_size").cast("double"), F.lit(5.0), 60 - F.col("p_size"), F.lit(1.5), F.col("p_size").cast("double"))), "CO_x_Basicity", "Reducibility_Ratio", "Basicity_x_Sinter"))
register("calendar_dummies", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status_O, CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status_P FROM orders")(lambda t: t("orders").select("o_orderkey", *domain.calendar_dummies(F.col("o_orderstatus"), ["P", "F", "O"], "status")))
register("consistency_badge", "SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL WHEN abs(round(1200 + p_size - 1000.0, 1) - 225) <= 15 THEN 'consistent' ELSE 'mismatch' END AS badge FROM part")(lambda t: t("part").select("p_partkey", domain.consistency(F.lit(1000.0), F.expr("CASE WHEN p_size % 9 <> 0 THEN 1200 + p_size END").cast("double"), F.lit(225.0)).alias("badge")))
register("difference_repair", "SELECT p_partkey, 200.0::DOUBLE + p_size AS Tm_Ts FROM part")(lambda t: domain.repaired(t("part").selectExpr("p_partkey", "1300D AS Ts", "1500D + p_size AS Tm", "CASE WHEN p_size % 2 = 0 THEN 999D ELSE 200D + p_size END AS Tm_Ts")).select("p_partkey", "Tm_Ts"))
register("single_threshold", "SELECT count(CASE WHEN p_retailprice < 1100 THEN 1 END) AS anomalies FROM part")(lambda t: domain.anomalies(t("part"), ("p_retailprice", "<", 1100)))
register("threshold_anomalies", "SELECT count(CASE WHEN l_discount < 0.03 AND l_quantity > 40 THEN 1 END) AS anomalies FROM lineitem")(lambda t: domain.anomalies(t("lineitem"), ("l_discount", "<", 0.03), ("l_quantity", ">", 40)))
register("complete_rows", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS a, CAST(o_totalprice AS DOUBLE) AS b FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0")(
    lambda t: domain.complete_rows(t("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END AS a", "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS b"), ["a", "b"]))
_RANGES = {"p_size": (5, 40), "p_retailprice": (950, 1500)}
register("range_warning_texts", "SELECT p_partkey, concat_ws('; ', " + ", ".join(f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c} outside {lo}-{hi}' END" for c, (lo, hi) in _RANGES.items()) + ") AS warned FROM part")(lambda t: t("part").select("p_partkey", F.array_join(domain.range_warnings(_RANGES), "; ").alias("warned")))
_MODELS = "(SELECT 'm' || (p_size % 7) AS model, p_brand AS target, round(avg(p_retailprice), 6) AS rmse FROM part GROUP BY 1, 2)"
register("best_models", f"SELECT target, arg_min(model, rmse) AS model, min(rmse) AS rmse FROM {_MODELS} GROUP BY 1")(lambda t: evaluate.best_models(t("part").groupBy(F.concat(F.lit("m"), (F.col("p_size") % 7).cast("string")).alias("model"), F.col("p_brand").alias("target")).agg(F.round(F.avg("p_retailprice"), 6).alias("rmse"))))
register("fold_metrics", """WITH f AS (SELECT l_orderkey % 5 AS fold, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - avg(e * e) / var_pop(y) AS r2 FROM (SELECT l_orderkey, l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) GROUP BY 1)
SELECT count(*) AS folds, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std FROM f""")(
    lambda t: evaluate.fold_metrics(t("lineitem").selectExpr("l_orderkey % 5 AS fold", "l_extendedprice AS y", "l_quantity * 1500 AS guess"), "y", "guess"))

#: Every part as an experiment: two measures, gases and a burden in words, a type.
_GASES, _TYPES = "concat('CO=', p_size, ' H2=5 N2=', 60 - p_size)", ["dry", "unknown", "wet"]
_SCALES = {"p_size": (1.0, 50.0), "p_retailprice": (900.0, 2000.0)}
_CELLS = [
    "(p_size - 1) / 49.0", "(p_retailprice - 900) / 1100", "p_size / 100.0", "0.05", "(60 - p_size) / 100.0", "sinter_pct / 100", "ore_pct / 100", "pellet_pct / 100", "other_pct / 100", "(num_components - 1) / 5.0",
    "p_size * (p_size / 10.0)", "(p_size + 5) / (60 - p_size + 0.00001)", "(p_size / 10.0) * sinter_pct", *(f"CASE WHEN p_partkey % 3 = {k} THEN 1 ELSE 0 END" for k in (0, 2, 1)),
]
register("model_features", "SELECT p_partkey, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS f{i}" for i, c in enumerate(_CELLS)) + f" FROM part JOIN ({SQL['burden_parts']}) USING (p_partkey)")(
    lambda t: t("part").withColumn("basicity", F.expr("p_size / 10.0D")).select("p_partkey", domain.features(_SCALES, "basicity", F.expr(_GASES), F.expr(_FORMULA), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'dry' WHEN 1 THEN 'wet' END"), _TYPES).alias("v"))
    .select("p_partkey", *(F.round(F.get("v", F.lit(i)), 6).alias(f"f{i}") for i in range(len(_CELLS)))))
