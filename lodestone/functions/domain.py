"""Domain features: gas and burden texts, scaling, interactions, one-hot, ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gas(text: Column, name: str) -> Column:
    """The number after ``NAME=``, 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, name + r"= *([0-9.]+)", 1).try_cast("double"), F.lit(0.0))


def burden(text: Column, letter: str) -> Column:
    """The summed shares of materials whose name starts with ``letter``."""
    whole = F.regexp_extract(text, r"^ *100 *% *([A-Z])", 1)
    names = F.regexp_extract_all(text, F.lit(r"([A-Z])[A-Z0-9/]*[-=]?([0-9]+(\.[0-9]+)?)%"), F.lit(1))
    shares = F.regexp_extract_all(text, F.lit(r"([A-Z])[A-Z0-9/]*[-=]?([0-9]+(\.[0-9]+)?)%"), F.lit(2))
    pairs = F.zip_with(names, shares, lambda n, s: F.when(n == letter, s.cast("double")).otherwise(0.0))
    return F.when(whole == letter, 100.0).when(whole != "", 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x))


# --- conditions in words ----------------------------------------------------------

# How gases and materials are written.
GASES = {"co": "co[=:\\s]+|carbon monoxide\\s*(?:is|at)?\\s*", "h2": "h2[=:\\s]+|hydrogen\\s*(?:is|at)?\\s*", "n2": "n2[=:\\s]+|nitrogen\\s*(?:is|at)?\\s*"}
MATERIALS = ("sinter", "ore", "pellet")
_PERCENT = r"(\d+(?:\.\d+)?)"


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row: a lambda's variable isn't
    replaced by what it stands for."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _said(text: Column, before: str, name: str) -> Column:
    """The per cent number behind a name or in front of it, else null."""
    number = lambda pattern: F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.coalesce(number(f"(?:{before}){_PERCENT}%"), number(rf"{_PERCENT}\s*%\s*{name}"))


def condition_numbers(text: Column) -> Column:
    """A struct of co, h2, n2, sinter, ore, pellet, other in per cent, from free text.
    Nitrogen that isn't named is the rest; a single material without a number is all."""
    def read(low: Column) -> Column:
        gases = [F.coalesce(_said(low, before, name), F.lit(0.0)).alias(name) for name, before in GASES.items()]
        shares = [F.when(low.rlike(f"100% {m}|completely {m}|{m} only"), 100.0).otherwise(F.coalesce(_said(low, rf"{m}[s\s]*(?:at)?\s*", m), F.lit(0.0))).alias(m) for m in MATERIALS]
        single = sum((low.contains(m).cast("int") for m in MATERIALS), F.lit(0)) == 1
        return F.struct(*gases, *shares, F.when(single, F.coalesce(*(F.when(low.contains(m), m) for m in MATERIALS))).alias("single"))

    def settle(x: Column) -> Column:
        rest = (x["n2"] == 0) & ((x["co"] > 0) | (x["h2"] > 0)) & (x["co"] + x["h2"] < 100)
        none = x["sinter"] + x["ore"] + x["pellet"] == 0
        named = [F.when(none & F.coalesce(x["single"] == m, F.lit(False)), 100.0).otherwise(x[m]).alias(m) for m in MATERIALS]
        return F.struct(x["co"].alias("co"), x["h2"].alias("h2"), F.when(rest, 100.0 - x["co"] - x["h2"]).otherwise(x["n2"]).alias("n2"), *named, F.lit(0.0).alias("other"))

    return _once(F.lower(F.coalesce(text, F.lit(""))), lambda low: _once(read(low), settle))


# Fixed values, in the two functions below: the texts of their warnings and the bounds that
# call for them.


def _group(parts: dict[str, Column], name: str) -> tuple[dict[str, Column], Column]:
    """Shares of 100 and the warning that goes with making them so."""
    total = sum(parts.values(), F.lit(0.0))
    off = F.abs(total - 100)
    exact = (off < 1e-3) | (total == 0)
    summed = F.concat(F.lit(f"{name} percentages summed to "), F.format_string("%.1f", total), F.lit(" %"))
    warning = F.when(exact | (off <= 5), None).when(off <= 15, F.concat(summed, F.lit(" (expected 100 %). Auto-normalised to 100 %."))).otherwise(F.concat(F.lit("⚠ "), summed, F.lit(", which is far from 100 %. Check your input — values were auto-normalised.")))
    return {k: F.when(exact, v).otherwise(v * F.try_divide(F.lit(100.0), total)) for k, v in parts.items()}, warning


def condition(numbers: Column) -> Column:
    """A struct of the shares of 100 by gas and material, num_components, test_type and
    warnings."""
    names = {f"{g.upper()}_pct": g for g in GASES}, {f"{m}_pct": m for m in (*MATERIALS, "other")}

    def shared(x: Column) -> Column:
        both = [_group({k: x[v] for k, v in group.items()}, title) for group, title in zip(names, ("Atmosphere", "Burden"))]
        s, o, p = (x[m] for m in MATERIALS)
        kind = F.when((p > 0) & (s == 0) & (o == 0), "P").when((s > 0) & (o > 0) & (p > 0), "SOP").otherwise("SO")
        return F.struct(*(v.alias(k) for parts, _ in both for k, v in parts.items()), F.array(*(w for _, w in both)).alias("summed"), kind.alias("test_type"))

    def judged(y: Column) -> Column:
        every = [*names[0], *names[1]]
        bounds = [F.when((y[k] < 0) | (y[k] > 100), F.concat(F.lit(f"⚠ {k}="), F.format_string("%.1f", y[k]), F.lit(" is outside the expected range [0.0, 100.0]."))) for k in every]
        low = F.when((y["CO_pct"] < 30) & (sum((y[k] for k in names[0]), F.lit(0.0)) > 0), F.concat(F.lit("CO_pct="), F.format_string("%.1f", y["CO_pct"]), F.lit(" % is below 30 %. Most training data has CO >= 30 %; predictions may be less reliable.")))
        components = sum(((y[k] > 0).cast("int") for k in names[1]), F.lit(0))
        return F.struct(*(F.round(y[k], 2).alias(k) for k in every), components.alias("num_components"), y["test_type"].alias("test_type"), F.array_compact(F.concat(y["summed"], F.array(*bounds, low))).alias("warnings"))

    return _once(numbers, lambda x: _once(shared(x), judged))


def burden_parts(text: Column) -> Column:
    """A struct of sinter_pct, ore_pct, pellet_pct, other_pct, num_components of a burden's
    formula, whose letters may be small; ``100% X`` is all of X."""
    up = F.upper(F.coalesce(text, F.lit("")))
    pattern = F.lit(r"([A-Z])[A-Z0-9/]*[-=]?([0-9]+(\.[0-9]+)?)%")
    pairs = F.arrays_zip(F.regexp_extract_all(up, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(up, pattern, F.lit(2)).alias("v"))
    whole = F.regexp_extract(up, r"^\s*100\s*%\s*([A-Z])", 1)
    amount = lambda test: F.aggregate(F.filter(pairs, lambda x: test(x["k"])), F.lit(0.0), lambda a, x: a + x["v"].cast("double"))
    tests = {"sinter": lambda k: k == "S", "ore": lambda k: k == "O", "pellet": lambda k: k == "P", "other": lambda k: ~k.isin("S", "O", "P")}
    shares = [F.when(whole != "", F.when(test(whole), 100.0).otherwise(0.0)).otherwise(amount(test)).alias(f"{m}_pct") for m, test in tests.items()]
    return F.struct(*shares, F.when(whole != "", 1).otherwise(F.size(pairs)).cast("int").alias("num_components"))


def interactions(co: Column, h2: Column, n2: Column, basicity: Column, sinter: Column) -> list[Column]:
    return [(co * basicity).alias("CO_x_Basicity"), ((co + h2) / (n2 + 1e-5)).alias("Reducibility_Ratio"), (basicity * sinter).alias("Basicity_x_Sinter")]


def calendar_dummies(c: Column, levels: list[str], prefix: str) -> list[Column]:
    """One-hot columns of all levels but the first, in order; an unknown level is all 0."""
    return [F.coalesce((c == level).cast("double"), F.lit(0.0)).alias(f"{prefix}_{level}") for level in sorted(levels)[1:]]


def consistency(ts: Column, tm: Column, predicted: Column, most: float = 15.0) -> Column:
    """consistent, mismatch, or null without all three."""
    delta = F.abs(F.round(tm - ts, 1) - predicted)
    return F.when(delta <= most, "consistent").when(delta > most, "mismatch")


def repaired(df: DataFrame, low: str = "Ts", high: str = "Tm", difference: str = "Tm_Ts") -> DataFrame:
    """``df`` with the difference put right where it is off by more than a thousandth."""
    true = F.col(f"`{high}`") - F.col(f"`{low}`")
    return df.withColumn(difference, F.when(F.abs(F.col(f"`{difference}`") - true) > 1e-3, true).otherwise(F.col(f"`{difference}`")))


def anomalies(df: DataFrame, *limits: tuple[str, str, float]) -> DataFrame:
    """One row, anomalies: how many rows meet all (column, < or >, limit)."""
    all_ = F.lit(True)
    for column, side, limit in limits:
        c = F.col(f"`{column}`")
        all_ = all_ & (c < limit if side == "<" else c > limit)
    return df.agg(F.count_if(all_).alias("anomalies"))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose named columns all read as numbers, which they become."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in columns}).na.drop(subset=columns)


def scaled(c: Column, low: float, high: float) -> Column:
    return (c - low) / (high - low)


def normalised_100(parts: list[Column]) -> tuple[list[Column], Column]:
    """Shares of 100, and how far the sum was off: silent, warn, urgent."""
    total = sum(parts[1:], parts[0])
    tier = F.when(F.abs(total - 100) <= 5, "silent").when(F.abs(total - 100) <= 15, "warn").otherwise("urgent")
    return [F.round(F.try_divide(p * 100.0, total), 2) for p in parts], tier


def one_hot(c: Column, levels: list[str], prefix: str) -> list[Column]:
    """Columns of a frozen list of levels; missing is its own level."""
    value = F.coalesce(c, F.lit("unknown"))
    return [(value == level).cast("double").alias(f"{prefix}{level}") for level in levels]


def range_warnings(ranges: dict[str, tuple[float, float]]) -> Column:
    """One text per value outside its range."""
    checks = [F.when((F.col(c) < low) | (F.col(c) > high), F.lit(f"{c} outside {low}-{high}")) for c, (low, high) in ranges.items()]
    return F.array_compact(F.array(*checks))


#: Ranges that scale gases and shares; a burden has at most so many components.
PERCENT, COMPONENTS = (0.0, 100.0), (1.0, 6.0)


def feature_names(chemistry: Sequence[str], types: Sequence[str]) -> list[str]:
    """What ``features`` holds, in its order."""
    return [*chemistry, "CO_pct", "H2_pct", "N2_pct", "sinter_pct", "ore_pct", "pellet_pct", "other_pct", "num_components", "CO_x_Basicity", "reducing_ratio", "Basicity_x_sinter", *(f"type_{t}" for t in sorted(types))]


def features(chemistry: dict[str, tuple[float, float]], basicity: str, gases: Column, burden_text: Column, kind: Column, types: Sequence[str]) -> Column:
    """The vector of a row as a model takes it: chemistry in its ranges, gases and burden
    read from texts and scaled, their interactions, and the test's type one-hot.  A gap
    in the chemistry is a null there."""
    gas_ = {g: gas(gases, g) for g in ("CO", "H2", "N2")}
    parts = burden_parts(burden_text)
    plain = [scaled(F.col(f"`{c}`").cast("double"), *r) for c, r in chemistry.items()]
    air = [scaled(x, *PERCENT) for x in gas_.values()]
    mixed = [scaled(parts[k], *PERCENT) for k in ("sinter_pct", "ore_pct", "pellet_pct", "other_pct")] + [scaled(parts["num_components"].cast("double"), *COMPONENTS)]
    both = interactions(gas_["CO"], gas_["H2"], gas_["N2"], F.col(f"`{basicity}`").cast("double"), parts["sinter_pct"])
    return F.array(*plain, *air, *mixed, *both, *one_hot(kind, sorted(types), "type"))
