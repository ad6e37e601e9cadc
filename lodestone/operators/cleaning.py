"""Controlled cleaning: detection, imputation with a change log, confidence, impact."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EFFECT_CAP, IDENTIFIER_NAMES, IQR_FACTOR, MAD_CUT, MAD_SCALE, MIN_GROUP, MIN_STABLE, NUMBER_TEXT, STD_SHIFT, TVD_NOTED
from . import order, profile
from .query import nan_free, q


@nan_free
def duplicates(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows beyond the first of each set with equal keys, nulls being equal.

    Keys are told apart by 128 bits of hashes of their values and of which are null, so
    long texts aren't keys of a shuffle.  Hashes are counted before they move, and only
    those that occur more than once meet the rows again."""
    values = [*(q(k) for k in keys), *(q(k).isNull() for k in keys)]
    hashed = df.withColumns({"_h1": F.xxhash64(*values), "_h2": F.xxhash64(F.lit(1), *values)})
    firsts = hashed.groupBy("_h1", "_h2").agg(F.min(q(row)).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return hashed.join(firsts, ["_h1", "_h2"]).where(q(row) > F.col("_first")).select(*map(q, df.columns))


@nan_free
def conflicting_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once, and how many exact repeats there are."""
    by_key = df.groupBy(q(key).alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)).alias("repeated_key_rows"))
    by_row = df.groupBy(*map(q, df.columns)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicates"))
    return by_key.crossJoin(by_row).withColumn("conflicting", F.col("repeated_key_rows") > F.col("exact_duplicates"))


@nan_free
def fill_value(df: DataFrame, column: str, numeric: bool) -> DataFrame:
    """One row: the median, or the most frequent value (the smallest on ties)."""
    if numeric:
        return order.percentiles(df, q(column), [0.5]).select(F.get("p", F.lit(0)).alias("fill"))
    counted = df.where(q(column).isNotNull()).groupBy(q(column).alias("v")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "v").limit(1).select(F.col("v").alias("fill"))


@nan_free
def imputed(df: DataFrame, column: str, numeric: bool = True) -> DataFrame:
    joined = df.crossJoin(F.broadcast(fill_value(df, column, numeric)))
    return joined.withColumn(column, F.coalesce(q(column), "fill")).drop("fill")


@nan_free
def changes(df: DataFrame, column: str, key: str, numeric: bool = True) -> DataFrame:
    """The change log of an imputation."""
    joined = df.where(q(column).isNull()).crossJoin(F.broadcast(fill_value(df, column, numeric)))
    return joined.select(q(key).alias("row_id"), F.lit(column).alias("field"), F.lit("impute_missing").alias("operation"), F.round(F.col("fill").cast("double"), 6).alias("after"))


@nan_free
def missingness_effect(df: DataFrame, target: str, other: str) -> DataFrame:
    """n1, n2, effect: how far the means of ``other`` lie apart between rows with and
    without ``target``, in pooled deviations of which ``EFFECT_CAP`` are 1; without
    spread 0 or 1; null where a side is too small."""
    gone, x = q(target).isNull(), q(other).cast("double")
    a, b = F.when(gone, x), F.when(~gone, x)
    s = df.agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    pooled = F.sqrt(F.greatest(F.lit(0.0), ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)))
    d = F.when(pooled == 0, (F.col("m1") != F.col("m2")).cast("double")).otherwise(F.least(F.lit(1.0), F.abs(F.col("m1") - F.col("m2")) / pooled / EFFECT_CAP))
    enough = (F.col("n1") >= MIN_GROUP) & (F.col("n2") >= MIN_GROUP)
    return s.select("n1", "n2", F.when(enough, F.round(d, 6)).alias("effect"))


@nan_free
def missingness_table(df: DataFrame, target: str, other: str) -> DataFrame:
    """n1, n2, effect: Cramer's V of a value's being missing and the values of
    ``other``; null where a side is too small or there are fewer than two values."""
    cells = df.where(q(other).isNotNull()).groupBy(q(other).alias("v")).agg(F.count_if(q(target).isNull()).alias("a"), F.count_if(q(target).isNotNull()).alias("b"))
    s = cells.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n1"), F.coalesce(F.sum("b"), F.lit(0)).alias("n2"), F.count("*").alias("k"), *(F.sum(F.col(c) * F.col(c) / (F.col("a") + F.col("b"))).alias(f"s{c}") for c in "ab"))
    phi = F.try_divide("sa", "n1") + F.try_divide("sb", "n2") - 1
    v = F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), phi)))
    enough = (F.col("n1") >= MIN_GROUP) & (F.col("n2") >= MIN_GROUP) & (F.col("k") >= 2)
    return s.select("n1", "n2", F.when(enough, F.round(v, 6)).alias("effect"))


@nan_free
def missingness_association(df: DataFrame, target: str) -> DataFrame:
    """One row: the strongest association of a column's gaps with another column,
    max_association, associated_column (the first of equals), association_method,
    columns_compared, columns_skipped."""
    found = df.sparkSession.createDataFrame([], "k int, name string, method string, effect double")
    for k, f in enumerate(df.schema):
        if f.name == target or not isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType)):
            continue
        measure, name = (missingness_effect, "effect_size") if isinstance(f.dataType, T.NumericType) else (missingness_table, "cramers_v")
        found = found.unionByName(measure(df, target, f.name).select(F.lit(k).alias("k"), F.lit(f.name).alias("name"), F.lit(name).alias("method"), "effect"))
    gaps = df.agg(((F.count(q(target)) > 0) & (F.count(q(target)) < F.count("*"))).alias("any"))
    best = F.max(F.when(F.col("effect") > 0, F.struct("effect", (-F.col("k")).alias("k"), "name", "method"))).alias("best")
    s = found.crossJoin(F.broadcast(gaps)).where("any").agg(best, F.count("effect").alias("columns_compared"), F.count_if(F.col("effect").isNull()).alias("columns_skipped"))
    return s.select(F.round(F.coalesce("best.effect", F.lit(0.0)), 4).alias("max_association"), F.col("best.name").alias("associated_column"), F.col("best.method").alias("association_method"), "columns_compared", "columns_skipped")


@nan_free
def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy of the value frequencies over its largest value."""
    counted = df.where(q(column).isNotNull()).groupBy(q(column).alias("v")).agg(F.count("*").cast("double").alias("n"))
    # sum(p ln p) from sums that need no second pass: p = n / N.
    s = counted.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count("*").alias("k"))
    h = F.log("total") - F.col("nlogn") / F.col("total")
    return s.select(F.col("k").alias("categories"), F.round(F.when(F.col("k") > 1, h / F.log(F.col("k").cast("double"))).otherwise(0.0), 6).alias("entropy"))


@nan_free
def imputation_confidence(df: DataFrame, column: str, in_frame: bool = False) -> DataFrame:
    """One row, confidence: .30 presence (.95 at most), .25 sample, .25 evenness (of
    numbers by their spread, of others by their entropy), .20 independence of the gaps
    from other columns (1 unless ``in_frame``); 0 for an empty table."""
    s = df.agg(F.count("*").alias("rows"), F.count(q(column)).alias("n"))
    if isinstance(df.schema[column].dataType, T.NumericType):
        c = q(column).cast("double")
        spread = df.agg(F.avg(c).alias("m"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"))
        even = spread.select(F.when(F.col("sd") == 0, 1.0).when(F.col("m") == 0, 1 / (1 + F.col("sd"))).otherwise(1 / (1 + F.abs(F.try_divide("sd", "m")))).alias("even"))
    else:
        even = entropy(df, column).select((1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("entropy")))).alias("even"))
    s = s.crossJoin(F.broadcast(even))
    s = s.crossJoin(F.broadcast(missingness_association(df, column).select(F.col("max_association").alias("tie")))) if in_frame else s.withColumn("tie", F.lit(0.0))
    present = F.least(F.lit(0.95), F.try_divide("n", "rows"))
    total = 0.30 * present + 0.25 * F.least(F.lit(1.0), F.col("n") / MIN_STABLE) + 0.25 * F.when(F.col("n") == 0, 0.0).otherwise(F.col("even")) + 0.20 * (1 - F.col("tie"))
    return s.select(F.round(F.when(F.col("rows") == 0, 0.0).otherwise(F.least(F.lit(1.0), total)), 6).alias("confidence"))


# --- outliers -----------------------------------------------------------------


@nan_free
def modified_z(df: DataFrame, column: str) -> DataFrame:
    """``df`` with z (distance from the median in scaled median deviations; null with
    fewer than three values or without spread), q1 and q3."""
    x = q(column).cast("double")
    fences = order.percentiles(df, x, profile.QUARTERS).select(F.get("p", F.lit(0)).alias("q1"), F.get("p", F.lit(1)).alias("_med"), F.get("p", F.lit(2)).alias("q3"))
    placed = df.crossJoin(F.broadcast(fences)).withColumn("_off", F.abs(x - F.col("_med")))
    spread = order.percentiles(placed, F.col("_off"), [0.5]).select((F.get("p", F.lit(0)) * MAD_SCALE).alias("_mad")).crossJoin(df.agg(F.count(x).alias("_n")))
    z = F.when((F.col("_n") >= 3) & (F.col("_mad") > 0), F.try_divide("_off", "_mad"))
    return placed.crossJoin(F.broadcast(spread)).withColumn("z", z).drop("_off", "_mad", "_n", "_med")


def _beyond(x: Column) -> Column:
    """How far beyond the fences, in quartile ranges; null inside them."""
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - IQR_FACTOR * iqr, F.col("q3") + IQR_FACTOR * iqr
    return F.when(iqr > 0, F.when(x < low, F.try_divide(low - x, iqr)).when(x > high, F.try_divide(x - high, iqr)))


def _agrees() -> Column:
    return F.coalesce(F.col("z") > MAD_CUT, F.lit(False))


@nan_free
def outlier_confidence(df: DataFrame, column: str) -> DataFrame:
    """One row: flagged_count, mean_iqr_distance, mad_flagged_count, agreement_count,
    agreement_rate, confidence (.5 without an outlier)."""
    rows = modified_z(df.select(q(column).alias("x")), "x").withColumn("distance", _beyond(F.col("x").cast("double")))
    base = F.least(F.lit(0.95), F.greatest(F.lit(0.5), 0.5 + 0.1 * F.col("distance")))
    sure = F.when(F.col("distance").isNotNull(), F.when(_agrees(), F.least(F.lit(0.95), base + 0.05)).otherwise(base))
    agreed = F.count_if(F.col("distance").isNotNull() & _agrees())
    s = rows.agg(F.count("distance").alias("flagged_count"), F.round(F.coalesce(F.avg(F.round("distance", 4)), F.lit(0.0)), 4).alias("mean_iqr_distance"), F.count_if(_agrees()).alias("mad_flagged_count"), agreed.alias("agreement_count"), F.round(F.coalesce(F.avg(sure), F.lit(0.5)), 4).alias("confidence"))
    return s.withColumn("agreement_rate", F.round(F.coalesce(F.try_divide("agreement_count", "flagged_count"), F.lit(0.0)), 4))


@nan_free
def outlier_details(df: DataFrame, column: str, row: str, most: int = 20) -> DataFrame:
    """row_id, value, distance, z, agrees of the first ``most`` outliers in row order."""
    rows = modified_z(df.select(q(row).alias("row_id"), q(column).alias("value")), "value").withColumn("distance", F.round(_beyond(F.col("value").cast("double")), 4))
    return rows.where("distance is not null").select("row_id", "value", "distance", F.round("z", 4).alias("z"), _agrees().alias("agrees")).orderBy("row_id").limit(most)


# --- issues, proposals, decisions -----------------------------------------------


def _data_columns(df: DataFrame, row: str) -> list[str]:
    return [c for c in df.columns if c != row]


def _of_type(df: DataFrame, row: str, kind) -> list[str]:
    return [f.name for f in df.schema if f.name != row and isinstance(f.dataType, kind)]


@nan_free
def issues(df: DataFrame, row: str) -> DataFrame:
    """issue_id, kind, field, n, message of what may be wrong with a table whose rows
    ``row`` names: repeated rows, identifiers with conflicts, gaps, texts that mix
    numbers with others, outliers.  Nothing is changed."""
    columns, texts = _data_columns(df, row), _of_type(df, row, T.StringType)
    data = df.select(*map(q, columns))
    whole = profile.dataset_counts(data).select(F.col("duplicate_rows").alias("n"))

    def issue(frame: DataFrame, name: str, kind: str, field: str | None, before: str, after: str | None = None) -> DataFrame:
        message = F.lit(before) if after is None else F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after))
        return frame.where("n > 0").select(F.lit(name).alias("issue_id"), F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), F.col("n").cast("long").alias("n"), message.alias("message"))

    found = [issue(whole, "duplicate_rows", "duplicate_rows", None, "", " duplicate row(s) can be reviewed.")]
    for c in (c for c in columns if c.lower() in IDENTIFIER_NAMES):
        repeated = data.groupBy(q(c).alias("v")).agg(F.count("*").alias("k")).where("k > 1").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
        both = repeated.crossJoin(whole).select(F.when(F.col("k") > F.col("n"), F.col("k")).otherwise(0).alias("n"))
        found.append(issue(both, f"conflicting_identifier_{c}", "duplicate_identifier", c, f"Candidate identifier '{c}' has repeated values across non-exact duplicate rows."))
    gaps = data.agg(F.count("*").alias("rows"), *(F.count_if(q(c).isNull()).alias(f"g{i}") for i, c in enumerate(columns)), *(F.count_if(q(c).rlike(NUMBER_TEXT)).alias(f"p{columns.index(c)}") for c in texts))
    for i, c in enumerate(columns):
        found.append(issue(gaps.select(F.col(f"g{i}").alias("n")), f"missing_{c}", "missing_values", c, f"Column '{c}' has ", " missing value(s)."))
        if c in texts:
            mixed = gaps.select(F.when(F.col(f"p{i}") < F.col("rows") - F.col(f"g{i}"), F.col(f"p{i}")).otherwise(0).alias("n"))
            found.append(issue(mixed, f"mixed_values_{c}", "mixed_values", c, f"Column '{c}' mixes numeric-like and non-numeric values."))
    numbers = _of_type(df, row, T.NumericType)
    if numbers:
        far = profile.shapes(data, numbers).where("iqr_outliers > 0")
        said = F.concat(F.col("iqr_outliers").cast("string"), F.lit(" observation(s) are potentially unusual under the IQR rule."))
        found.append(far.select(F.concat(F.lit("unusual:"), "column_name").alias("issue_id"), F.lit("statistical_outliers").alias("kind"), F.col("column_name").alias("field"), F.col("iqr_outliers").alias("n"), said.alias("message")))
    return reduce(DataFrame.unionByName, found)


# Why something is proposed.
WHY_REMOVE = "Remove exact duplicate observations while retaining the first row."
WHY_FLAG = "Statistically unusual values should be investigated before exclusion."


def why_impute(column: str, method: str, purpose: str | None = None) -> str:
    after = f". Purpose: {purpose}." if purpose else "; review whether this is scientifically appropriate."
    return f"Fill missing '{column}' values with the observed {method}{after}"


@nan_free
def issue_rows(df: DataFrame, row: str) -> DataFrame:
    """issue_id, row_id: the rows that an issue speaks of, one row for each.  Repeats: the
    rows beyond the first; identifiers: all rows of a repeated one; gaps; outliers."""
    columns = _data_columns(df, row)
    named = lambda frame, issue: frame.select(F.lit(issue).alias("issue_id"), q(row).alias("row_id"))
    found = [named(duplicates(df, columns, row), "duplicate_rows")]
    whole = F.broadcast(issues(df, row).select("issue_id"))
    for c in (c for c in columns if c.lower() in IDENTIFIER_NAMES):
        repeated = df.groupBy(q(c).alias("_v")).agg(F.count("*").alias("_k")).where("_k > 1")
        found.append(named(df.join(repeated, q(c).eqNullSafe(F.col("_v")), "left_semi"), f"conflicting_identifier_{c}"))
    for c in columns:
        found.append(named(df.where(q(c).isNull()), f"missing_{c}"))
    for c in _of_type(df, row, T.NumericType):
        found.append(named(modified_z(df, c).where(_beyond(q(c).cast("double")).isNotNull()), f"unusual:{c}"))
    return reduce(DataFrame.unionByName, found).join(whole, "issue_id", "left_semi").select("issue_id", "row_id")


def outlier_issues(found: DataFrame) -> DataFrame:
    """issue_id, proposal_id, kind, field, message, method of the findings (of
    ``findings``) that call a column's values unusual.  The second and further ones of a
    column get a number behind their ids, in the order of their finding_ids."""
    named = F.col("finding_id").contains("unusual") | F.col("finding_id").contains("outlier")
    unusual = found.where(named | F.col("category").isin("distribution", "anomaly"))
    place = F.row_number().over(Window.partitionBy("subject").orderBy("finding_id")) - 1
    suffix = F.when(F.col("_nth") == 0, "").otherwise(F.concat(F.lit("_"), F.col("_nth").cast("string")))
    return unusual.withColumn("_nth", place).select(
        F.concat("finding_id", suffix).alias("issue_id"), F.concat(F.lit("investigate_"), "subject", F.lit("_outliers"), suffix).alias("proposal_id"), F.lit("statistical_outliers").alias("kind"), F.col("subject").alias("field"), F.col("observation").alias("message"), "method",
    )


@nan_free
def proposals(df: DataFrame, row: str, purpose: str | None = None, found_issues: DataFrame | None = None) -> DataFrame:
    """proposal_id, issue_id, action, field, method, rationale, number, text (what gaps
    would be filled with), confidence.  With the purpose "unknown" no imputation is
    proposed; outliers are only ever flagged; mixed texts are never converted.
    ``found_issues``, of ``issues``, saves working them out again."""
    seen = issues(df, row) if found_issues is None else found_issues
    data = df.select(*map(q, _data_columns(df, row)))
    none = {"number": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}

    def proposal(frame: DataFrame, name: str, issue_id: str, action: str, field: str | None, method: str, why: str, **fill: Column) -> DataFrame:
        plain = {"proposal_id": name, "issue_id": issue_id, "action": action, "field": field, "method": method, "rationale": why}
        return frame.select(*(F.lit(v).cast("string").alias(k) for k, v in plain.items()), *(v.alias(k) for k, v in (none | fill).items()), "confidence")

    sure = df.sparkSession.createDataFrame([(1.0,)], "confidence double")
    found = [proposal(sure, "remove_duplicate_rows", "duplicate_rows", "remove_duplicates", None, "keep_first", WHY_REMOVE)]
    for c in data.columns:
        numeric = c in _of_type(df, row, T.NumericType)
        if purpose != "unknown":
            fill = fill_value(data, c, numeric).where("fill is not null").crossJoin(imputation_confidence(data, c, in_frame=True))
            value = {"number": F.round("fill", 6)} if numeric else {"text": F.col("fill").cast("string")}
            how = "median" if numeric else "mode"
            found.append(proposal(fill, f"impute_{c}", f"missing_{c}", "impute_missing", c, how, why_impute(c, how, purpose), **value))
        if numeric:
            found.append(proposal(outlier_confidence(data, c), f"investigate_{c}_outliers", f"unusual:{c}", "flag_for_review", c, "flag", WHY_FLAG))
    return reduce(DataFrame.unionByName, found).join(seen.select("issue_id"), "issue_id", "left_semi").select(*found[0].columns)


RECORD = ("proposal_id", "issue_id", "row_id", "field", "before", "after", "reason")


@nan_free
def apply_cleaning(df: DataFrame, row: str, approved: Sequence[str], purpose: str | None = None, onto: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and its change records: proposal_id, issue_id, row_id, field,
    before, after, reason.  A removed row's ``before`` is its JSON; an imputed cell's is
    null, as it had no value.  Both are worked out from ``df``, which doesn't change;
    what isn't proposed isn't done, so nothing is imputed for the purpose "unknown".
    ``onto`` is ``df`` itself, observed, if its rows are counted on the way."""
    columns, numbers = _data_columns(df, row), _of_type(df, row, T.NumericType)
    nothing = F.lit(None).cast("string")

    def record(frame: DataFrame, name: str, issue_id: str, why: str, field: Column = nothing, before: Column = nothing, after: Column = nothing) -> DataFrame:
        cells = F.lit(name), F.lit(issue_id), q(row), field, before, after, F.lit(why)
        return frame.select(*(c.alias(n) for c, n in zip(cells, RECORD)))

    cleaned, records = df if onto is None else onto, record(df.limit(0), "", "", "")
    if "remove_duplicate_rows" in approved:
        gone = duplicates(df, columns, row)
        cleaned = cleaned.join(gone.select(q(row)), row, "left_anti").select(*map(q, df.columns))
        records = records.unionByName(record(gone, "remove_duplicate_rows", "duplicate_rows", WHY_REMOVE, before=F.to_json(F.struct(*map(q, columns)))))
    for c in (c for c in columns if f"impute_{c}" in approved and purpose != "unknown"):
        fill, how = F.broadcast(fill_value(df, c, c in numbers)), "median" if c in numbers else "mode"
        cleaned = cleaned.crossJoin(fill).withColumn(c, F.coalesce(q(c), "fill")).drop("fill")
        records = records.unionByName(record(df.where(q(c).isNull()).crossJoin(fill), f"impute_{c}", f"missing_{c}", why_impute(c, how, purpose), F.lit(c), after=F.col("fill").cast("string")))
    return cleaned, records


def statuses(proposed: DataFrame, decisions: DataFrame) -> DataFrame:
    """``proposed`` with status: approved, rejected, deferred or proposed.
    ``decisions``: proposal_id, action (APPROVE, REJECT, DEFER; the first of these wins)."""
    place = F.when(F.col("act") == "APPROVE", 1).when(F.col("act") == "REJECT", 2).when(F.col("act") == "DEFER", 3)
    first = decisions.select("proposal_id", F.upper("action").alias("act")).groupBy("proposal_id").agg(F.min(place).alias("_place"))
    status = F.coalesce(F.get(F.array(*map(F.lit, ("", "approved", "rejected", "deferred"))), F.col("_place")), F.lit("proposed"))
    return proposed.join(first, "proposal_id", "left").withColumn("status", status).drop("_place")


def unresolved(found: DataFrame, decided: DataFrame) -> DataFrame:
    """The issues without an approved proposal."""
    return found.join(decided.where("status = 'approved'").select("issue_id"), "issue_id", "left_anti").select(*found.columns)


def introduced(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """kind, field, message of the issues whose kind and field weren't there before."""
    before = old.select(F.col("kind").alias("k"), F.col("field").alias("f"))
    new = fresh.join(before, (F.col("kind") == F.col("k")) & F.col("field").eqNullSafe(F.col("f")), "left_anti")
    where = F.when(F.col("field").isNull(), "dataset").otherwise(F.concat(F.lit("'"), "field", F.lit("'")))
    said = F.concat(F.lit("New issue after cleaning — "), "kind", F.lit(" in "), where, F.lit(": "), "message")
    return new.groupBy("kind", "field").agg(F.min(said).alias("message"))


@nan_free
def new_issues(before: DataFrame, after: DataFrame, row: str) -> DataFrame:
    """What ``introduced`` gives for a table and its cleaned form; none for a table without
    rows."""
    rows = F.broadcast(after.agg(F.count("*").alias("_rows")))
    return introduced(issues(before, row), issues(after, row)).crossJoin(rows).where("_rows > 0").drop("_rows")


@nan_free
def snapshot(df: DataFrame, row: str) -> DataFrame:
    """row_count, column_count, duplicate_rows, missing (in all columns)."""
    columns = _data_columns(df, row)
    gaps = df.agg(sum((F.count_if(q(c).isNull()) for c in columns), F.lit(0)).cast("long").alias("missing"))
    return profile.dataset_counts(df.select(*map(q, columns))).crossJoin(gaps)


def column_counts(df: DataFrame, row: str) -> list[Column]:
    """Aggregates for an observation: rows, and the gaps of each column."""
    kinds = dict(df.dtypes)
    gap = lambda c: q(c).isNull() | F.isnan(q(c)) if kinds[c] in ("double", "float") else q(c).isNull()
    return [F.count(F.lit(1)).alias("rows"), *(F.sum(F.when(gap(c), 1).otherwise(0)).alias(f"gaps_{i}") for i, c in enumerate(_data_columns(df, row)))]


# --- impact -------------------------------------------------------------------


@nan_free
def shifts(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, kind (numeric, categorical, not_computed), n_before, n_after,
    mean_shift, std_before, std_shift, ks, tvd, added, removed of each column; figures
    of the other kind are null."""
    none, names = F.lit(None).cast("double"), F.lit(None).cast("array<string>")
    found = []
    for c in columns:
        kind = before.schema[c].dataType
        counts = before.agg(F.count(q(c)).alias("n_before")).crossJoin(after.agg(F.count(q(c)).alias("n_after")))
        if isinstance(kind, T.NumericType):
            sides = [d.agg(F.coalesce(F.avg(q(c)), F.lit(0.0)).alias(f"m{k}"), F.coalesce(F.stddev_samp(q(c)), F.lit(0.0)).alias(f"s{k}")) for k, d in enumerate((before, after))]
            one = counts.crossJoin(sides[0]).crossJoin(sides[1]).crossJoin(ks_distance(before, after, c))
            cells = F.lit("numeric"), F.round(F.col("m1") - F.col("m0"), 4), F.round("s0", 4), F.round(F.col("s1") - F.col("s0"), 4), F.col("ks"), none, names, names
        else:
            one = counts.crossJoin(category_shift(before, after, c)).crossJoin(before.agg(F.count_distinct(q(c)).alias("u"), F.count("*").alias("rows")))
            few = F.lit(isinstance(kind, T.BooleanType)) | (F.lit(isinstance(kind, T.StringType)) & (F.col("u") <= F.greatest(F.lit(20), F.floor(F.col("rows") * 0.2))))
            cells = F.when(few, "categorical").otherwise("not_computed"), none, none, none, none, F.when(few, F.round("tvd", 4)), F.when(few, F.col("added")), F.when(few, F.col("removed"))
        found.append(one.select(F.lit(c).alias("column_name"), cells[0].alias("kind"), "n_before", "n_after", *(x.alias(n) for x, n in zip(cells[1:], ("mean_shift", "std_before", "std_shift", "ks", "tvd", "added", "removed")))))
    return reduce(DataFrame.unionByName, found)


def loss_notes(shifted: DataFrame, changes: DataFrame) -> DataFrame:
    """column_name, note of what cleaning may have lost in the columns it changed: a
    deviation that moved by more than a tenth, rows that went, shares that shifted."""
    touched = changes.where("field is not null").select(F.col("field").alias("column_name")).distinct()
    removed = F.broadcast(changes.agg(F.bool_or(F.col("field").isNull()).alias("_gone")))
    rows = shifted.join(touched, "column_name").crossJoin(removed)
    share = F.abs(F.try_divide("std_shift", F.nullif("std_before", F.lit(0.0))))
    said = lambda *parts: F.concat(F.lit("'"), "column_name", F.lit("': "), *parts)
    spread = F.when(share > STD_SHIFT, said(F.lit("standard deviation changed by "), F.round(share * 100, 1).cast("string"), F.lit("% after cleaning")))
    fewer = F.when((F.col("kind") == "numeric") & F.col("_gone") & (F.col("n_after") < F.col("n_before")), said(F.lit("sample size reduced from "), F.col("n_before").cast("string"), F.lit(" to "), F.col("n_after").cast("string"), F.lit(" due to row removal")))
    moved = F.when(F.col("tvd") > TVD_NOTED, said(F.lit("category distribution shifted with Total Variation Distance "), F.format_string("%.4f", F.col("tvd"))))
    return rows.select("column_name", F.explode(F.array_compact(F.array(spread, fewer, moved))).alias("note"))


@nan_free
def ks_distance(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance to four digits, from counts of distinct
    values; 0 where a side has no values."""
    both = before.select(q(column).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select(q(column).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("v is not null")
    counted = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = F.broadcast(counted.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))
    d = F.abs(F.try_divide("upto_a", "na") - F.try_divide("upto_b", "nb"))
    return order.running(counted, "v", "a", "b").crossJoin(whole).agg(F.round(F.coalesce(F.max(d), F.lit(0.0)), 4).alias("ks"))


def _shares(df: DataFrame, column: str, name: str) -> DataFrame:
    counted = df.where(q(column).isNotNull()).groupBy(q(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total")))).select("v", F.try_divide("n", "total").alias(name))


@nan_free
def category_shift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """tvd, and the categories that came and went, in order."""
    both = _shares(before, column, "p").join(_shares(after, column, "r"), "v", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    only = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNull(), F.col("v"))))
    return both.agg(F.coalesce(F.sum(F.abs(zero("p") - zero("r"))) / 2, F.lit(0.0)).alias("tvd"), only("p").alias("added"), only("r").alias("removed"))


@nan_free
def total_variation(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    both = _shares(before, column, "p").join(_shares(after, column, "r"), "v", "full_outer").fillna(0.0, ["p", "r"])
    return both.agg(F.round(F.coalesce(F.sum(F.abs(F.col("p") - F.col("r"))) / 2, F.lit(0.0)), 6).alias("tvd"), F.count_if(F.col("p") == 0).alias("added"), F.count_if(F.col("r") == 0).alias("removed"))


@nan_free
def moment_shift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    s = lambda df, k: df.agg(F.count(q(column)).alias(f"n_{k}"), F.avg(q(column)).alias(f"m_{k}"), F.stddev_samp(q(column)).alias(f"s_{k}"))
    both = s(before, "before").crossJoin(s(after, "after"))
    return both.select("n_before", "n_after", F.round(F.col("m_after") - F.col("m_before"), 6).alias("mean_shift"), F.round(F.try_divide(F.col("s_after") - F.col("s_before"), F.nullif("s_before", F.lit(0.0))), 6).alias("std_shift"))
