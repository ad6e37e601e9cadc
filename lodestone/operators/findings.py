"""Findings of a dataset, what to do next, candidates of meaning, and relevance.

Frames here have a row for each column, pair of columns or finding; which columns are
numbers or categories is asked first, one small row per column.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SKEWED, SPARSE
from . import profile, relate
from .query import nan_free, q

FIELDS = "finding_id string, category string, subject string, observation string, method string, state string, subjects array<string>, result map<string,double>, limitations array<string>, assumptions array<string>"
# What a finding doesn't say, and what it takes for granted.
NO_ERROR = "Unusualness is not evidence of error."
REVIEW = "The non-numeric values require domain review before conversion."
CONFIRM = "Confirm with dataset context."
GROUPING = "Grouping candidacy is inferred from low cardinality; confirm its meaning."
TARGET = "Target candidacy is inferred from name/type and is not a causal claim."
NO_CAUSE = "Association does not establish causation or practical importance."
DESCRIPTIVE = "This is descriptive and does not establish causation."
GROUPED = "Observations are grouped by categorical levels."
DIFFERENT = "Group differences are descriptive and do not establish causation."
TIMES = "Temporal semantics and sampling intent require confirmation."
# Name parts that mean a time or a unit.
TIME_WORDS = ("date", "datetime", "timestamp", "time")
UNITS = ("kg", "g", "mg", "mm", "cm", "m", "s", "min", "h", "hz", "%")


def _row(finding_id: Column, category: str, subject: Column | Sequence[Column], observation: Column, method: Column | str, state: str, result: dict[str, Column] | None = None, limits: Sequence[str] = (), given: Sequence[str] = ()) -> Column:
    """A finding; ``subject`` is a column's name, or two, ``result`` its figures."""
    method = F.lit(method) if isinstance(method, str) else method
    subjects = [subject] if isinstance(subject, Column) else list(subject)
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    figures = F.create_map(*(x for k, v in (result or {}).items() for x in (F.lit(k), v.cast("double")))).cast("map<string,double>")
    return F.struct(
        finding_id.alias("finding_id"), F.lit(category).alias("category"), F.concat_ws(",", *subjects).alias("subject"), observation.alias("observation"), method.alias("method"), F.lit(state).alias("state"),
        F.array(*subjects).alias("subjects"), figures.alias("result"), texts(limits).alias("limitations"), texts(given).alias("assumptions"),
    )


def _said(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _out(frame: DataFrame, *rows: Column) -> DataFrame:
    return frame.select(F.explode(F.array_compact(F.array(*rows))).alias("f")).select("f.*")


def _percent(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)


# Fixed values, in the functions below: the ids of findings, their methods and the texts of
# their observations.


@nan_free
def attribute_findings(df: DataFrame) -> DataFrame:
    """Gaps, emptiness, candidate roles, outliers, skew, mixed texts, times: by column."""
    name, facts = F.col("column_name"), profile.column_facts(df)
    kinds = {r.column_name: r.kind for r in profile.with_kinds(facts).select("column_name", "kind").collect()}  # one row for each column
    whole = profile.with_roles(facts)
    share = F.round(F.try_divide(F.col("numbers"), F.col("non_null")), 6)
    found = [_out(
        whole,
        F.when(F.col("missing") > 0, _row(_said("missing:", name), "quality", name, _said(F.col("missing"), " value(s) are missing."), "missingness_count", "statistical", {"missing_count": F.col("missing"), "missing_rate": F.col("missing_rate")})),
        F.when(F.col("unique_count") == 0, _row(_said("empty:", name), "quality", name, F.lit("The attribute contains no observed values."), "non_null_count", "observed", {"count": F.lit(0)})),
        F.when(F.col("missing_rate") >= SPARSE, _row(_said("sparse:", name), "quality", name, _said("Column '", name, "' is sparse with ", _percent(F.col("missing_rate")), " missing values."), "missingness_rate", "observed", {"missing_rate": F.col("missing_rate")})),
        F.when(F.col("candidate_identifier"), _row(_said("role:", name), "structure", name, F.lit("The attribute is a candidate identifier based on uniqueness and naming."), "uniqueness_and_name_heuristic", "inferred", limits=[CONFIRM])),
        F.when(F.col("candidate_grouping"), _row(_said("group:", name), "structure", name, _said("Column '", name, "' may define groups for stratified analysis."), "cardinality_heuristic", "inferred", limits=[GROUPING])),
        F.when(F.col("candidate_target"), _row(_said("target:", name), "structure", name, _said("Column '", name, "' may be a target or outcome variable."), "name_heuristic", "inferred", limits=[TARGET])),
        F.when((F.col("type") == "string") & (share > 0) & (share < 1), _row(_said("mixed_values:", name), "quality", name, _said("Column '", name, "' mixes numeric-like and non-numeric values (", _percent(share), " parse as numbers)."), "numeric_parse_fraction", "observed", {"numeric_parse_fraction": share}, [REVIEW])),
    )]
    numbers = [c for c in df.columns if kinds[c] == "numeric"]
    found.append(_out(
        profile.shapes(df, numbers),
        F.when(F.col("iqr_outliers") > 0, _row(_said("unusual:", name), "distribution", name, _said(F.col("iqr_outliers"), " observation(s) are potentially unusual under the IQR rule."), "IQR_1.5", "statistical", {"count": F.col("iqr_outliers"), "mad_count": F.col("mad_outliers")}, [NO_ERROR])),
        F.when(F.abs("skewness") >= SKEWED, _row(_said("skew:", name), "shape", name, _said("Column '", name, "' is strongly skewed (skewness ", F.format_string("%.2f", F.col("skewness")), ")."), "sample_skewness", "statistical", {"skewness": F.col("skewness")})),
    ))
    times = [c for c in df.columns if kinds[c] == "temporal"]
    if times:
        read = {c: profile.parsed_time(q(c)) if dict(df.dtypes)[c] == "string" else q(c).cast("timestamp") for c in times}
        cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.min(t).alias("a"), F.max(t).alias("b"), F.count(t).alias("n")) for c, t in read.items()))
        span = df.agg(cells.alias("cells")).select(F.explode("cells").alias("s")).select("s.*")
        said = _said("The attribute has parseable temporal values covering ", F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss"), " to ", F.date_format("b", "yyyy-MM-dd'T'HH:mm:ss"), ".")
        found.append(_out(span, F.when(F.col("n") >= 2, _row(_said("temporal:", name), "temporal", name, said, "timestamp_parsing_and_ordering", "observed", {"count": F.col("n")}, [TIMES]))))
    return reduce(DataFrame.unionByName, found)


@nan_free
def relationship_findings(df: DataFrame) -> DataFrame:
    """Strong correlations, notable associations, differences between groups' means."""
    kinds = {r.column_name: r.kind for r in profile.column_kinds(df).collect()}
    numbers = [c for c in df.columns if kinds[c] == "numeric"]
    groups = [c for c in df.columns if kinds[c] in ("categorical", "boolean")]
    both, pair = (lambda a: _said(a, F.col("left_column"), ":", F.col("right_column"))), (F.col("left_column"), F.col("right_column"))
    value = F.when(F.col("method") == "pearson", F.col("pearson")).otherwise(F.col("spearman"))
    found = [
        _out(relate.relationships(df, numbers), _row(both("relationship:"), "relationship", pair, _said("The attributes have a strong observed ", F.col("method"), " association (", F.format_string("%.3f", value), ")."), F.col("method"), "statistical", {k: F.col(k) for k in ("pearson", "spearman", "n")}, [NO_CAUSE])),
        _out(relate.associations(df, groups), _row(both("association:"), "relationship", pair, _said("The categorical attributes show an observed association (Cramer's V ", F.format_string("%.3f", F.col("v")), ")."), "contingency_table_cramers_v", "statistical", {"cramers_v": F.col("v"), "chi_square": F.col("chi_square"), "expected_frequency_min": F.col("expected_min"), "n": F.col("n")}, [DESCRIPTIVE])),
    ]
    a, b = F.col("category"), F.col("column_name")
    said = _said("Mean '", b, "' differs across '", a, "' groups (spread ", F.format_string("%.2f", F.col("spread")), ").")
    apart = (F.col("groups") >= 2) & (F.col("spread") != 0)
    found.append(_out(relate.group_spreads(df, groups, numbers), F.when(apart, _row(_said("group_difference:", a, ":", b), "group_difference", (a, b), said, "group_mean_spread", "observed", {"mean_spread": F.col("spread")}, [DIFFERENT], [GROUPED]))))
    return reduce(DataFrame.unionByName, found)


@nan_free
def dataset_findings(df: DataFrame) -> DataFrame:
    """Repeated rows, no rows, no columns."""
    if not df.columns:
        return _out(df.sparkSession.range(1), _row(F.lit("empty_schema"), "quality", F.lit("dataset"), F.lit("The dataset has no columns."), "shape_inspection", "observed"))
    return _out(
        profile.dataset_counts(df),
        F.when(F.col("duplicate_rows") > 0, _row(F.lit("duplicate_rows"), "quality", F.lit("dataset"), _said(F.col("duplicate_rows"), " duplicate row(s) were observed."), "duplicate_row_count", "observed")),
        F.when(F.col("row_count") == 0, _row(F.lit("empty_dataset"), "quality", F.lit("dataset"), F.lit("The dataset has no rows."), "shape_inspection", "observed")),
    )


def findings(df: DataFrame) -> DataFrame:
    """All findings: finding_id, category, subject (columns' names, at commas), observation,
    method, state, subjects, result (figures by name), limitations, assumptions."""
    return attribute_findings(df).unionByName(relationship_findings(df)).unionByName(dataset_findings(df))


def next_actions(df: DataFrame, found: DataFrame) -> DataFrame:
    """action, available, reason: five suggestions from a dataset's kinds and findings."""
    facts = profile.roles(df).agg(F.count_if(F.col("kind") == "numeric").alias("numbers"), F.count_if(F.col("kind").isin("text", "categorical")).alias("texts"), F.coalesce(F.bool_or("candidate_target"), F.lit(False)).alias("target"))
    facts = facts.crossJoin(F.broadcast(found.agg(F.coalesce(F.bool_or(F.col("category") == "quality"), F.lit(False)).alias("quality"))))
    rule = lambda name, on, yes, no: F.struct(F.lit(name).alias("action"), on.alias("available"), F.when(on, yes).otherwise(no).alias("reason"))
    rules = F.array(
        rule("clean_prepare", F.col("quality"), "Quality findings exist.", "No immediate quality issue was detected."),
        rule("analyse", F.col("numbers") >= 1, "At least one numeric variable is available.", "No numeric variable was detected."),
        rule("explore_retrieve", F.col("texts") >= 1, "Categorical or text information is available.", "No text-like variable was detected."),
        rule("build_prediction", F.col("target") & (F.col("numbers") >= 2), "A candidate numeric target and predictors exist.", "No sufficiently supported numeric target/predictor set was detected."),
        rule("generate_report", F.lit(True), "A structured profile is available for reporting.", ""),
    )
    return facts.select(F.explode(rules).alias("r")).select("r.*")


# --- meaning --------------------------------------------------------------------


def candidates(roles: DataFrame, context: Mapping[str, str] | None = None) -> DataFrame:
    """candidate_id, attribute, meaning, kind, method, confidence: cautious readings of
    columns by supplied context, role, name and kind.  ``roles``: of ``profile.roles``."""
    name = F.col("column_name")
    parts = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "_"), lambda p: p != ""))
    given = [F.when(name == k, F.lit(v)) for k, v in (context or {}).items() if v]
    meaning = F.coalesce(*given) if given else F.lit(None).cast("string")
    unit = F.get(F.filter(parts, lambda p: p.isin(*UNITS)), F.lit(0))

    def reading(on: Column, role: str, meaning: Column | str, kind: str, method: str, confidence: float) -> Column:
        meaning = F.lit(meaning) if isinstance(meaning, str) else meaning
        return F.when(on, F.struct(_said(name, f":{role}").alias("candidate_id"), name.alias("attribute"), meaning.alias("meaning"), F.lit(kind).alias("kind"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))

    return _out(
        roles,
        reading(meaning.isNotNull(), "context", meaning, "context", "user_provided_context", 1.0),
        reading(F.col("candidate_identifier"), "entity", "record or entity identifier", "entity", "structural_role_candidate", 0.7),
        reading(F.arrays_overlap(parts, F.array(*map(F.lit, TIME_WORDS))) | (F.col("kind") == "temporal"), "temporal", "time-related attribute", "temporal", "name_and_observed_type", 0.65),
        reading(unit.isNotNull(), "unit", _said("values may use unit '", unit, "'"), "unit", "attribute_name_pattern", 0.55),
        reading(F.col("kind") == "numeric", "metric", "numeric property or measurement", "metric", "observed_numeric_type", 0.5),
        reading(F.col("kind").isin("categorical", "boolean"), "categorical", "categorical or state property", "property", "observed_value_domain", 0.45),
    )


def confirmation_states(records: DataFrame) -> DataFrame:
    """candidate_id, state: what the latest record of each candidate says.  ``records``:
    candidate_id, seq, action (confirm, modify, reject, unknown, conflict)."""
    last = records.groupBy("candidate_id").agg(F.max_by("action", "seq").alias("action"))
    return last.select("candidate_id", F.when(F.col("action").isin("confirm", "modify"), "confirmed").when(F.col("action") == "conflict", "conflicting").otherwise("unknown").alias("state"))


def attribute_states(proposed: DataFrame, states: DataFrame) -> DataFrame:
    """attribute, state: of each attribute's candidates the one that says most, from
    inferred over unknown and conflicting to confirmed."""
    place = F.when(F.col("state") == "confirmed", 4).when(F.col("state") == "conflicting", 3).when(F.col("state") == "unknown", 2).otherwise(1)
    both = proposed.join(states, "candidate_id", "left").groupBy("attribute").agg(F.max(place).alias("p"))
    return both.select("attribute", F.get(F.array(*map(F.lit, ("", "INFERRED", "UNKNOWN", "CONFLICTING", "USER_CONFIRMED"))), F.col("p")).alias("state"))


def relevance(counts: DataFrame, found: DataFrame, objective: str, selected: tuple[str, ...] = ()) -> DataFrame:
    """attribute, score, category: how a column bears on one stated objective.
    ``counts``: of ``profile.attribute_counts``; ``found``: of ``findings``."""
    if not objective.strip():
        raise ValueError("objective must be non-empty")
    wanted = F.array(*map(F.lit, sorted(set(re.findall("[a-z0-9]+", objective.lower())))))
    related = found.where("category = 'relationship'").select(F.explode("subjects").alias("column_name")).groupBy("column_name").agg(F.count("*").alias("relations"))
    rows = counts.join(related, "column_name", "left")
    chosen = F.col("column_name").isin(*selected) if selected else F.lit(False)
    named = F.arrays_overlap(F.regexp_extract_all(F.lower("column_name"), F.lit("[a-z0-9]+"), F.lit(0)), wanted)
    tied, sparse = F.coalesce(F.col("relations"), F.lit(0)), F.col("missing_rate") >= SPARSE
    score = F.round(F.when(chosen, 0.8).otherwise(0.0) + F.when(named, 0.4).otherwise(0.0) + F.least(F.lit(0.3), 0.1 * tied) - F.when(sparse, 0.2).otherwise(0.0), 6)
    category = F.when(score >= 0.7, "potentially_relevant").when((score <= 0.1) & ~chosen & ~named & (tied == 0) & ~sparse, "potentially_irrelevant").when(chosen, "selected").otherwise("requires_clarification")
    return rows.select(F.col("column_name").alias("attribute"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), category.alias("category"))
