"""Cleaning as one call: propose, decide, apply, validate.

What the table held before and after is counted by the pass that writes the cleaned
table (``observe``); the rest of a phase reads tables that an earlier one wrote.  All
of them stay in one folder, so a later call can go on from there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import kept
from . import cleaning
from .query import missing_free

# How far a validation goes.
RECHECKED = (
    "Re-detection covers duplicates, missingness, mixed-type values, statistical outliers, and candidate-identifier conflicts on the cleaned frame; "
    "it does not re-run semantic candidate generation or human confirmation state, which are unaffected by transformation actions."
)
NOTHING_LEFT = "Re-detection for newly introduced issues skipped: cleaned dataset has 0 rows."
APPROXIMATE = "Downstream impact is approximated."
SNAPSHOT = "phase string, column_name string, data_type string, row_count long, missing long"


@dataclass(frozen=True)
class Cleaned:
    """``issues`` with ``rows`` as ``cleaning.issue_rows`` names them, ``proposals`` with
    their status, the ``table`` and its ``changes``, what stays ``unresolved``;
    ``snapshots``: phase, column_name, data_type, row_count, missing; ``checks``: section,
    text of the validation; ``shifts`` and ``notes`` of the impact."""

    issues: DataFrame
    proposals: DataFrame
    table: DataFrame
    changes: DataFrame
    unresolved: DataFrame
    snapshots: DataFrame
    checks: DataFrame
    shifts: DataFrame
    notes: DataFrame


def propose(df: DataFrame, row: str, folder: str, purpose: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The issues and proposals of a table, written below ``folder``."""
    df = missing_free(df)
    found = kept(cleaning.issues(df, row), folder, "issues")
    return found, kept(cleaning.proposals(df, row, purpose, found), folder, "proposals")


def apply(df: DataFrame, row: str, approved: Sequence[str], folder: str, purpose: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cleaned table, its changes and the snapshots, written below ``folder``.  The
    snapshots are counted while the table is written, so they are of the very rows that
    were read and written; a task that is run again after a lost executor may count twice."""
    df = missing_free(df)
    before, after = Observation(), Observation()
    seen = df.observe(before, *cleaning.column_counts(df, row))
    cleaned, changes = cleaning.apply_cleaning(df, row, approved, purpose, seen)
    table = kept(cleaned.observe(after, *cleaning.column_counts(cleaned, row)), folder, "cleaned")
    columns = [c for c in df.columns if c != row]
    rows = []
    for phase, frame, counts in (("before", df, before.get), ("after", table, after.get)):
        kinds = dict(frame.dtypes)
        rows += [(phase, c, kinds[c], counts["rows"], counts[f"gaps_{i}"] or 0) for i, c in enumerate(columns)]
    return table, kept(changes, folder, "changes"), df.sparkSession.createDataFrame(rows, SNAPSHOT)


def validate(spark: SparkSession, found: DataFrame, table: DataFrame, row: str, decided: DataFrame, snapshots: DataFrame, folder: str) -> DataFrame:
    """section, text: the issues addressed, those that are new, the difference in rows, the
    limits of the check."""
    fresh = kept(cleaning.issues(table, row), folder, "issues_after")
    counts = {r.phase: r.row_count for r in snapshots.select("phase", "row_count").distinct().collect()}  # two rows
    says = lambda frame, section: frame.select(F.lit(section).alias("section"), "text")
    addressed = says(decided.where("status = 'approved'").select(F.col("issue_id").alias("text")).distinct(), "addressed")
    new = says(cleaning.introduced(found, fresh).select(F.col("message").alias("text")), "introduced")
    empty = not counts.get("after")
    fixed = [("row_count_diff", str(counts.get("after", 0) - counts.get("before", 0))), ("limitation", NOTHING_LEFT if empty else RECHECKED), ("limitation", APPROXIMATE)]
    return addressed.unionByName(new.limit(0) if empty else new).unionByName(spark.createDataFrame(fixed, "section string, text string"))


def clean(df: DataFrame, row: str, decisions: DataFrame, folder: str, purpose: str | None = None) -> Cleaned:
    """``decisions``: proposal_id, action.  Proposals are as many as columns, at most
    thrice; which are approved is asked for."""
    df = missing_free(df)
    found, proposed = propose(df, row, folder, purpose)
    decided = kept(cleaning.statuses(proposed, decisions), folder, "decided")
    approved = [r.proposal_id for r in decided.where("status = 'approved'").select("proposal_id").collect()]
    table, changes, snapshots = apply(df, row, approved, folder, purpose)
    checks = validate(df.sparkSession, found, table, row, decided, snapshots, folder)
    shifts = kept(cleaning.shifts(df, table, [c for c in df.columns if c != row]), folder, "shifts")
    return Cleaned(found, decided, table, changes, cleaning.unresolved(found, decided), snapshots, checks, shifts, cleaning.loss_notes(shifts, changes))


def report(done: Cleaned) -> DataFrame:
    """section, name, value: a cleaning's outcome as one long table."""
    status = done.proposals.select(F.lit("proposal").alias("section"), F.col("proposal_id").alias("name"), F.col("status").alias("value"))
    open_ = done.unresolved.select(F.lit("unresolved").alias("section"), F.col("issue_id").alias("name"), F.col("kind").alias("value"))
    checks = done.checks.select("section", F.lit("").alias("name"), F.col("text").alias("value"))
    sizes = done.snapshots.select(F.concat(F.lit("missing_"), "phase").alias("section"), F.col("column_name").alias("name"), F.concat(F.col("missing").cast("string"), F.lit(" of "), F.col("row_count").cast("string")).alias("value"))
    counts = done.changes.groupBy("proposal_id").agg(F.count("*").alias("n")).select(F.lit("changes").alias("section"), F.col("proposal_id").alias("name"), F.col("n").cast("string").alias("value"))
    return status.unionByName(open_).unionByName(checks).unionByName(sizes).unionByName(counts)
