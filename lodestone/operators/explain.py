"""Findings in words: messages by templates, contexts of columns, summaries.

A template is chosen by the longest prefix of a finding's id and filled from its figures
and columns; a finding without one keeps its observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefix of the id, the id's new beginning, category, kind, message.
# {name} is a column, {figure} a whole number, {figure:2} one with two digits, {figure:%} a share.
TEMPLATES = (
    ("unusual:", "outliers_", "statistical", "observation", "Column '{column}' contains {count} IQR-based statistical outlier(s)."),
    ("skew:", "skew_", "statistical", "observation", "Column '{column}' is strongly skewed (skewness {skewness:2})."),
    ("missing:", "missing_", "quality", "observation", "Column '{column}' has {missing_count} missing value(s)."),
    ("sparse:", "sparse_", "quality", "observation", None),
    ("mixed_values:", "mixed_values_", "quality", "observation", "Column '{column}' mixes numeric-like and non-numeric values ({numeric_parse_fraction:%} parse as numbers)."),
    ("relationship:", "relationship_", "relationship", "observation", "'{left}' and '{right}' have a strong observed {method} correlation ({chosen:3})."),
    ("association:", "association_", "relationship", "observation", "'{left}' and '{right}' show an observed categorical association (Cramer's V {cramers_v:3})."),
    ("group_difference:", "group_difference_", "relationship", "observation", "Mean '{right}' differs across '{left}' groups (spread {mean_spread:2})."),
    ("role:", "identifier_", "logical", "interpretation", None),
    ("temporal:", "temporal_", "logical", "interpretation", None),
    ("target:", "target_", "logical", "interpretation", None),
    ("group:", "group_", "logical", "interpretation", None),
)
TEMPLATE = "prefix string, start string, _category string, _kind string, template string"
PARTS = "KEY STATISTICS", "KEY FINDINGS", "ANOMALIES", "EVALUATION", "LIMITATIONS"


def filled(template: Column, names: Column, figures: Column) -> Column:
    """A template with its places filled: ``names`` map to texts, ``figures`` to numbers."""
    place = lambda key, form: F.concat(F.lit("{"), key, F.lit(form + "}"))
    put = lambda text, key, value: F.replace(text, key, value)
    named = F.aggregate(F.map_entries(names), template, lambda t, e: put(t, place(e["key"], ""), e["value"]))

    def number(t: Column, e: Column) -> Column:
        key, x = e["key"], F.coalesce(e["value"], F.lit(0.0))
        t = put(t, place(key, ""), x.cast("long").cast("string"))
        for digits in (2, 3):
            t = put(t, place(key, f":{digits}"), F.format_string(f"%.{digits}f", x))
        return put(t, place(key, ":%"), F.concat(F.round(x * 100).cast("long").cast("string"), F.lit("%")))

    return F.aggregate(F.map_entries(figures), named, number)


def explained(found: DataFrame, source: str = "eda") -> DataFrame:
    """finding_id, source, category, kind, message, limitations of findings (of
    ``findings.findings``), each as a reader of explanations knows it."""
    known = found.sparkSession.createDataFrame(TEMPLATES, TEMPLATE)  # a dozen rows
    fits = F.startswith(F.col("finding_id"), F.col("prefix"))
    best = F.max_by(F.struct(*(c.split()[0] for c in TEMPLATE.split(", "))), F.length("prefix"))
    chosen = found.select("finding_id").distinct().join(F.broadcast(known), fits).groupBy("finding_id").agg(best.alias("_t"))
    rows = found.join(chosen, "finding_id", "left")
    first, second = F.get("subjects", F.lit(0)), F.get("subjects", F.lit(1))
    names = F.map_filter(F.create_map(F.lit("column"), first, F.lit("left"), first, F.lit("right"), second, F.lit("method"), F.col("method")), lambda k, v: v.isNotNull())
    # A relationship's figure is that of its method.
    picked = F.element_at("result", F.when(F.col("method").isin("pearson", "spearman"), F.col("method")).otherwise(F.lit("")))
    figures = F.map_concat("result", F.create_map(F.lit("chosen"), picked))
    rest = F.translate(F.expr("substring(finding_id, length(_t.prefix) + 1)"), ":", "_")
    return rows.select(
        F.coalesce(F.concat("_t.start", rest), "finding_id").alias("finding_id"), F.lit(source).alias("source"), F.coalesce("_t._category", "category").alias("category"), F.coalesce("_t._kind", F.lit("observation")).alias("kind"),
        F.coalesce(filled(F.col("_t.template"), names, figures), "observation").alias("message"), "limitations",
    )


def explained_issues(found: DataFrame) -> DataFrame:
    """What ``explained`` gives, of cleaning issues (of ``cleaning.issues``)."""
    outlier = F.startswith(F.col("issue_id"), F.lit("unusual:"))
    renamed = F.when(outlier, F.concat(F.lit("outliers_"), F.substring_index("issue_id", "unusual:", -1))).otherwise(F.col("issue_id"))
    return found.select(renamed.alias("finding_id"), F.lit("cleaning_issue").alias("source"), F.col("kind").alias("category"), F.lit("observation").alias("kind"), "message", F.array().cast("array<string>").alias("limitations"))


def contexts(counts: DataFrame, kinds: DataFrame, found: DataFrame, candidates: DataFrame, states: DataFrame) -> DataFrame:
    """One nested row for each column: attribute, kind, counts, quality, anomalies and
    relationships (arrays of finding_id, observation), candidates (of candidate_id,
    meaning, confidence) and status, which is UNKNOWN without a candidate.

    All parts are put under each other and grouped once.  ``counts``:
    ``profile.attribute_counts``; ``kinds``: ``profile.column_kinds``; ``found``:
    ``findings.findings``; ``candidates`` and ``states``: ``findings.candidates`` and
    ``findings.attribute_states``."""
    none = F.lit(None)
    said, read = "struct<finding_id:string,observation:string>", "struct<candidate_id:string,meaning:string,confidence:double>"
    numbers = "struct<non_null:bigint,missing:bigint,missing_rate:double,unique_count:bigint,cardinality:double>"
    parts = {"kind": "string", "counts": numbers, "quality": said, "anomalies": said, "relationships": said, "candidates": read, "status": "string"}

    def part(frame: DataFrame, name: Column | str, **own: Column) -> DataFrame:
        return frame.select(F.col(name).alias("attribute") if isinstance(name, str) else name.alias("attribute"), *((own.get(k, none)).cast(kind).alias(k) for k, kind in parts.items()))

    one = F.struct("finding_id", "observation")
    single = found.where(F.size("subjects") == 1)
    both = found.where((F.size("subjects") == 2) & (F.col("category") == "relationship"))
    rows = [
        part(counts, "column_name", counts=F.struct("non_null", "missing", "missing_rate", "unique_count", "cardinality")),
        part(kinds, "column_name", kind=F.col("kind")),
        part(single.where("category = 'quality'"), "subject", quality=one),
        part(single.where("category = 'distribution' AND contains(finding_id, 'unusual')"), "subject", anomalies=one),
        part(both.select("finding_id", "observation", F.explode("subjects").alias("_s")), "_s", relationships=one),
        part(candidates, "attribute", candidates=F.struct("candidate_id", "meaning", "confidence")),
        part(states, "attribute", status=F.col("state")),
    ]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    lists = [F.sort_array(F.collect_list(k)).alias(k) for k in ("quality", "anomalies", "relationships", "candidates")]
    grouped = whole.groupBy("attribute").agg(F.max("kind").alias("kind"), F.max("counts").alias("counts"), *lists, F.coalesce(F.max("status"), F.lit("UNKNOWN")).alias("status"))
    return grouped.where("counts is not null")


def narrative(report: DataFrame, found: DataFrame, title: str, most: int = 5) -> DataFrame:
    """One row, text: the parts of a workflow's report (section, name, value) and the
    first ``most`` findings' messages (of ``explained``) and limitations, as a reader
    without a model is told."""
    ordered = Window.partitionBy("section").orderBy("name")
    figure = F.concat("name", F.lit(": "), F.format_string("%.4f", F.col("value")))
    figures = report.where(F.col("section").isin("statistics", "anomalies", "evaluation")).withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= most)
    place = F.when(F.col("section") == "statistics", 0).when(F.col("section") == "anomalies", 2).otherwise(3)
    lines = figures.select(place.alias("part"), "_n", F.concat(F.lit("- "), figure).alias("line"))
    messages = found.select("finding_id", "message", "limitations").orderBy("finding_id").limit(most)
    numbered = messages.withColumn("_n", F.row_number().over(Window.orderBy("finding_id")))  # at most ``most`` rows
    lines = lines.unionByName(numbered.select(F.lit(1).alias("part"), "_n", F.concat(F.col("_n").cast("string"), F.lit(". "), "message").alias("line")))
    limits = numbered.select(F.explode("limitations").alias("l")).distinct()
    lines = lines.unionByName(limits.select(F.lit(4).alias("part"), F.lit(0).alias("_n"), F.concat(F.lit("- "), "l").alias("line")))
    parts = lines.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    heads = F.array(*map(F.lit, PARTS))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "body"))), lambda p: F.concat(F.get(heads, p["part"]), F.lit("\n"), p["body"])), "\n\n")
    return parts.agg(F.concat(F.lit(title + "\n\n"), text).alias("text"))
