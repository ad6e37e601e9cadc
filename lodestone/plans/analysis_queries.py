"""Registered queries of findings, next actions, meaning and relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain, findings, profile
from .catalog import EVENTS, _planted, register

#: A table with an identifier, gaps, an empty and a sparse column, skew, outliers, mixed texts and twins.
_SEEN = [
    "event_id AS record_id", "CAST(user_id AS DOUBLE) AS load_kg", "user_id * 2.0D + event_id % 3 AS twin_score", "event_type AS state", "CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS side",
    "CASE WHEN event_id % 3 = 0 THEN exp(event_id % 12) END AS steep", "CASE WHEN event_id % 4 = 0 THEN '17' ELSE 'word' END AS mixed", "CAST(NULL AS STRING) AS nothing", "ts AS timestamp",
]
_SQL = "(SELECT " + ", ".join(_SEEN).replace("2.0D", "CAST(2 AS DOUBLE)").replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)") + f" FROM {EVENTS})"
_NUM, _CAT = ("record_id", "load_kg", "twin_score", "steep"), ("state", "side", "mixed")


def _seen(t):
    return _planted(t).selectExpr(*_SEEN)


_ROWS = [f"SELECT 'missing:{c}' AS finding_id, 'quality' AS category, '{c}' AS subject, n || ' value(s) are missing.' AS observation FROM (SELECT count(*) - count({c}) AS n FROM {_SQL}) WHERE n > 0" for c in ("record_id", "load_kg", "twin_score", "state", "side", "steep", "mixed", "nothing", "timestamp")]
_ROWS += ["SELECT 'empty:nothing', 'quality', 'nothing', 'The attribute contains no observed values.'"]
_ROWS += [f"SELECT 'sparse:{c}', 'quality', '{c}', 'Column ''{c}'' is sparse with ' || printf('%.0f%%', 100 * r) || ' missing values.' FROM (SELECT round(1 - count({c}) / count(*), 6) AS r FROM {_SQL}) WHERE r >= 0.5" for c in ("steep", "nothing")]
_ROWS += ["SELECT 'role:record_id', 'structure', 'record_id', 'The attribute is a candidate identifier based on uniqueness and naming.'"]
_ROWS += [f"SELECT 'group:{c}', 'structure', '{c}', 'Column ''{c}'' may define groups for stratified analysis.' FROM (SELECT count(DISTINCT {c}) AS u, count({c}) AS n FROM {_SQL}) WHERE u BETWEEN 2 AND least(20, greatest(2, floor(n / 5)))" for c in _CAT]
_ROWS += ["SELECT 'target:twin_score', 'structure', 'twin_score', 'Column ''twin_score'' may be a target or outcome variable.'"]
_ROWS += [f"SELECT 'unusual:{c}', 'distribution', '{c}', n || ' observation(s) are potentially unusual under the IQR rule.' FROM (SELECT count(*) AS n FROM {_SQL}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {_SQL}) WHERE q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) WHERE n > 0" for c in _NUM]
_ROWS += [f"SELECT 'skew:{c}', 'shape', '{c}', 'Column ''{c}'' is strongly skewed (skewness ' || printf('%.2f', s) || ').' FROM (SELECT skewness({c}) AS s FROM {_SQL}) WHERE abs(s) >= 1" for c in _NUM]
_ROWS += [f"SELECT 'mixed_values:{c}', 'quality', '{c}', 'Column ''{c}'' mixes numeric-like and non-numeric values (' || printf('%.0f%%', 100 * r) || ' parse as numbers).' FROM (SELECT round(avg(CASE WHEN {c} = '17' THEN 1.0 ELSE 0.0 END), 6) AS r FROM {_SQL}) WHERE r > 0 AND r < 1" for c in _CAT]
_ROWS += [f"SELECT 'temporal:timestamp', 'temporal', 'timestamp', 'The attribute has parseable temporal values covering ' || strftime(min(timestamp), '%Y-%m-%dT%H:%M:%S') || ' to ' || strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S') || '.' FROM {_SQL}"]
_ATTRIBUTES = " UNION ALL ".join(_ROWS)
_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_PAIRS = [
    f"SELECT 'relationship:{a}:{b}' AS finding_id, 'relationship' AS category, '{a},{b}' AS subject, 'The attributes have a strong observed ' || m || ' association (' || printf('%.3f', CASE m WHEN 'pearson' THEN p ELSE r END) || ').' AS observation FROM (SELECT p, r, CASE WHEN abs(p) >= 0.8 THEN 'pearson' ELSE 'spearman' END AS m FROM (SELECT round(corr({a}, {b}), 6) AS p, round(corr(x, y), 6) AS r FROM (SELECT {a}, {b}, {_RANK.format(c=a)} AS x, {_RANK.format(c=b)} AS y FROM {_SQL} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))) WHERE abs(CASE m WHEN 'pearson' THEN p ELSE r END) >= 0.7"
    for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]
]
_PAIRS += [
    f"SELECT 'association:{a}:{b}', 'relationship', '{a},{b}', 'The categorical attributes show an observed association (Cramer''s V ' || printf('%.3f', v) || ').' FROM (WITH c AS (SELECT {a} a, {b} b, count(*) o FROM {_SQL} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), m AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) r, sum(o) OVER (PARTITION BY b) k FROM c) SELECT round(sqrt(greatest(sum(CAST(o AS DOUBLE) * o / (CAST(r AS DOUBLE) * k)) - 1, 0) / greatest(1, least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS v FROM m) WHERE v >= 0.3"
    for i, a in enumerate(_CAT) for b in _CAT[i + 1 :]
]
_PAIRS += [f"SELECT 'group_difference:{a}:{b}', 'group_difference', '{a},{b}', 'Mean ''{b}'' differs across ''{a}'' groups (spread ' || printf('%.2f', d) || ').' FROM (SELECT round(max(m) - min(m), 6) AS d, count(m) AS n FROM (SELECT avg({b}) AS m FROM {_SQL} GROUP BY {a})) WHERE n >= 2 AND d <> 0" for a in _CAT for b in _NUM]
_RELATED = " UNION ALL ".join(_PAIRS)
_SHOWN = ("finding_id", "category", "subject", "observation")
register("attribute_findings", _ATTRIBUTES)(lambda t: findings.attribute_findings(_seen(t)).select(*_SHOWN))
register("relationship_findings", _RELATED)(lambda t: findings.relationship_findings(_seen(t)).select(*_SHOWN))
register("dataset_findings", f"SELECT 'duplicate_rows' AS finding_id, 'quality' AS category, 'dataset' AS subject, n || ' duplicate row(s) were observed.' AS observation FROM (SELECT (SELECT count(*) FROM {EVENTS}) - (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM {EVENTS})) AS n) WHERE n > 0")(lambda t: findings.dataset_findings(_planted(t).select("event_type", "user_id")).select(*_SHOWN))
register("next_actions", "SELECT * FROM (VALUES ('clean_prepare', true, 'Quality findings exist.'), ('analyse', true, 'At least one numeric variable is available.'), ('explore_retrieve', true, 'Categorical or text information is available.'), ('build_prediction', true, 'A candidate numeric target and predictors exist.'), ('generate_report', true, 'A structured profile is available for reporting.')) AS t(action, available, reason)")(
    lambda t: findings.next_actions(_seen(t), findings.attribute_findings(_seen(t))))
_MEANT = [("record_id", "entity", "record or entity identifier", 0.7), ("record_id", "metric", "numeric property or measurement", 0.5), ("load_kg", "context", "weight of the load", 1.0), ("load_kg", "unit", "values may use unit 'kg'", 0.55), ("load_kg", "metric", "numeric property or measurement", 0.5), ("twin_score", "metric", "numeric property or measurement", 0.5), ("steep", "metric", "numeric property or measurement", 0.5), ("timestamp", "temporal", "time-related attribute", 0.65), *((c, "categorical", "categorical or state property", 0.45) for c in _CAT)]
_VALUES = ", ".join(f"('{a}:{r}', '{a}', '{m.replace(chr(39), chr(39) * 2)}', {c}::DOUBLE)" for a, r, m, c in _MEANT)


def _candidates(t):
    return findings.candidates(profile.roles(_seen(t)), {"load_kg": "weight of the load"})


register("semantic_candidates", f"SELECT * FROM (VALUES {_VALUES}) AS t(candidate_id, attribute, meaning, confidence)")(lambda t: _candidates(t).select("candidate_id", "attribute", "meaning", "confidence"))


def _records(t):
    rows = [("load_kg:unit", 1, "reject"), ("load_kg:unit", 2, "modify"), ("state:categorical", 1, "confirm"), ("state:categorical", 3, "conflict"), ("steep:metric", 1, "reject")]
    return t("region").sparkSession.createDataFrame(rows, "candidate_id string, seq int, action string")


register("attribute_states", f"SELECT DISTINCT attribute, CASE attribute WHEN 'load_kg' THEN 'USER_CONFIRMED' WHEN 'state' THEN 'CONFLICTING' WHEN 'steep' THEN 'UNKNOWN' ELSE 'INFERRED' END AS state FROM (VALUES {_VALUES}) AS t(candidate_id, attribute, meaning, confidence)")(lambda t: findings.attribute_states(_candidates(t), findings.confirmation_states(_records(t))))
register("relevance", f"""WITH f AS ({_RELATED}), k AS (SELECT unnest(string_split(subject, ',')) AS c, 1 AS one FROM f WHERE category = 'relationship'), n AS (SELECT c, count(*) AS n FROM k GROUP BY 1),
a AS (SELECT * FROM (VALUES {", ".join(f"('{c}')" for c in ("record_id", "load_kg", "twin_score", "state", "side", "steep", "mixed", "nothing", "timestamp"))}) AS t(attribute)),
s AS (SELECT attribute, attribute = 'steep' AS chosen, attribute = 'load_kg' AS named, coalesce(n, 0) AS tied, attribute IN ('steep', 'nothing') AS sparse FROM a LEFT JOIN n ON c = attribute),
x AS (SELECT *, round(CASE WHEN chosen THEN 0.8 ELSE 0 END + CASE WHEN named THEN 0.4 ELSE 0 END + least(0.3, 0.1 * tied) - CASE WHEN sparse THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM s)
SELECT attribute, greatest(0, least(1, score))::DOUBLE AS score, CASE WHEN score >= 0.7 THEN 'potentially_relevant' WHEN score <= 0.1 AND NOT chosen AND NOT named AND tied = 0 AND NOT sparse THEN 'potentially_irrelevant' WHEN chosen THEN 'selected' ELSE 'requires_clarification' END AS category FROM x""")(
    lambda t: findings.relevance(profile.attribute_counts(_seen(t)), findings.relationship_findings(_seen(t)), "predict load", ("steep",)))

# --- whole findings, explanations, contexts ------------------------------------------

_ALL = f"({_ATTRIBUTES} UNION ALL {_RELATED})"
_START = "regexp_extract(finding_id, '^[a-z_]+')"
_METHODS = {
    "missing": ("missingness_count", "statistical", "", ""), "empty": ("non_null_count", "observed", "", ""), "sparse": ("missingness_rate", "observed", "", ""), "role": ("uniqueness_and_name_heuristic", "inferred", findings.CONFIRM, ""),
    "group": ("cardinality_heuristic", "inferred", findings.GROUPING, ""), "target": ("name_heuristic", "inferred", findings.TARGET, ""), "unusual": ("IQR_1.5", "statistical", findings.NO_ERROR, ""), "skew": ("sample_skewness", "statistical", "", ""),
    "mixed_values": ("numeric_parse_fraction", "observed", findings.REVIEW, ""), "temporal": ("timestamp_parsing_and_ordering", "observed", findings.TIMES, ""), "association": ("contingency_table_cramers_v", "statistical", findings.DESCRIPTIVE, ""),
    "group_difference": ("group_mean_spread", "observed", findings.DIFFERENT, findings.GROUPED), "relationship": ("", "statistical", findings.NO_CAUSE, ""),
}
_KNOWN = "(VALUES " + ", ".join(f"('{k}', '{m}', '{s}', '{li}', '{g}')" for k, (m, s, li, g) in _METHODS.items()) + ") AS k(start, method, state, limits, given)"
#: The figure that a finding's text gives, with as many digits.
_FIGURE = "CASE WHEN start IN ('missing', 'unusual') THEN CAST(regexp_extract(observation, '^[0-9]+') AS DOUBLE) WHEN start IN ('skew', 'relationship', 'association', 'group_difference') THEN CAST(regexp_extract(observation, '(-?[0-9]+[.][0-9]+)[)][.]$', 1) AS DOUBLE) END"


def _found(t):
    return findings.findings(_seen(t))


def _figure():
    r = lambda k, d=None: F.element_at("result", k) if d is None else F.round(F.element_at("result", k), d)
    start = F.regexp_extract("finding_id", "^[a-z_]+", 0)
    own = F.element_at("result", F.when(F.col("method") == "spearman", "spearman").otherwise("pearson"))
    return F.when(start == "missing", r("missing_count")).when(start == "unusual", r("count")).when(start == "skew", r("skewness", 2)).when(start == "association", r("cramers_v", 3)).when(start == "group_difference", r("mean_spread", 2)).when(start == "relationship", F.round(own, 3))


register("findings_whole", f"""SELECT finding_id, category, subject, observation, CASE WHEN start = 'relationship' THEN regexp_extract(observation, 'observed ([a-z]+) association', 1) ELSE method END AS method, state, limits, given, {_FIGURE} AS figure
FROM (SELECT *, {_START} AS start FROM {_ALL}) JOIN {_KNOWN} USING (start)""")(
    lambda t: _found(t).select("finding_id", "category", "subject", "observation", "method", "state", F.array_join("limitations", "|").alias("limits"), F.array_join("assumptions", "|").alias("given"), _figure().alias("figure")))

_TOLD = {"unusual": "'Column ''' || subject || ''' contains ' || regexp_extract(observation, '^[0-9]+') || ' IQR-based statistical outlier(s).'", "missing": "'Column ''' || subject || ''' has ' || regexp_extract(observation, '^[0-9]+') || ' missing value(s).'",
         "relationship": "'''' || replace(subject, ',', ''' and ''') || ''' have a strong observed ' || regexp_extract(observation, 'observed ([a-z]+) association', 1) || ' correlation (' || regexp_extract(observation, '(-?[0-9]+[.][0-9]+)[)]', 1) || ').'",
         "association": "'''' || replace(subject, ',', ''' and ''') || ''' show an observed categorical association (Cramer''s V ' || regexp_extract(observation, '([0-9]+[.][0-9]+)[)]', 1) || ').'"}
_NAMES = {p.rstrip(":"): (s, c, k) for p, s, c, k, _ in explain.TEMPLATES}
_TURNED = "(VALUES " + ", ".join(f"('{p}', '{s}', '{c}', '{k}')" for p, (s, c, k) in _NAMES.items()) + ") AS n(start, begins, cat, kind)"
_MESSAGE = "CASE start " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _TOLD.items()) + " ELSE observation END"
register("explanations", f"""SELECT coalesce(begins || replace(substr(finding_id, length(start) + 2), ':', '_'), finding_id) AS finding_id, 'eda' AS source, coalesce(cat, category) AS category, coalesce(kind, 'observation') AS kind, {_MESSAGE} AS message, limits
FROM (SELECT *, {_START} AS start FROM {_ALL}) JOIN {_KNOWN} USING (start) LEFT JOIN {_TURNED} USING (start)""")(lambda t: explain.explained(_found(t)).withColumn("limits", F.array_join("limitations", "|")).drop("limitations"))
_IDS = "SELECT {c} AS attribute, string_agg(finding_id, ';' ORDER BY finding_id) AS ids FROM {f} GROUP BY 1"
_KINDS = {"record_id": "numeric", "load_kg": "numeric", "twin_score": "numeric", "state": "categorical", "side": "categorical", "steep": "numeric", "mixed": "categorical", "nothing": "unknown", "timestamp": "temporal"}
register("column_contexts", f"""WITH f AS MATERIALIZED (SELECT * FROM {_ALL}), q AS ({_IDS.format(c='subject', f="f WHERE category = 'quality'")}), a AS ({_IDS.format(c='subject', f="f WHERE category = 'distribution'")}), r AS ({_IDS.format(c='attribute', f="(SELECT finding_id, unnest(string_split(subject, ',')) AS attribute FROM f WHERE category = 'relationship')")}),
c AS (SELECT attribute, string_agg(candidate_id, ';' ORDER BY candidate_id) AS ids FROM (VALUES {_VALUES}) AS t(candidate_id, attribute, meaning, confidence) GROUP BY 1), n AS ({" UNION ALL ".join(f"SELECT '{k}' AS attribute, '{v}' AS kind, count(*) - count({k}) AS missing, count(DISTINCT {k}) AS unique_count FROM {_SQL}" for k, v in _KINDS.items())})
SELECT n.attribute, n.kind, n.missing, n.unique_count, coalesce(q.ids, '') AS quality, coalesce(a.ids, '') AS anomalies, coalesce(r.ids, '') AS relationships, coalesce(c.ids, '') AS candidates, CASE n.attribute WHEN 'load_kg' THEN 'USER_CONFIRMED' WHEN 'state' THEN 'CONFLICTING' WHEN 'steep' THEN 'UNKNOWN' WHEN 'nothing' THEN 'UNKNOWN' ELSE 'INFERRED' END AS status
FROM n LEFT JOIN q USING (attribute) LEFT JOIN a USING (attribute) LEFT JOIN r USING (attribute) LEFT JOIN c USING (attribute)""")(
    lambda t: explain.contexts(profile.attribute_counts(_seen(t)), profile.column_kinds(_seen(t)), _found(t), _candidates(t), findings.attribute_states(_candidates(t), findings.confirmation_states(_records(t))))
    .select("attribute", "kind", "counts.missing", "counts.unique_count", *(F.array_join(f"{k}.finding_id", ";").alias(k) for k in ("quality", "anomalies", "relationships")), F.array_join("candidates.candidate_id", ";").alias("candidates"), "status"))

#: What people said of candidates, by event.
_SAYS = "CASE event_id % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'modify' WHEN 2 THEN 'reject' WHEN 3 THEN 'unknown' ELSE 'conflict' END"
register("confirmation_states", f"SELECT candidate_id, CASE WHEN a IN ('confirm', 'modify') THEN 'confirmed' WHEN a = 'conflict' THEN 'conflicting' ELSE 'unknown' END AS state FROM (SELECT 'c' || user_id AS candidate_id, arg_max({_SAYS}, event_id) AS a FROM events GROUP BY 1)")(
    lambda t: findings.confirmation_states(t("events").selectExpr("concat('c', user_id) AS candidate_id", "event_id AS seq", f"{_SAYS} AS action")))
