"""Hand-computed cases: small tables whose results are known."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import domain, fidelity, text
from lodestone.operators import cleaning, findings, profile, query, relate, retrieval


def table(spark, rows, schema):
    kinds = [field.split(" ")[-1] for field in schema.split(", ")]
    return spark.createDataFrame([tuple(float(v) if k == "double" and v is not None else v for v, k in zip(r, kinds)) for r in rows], schema)


def column(spark, values, kind="double"):
    return table(spark, [(v,) for v in values], f"x {kind}")


def test_wrong_requests_are_answers(spark):
    data = {"d": table(spark, [(1, True, "a", 2.0), (2, False, "b", float("nan"))], "i int, b boolean, s string, x double")}
    ask = lambda op, **a: query.query_dataset(data, "d", op, **a)
    for op, args in [("aggregate", {"agg_column": "s", "agg_func": "mean"}), ("aggregate", {"agg_column": "s", "agg_func": "sum", "group_by": "i"}), ("filter_rows", {"column": "b", "operator": "gt", "value": 5}),
                     ("filter_rows", {"column": "x", "operator": "eq", "value": "two"}), ("filter_rows", {"column": "x", "operator": "eq", "value": None}), ("get_top_rows", {"column": "s"}), ("get_statistics", {"column": "no"}), ("nonsense", {}), ("get_columns", {"extra": 1})]:
        found = ask(op, **args)
        assert not found.success and found.error and found.data is None, (op, args)
    assert [r.i for r in ask("filter_rows", column="x", operator="gt", value=1).data.collect()] == [1]
    assert sorted(r.i for r in ask("filter_rows", column="x", operator="ne", value=2.0).data.collect()) == [2]
    assert ask("filter_rows", column="b", operator="eq", value=1).data.count() == 1
    assert ask("get_statistics", column="x").data.head()["count"] == 1


def test_empty_columns(spark):
    empty = column(spark, [None, None])
    assert query.statistics(empty, "x").head().median is None
    assert profile.distribution(empty, "x").head()["count"] == 0
    assert profile.outliers(empty, "x").head().iqr_outliers == 0
    assert cleaning.ks_distance(empty, column(spark, [1.0]), "x").head().ks == 0
    assert cleaning.outlier_confidence(empty, "x").head().confidence == 0.5
    assert cleaning.total_variation(empty, empty, "x").head().tvd == 0


def test_percentiles(spark):
    import random

    import numpy as np

    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.0, 7.0]) for _ in range(999)]
    found = query.order.percentiles(column(spark, values), F.col("x"), [0, 0.1, 0.25, 0.5, 0.9, 1]).head().p
    assert found == pytest.approx(np.quantile(values, [0, 0.1, 0.25, 0.5, 0.9, 1]).tolist())


def test_temporal(spark):
    rows = lambda *days: table(spark, list(enumerate(days)), "k int, t string")
    found = profile.temporal(rows("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05", "2024-01-06"), "t", "k").head()
    assert (found.gap_count, found.median_interval, found.ordered) == (1, 86400.0, True)
    found = profile.temporal(rows("2024-01-01", "2024-01-01", "2024-01-01", "2024-01-09"), "t", "k").head()
    assert (found.gap_count, found.median_interval) == (0, 0.0)
    found = profile.temporal(rows("2024-01-01", "x"), "t", "k").head()
    assert found["count"] == 1 and not found.sufficient and found.gap_count is None


def test_imputation_confidence(spark):
    sure = lambda rows, kind="double": cleaning.imputation_confidence(column(spark, rows, kind), "x").head().confidence
    assert sure([5.0] * 30 + [None] * 10) == 0.925
    assert sure(["A"] * 30 + [None] * 10, "string") == 0.925
    assert sure(["A"] * 15 + ["B"] * 15 + [None] * 10, "string") == 0.675
    assert sure([1.0] * 40) == 0.985
    assert sure([None] * 4) == 0.2
    assert sure([-2.0, 0.0, 2.0, None]) == pytest.approx(0.30 * 0.75 + 0.25 * 0.1 + 0.25 / 3 + 0.2, abs=1e-6)


def test_missingness(spark):
    rows = lambda a, b: [(None, x) for x in a] + [(1.0, x) for x in b]
    effect = lambda a, b: cleaning.missingness_effect(table(spark, rows(a, b), "t double, o double"), "t", "o").head().effect
    assert effect([1.0] * 5, [1.0] * 5) == 0 and effect([2.0] * 5, [1.0] * 5) == 1
    assert effect([1.0] * 4, [2.0] * 9) is None and effect([0.0, 0, 1, 1, 1], [100.0, 100, 101, 101, 101]) == 1
    df = table(spark, [(None, 1.0, "a")] * 6 + [(1.0, 1.0, "b")] * 6, "t double, o double, c string")
    found = cleaning.missingness_association(df, "t").head()
    assert tuple(found) == (1.0, "c", "cramers_v", 2, 0)


def test_outliers(spark):
    found = cleaning.outlier_confidence(column(spark, [10.0, 10, 10, 20, 20, 20, 45]), "x").head()
    assert (found.flagged_count, found.mean_iqr_distance, found.confidence) == (1, 1.0, 0.6)
    z = cleaning.modified_z(column(spark, [10.0, 10, 10, 20, 20, 20, 100]), "x").where("x = 100").head().z
    assert round(z, 3) == 5.396


def test_shifts(spark):
    ks = lambda a, b: cleaning.ks_distance(column(spark, a), column(spark, b), "x").head().ks
    assert ks([1.0, 2], [3.0, 4]) == 1.0 and ks([1.0, 2, 3, 4], [1.0, 2, 2, 3]) == 0.25
    assert cleaning.total_variation(column(spark, list("AABB"), "string"), column(spark, list("AAAB"), "string"), "x").head().tvd == 0.25
    found = cleaning.shifts(column(spark, [10.0, 20, 30, None]), column(spark, [10.0, 20, 30, 20]), ["x"]).head()
    assert (found.n_before, found.n_after, found.mean_shift, found.std_before, round(found.std_before + found.std_shift, 3)) == (3, 4, 0.0, 10.0, 8.165)


def test_cleaning_cycle(spark):
    df = table(spark, [(0, 1, 10.0), (1, 2, None), (2, 2, None)], "line int, id int, value double")
    cleaned, changes = cleaning.apply_cleaning(df, "line", ["impute_value"])
    assert cleaned.count() == 3 and changes.count() == 2 and [r.value for r in cleaned.collect()] == [10.0] * 3
    proposed = cleaning.proposals(df, "line")
    assert {r.proposal_id for r in proposed.collect()} == {"remove_duplicate_rows", "impute_value"}
    assert {r.proposal_id for r in cleaning.proposals(df, "line", "unknown").collect()} == {"remove_duplicate_rows"}
    said = table(spark, [("impute_value", "APPROVE")], "proposal_id string, action string")
    left = {r.issue_id for r in cleaning.unresolved(cleaning.issues(df, "line"), cleaning.statuses(proposed, said)).collect()}
    assert left == {"duplicate_rows", "conflicting_identifier_id"}
    rows = [(k, 10.0) for k in range(20)] + [(20 + k, v) for k, v in enumerate([11.0, 12, 13, 100])]
    many = table(spark, rows, "line int, v double")
    fresh = cleaning.new_issues(many, cleaning.apply_cleaning(many, "line", ["remove_duplicate_rows"])[0], "line").collect()
    assert [(r.kind, r.field) for r in fresh] == [("statistical_outliers", "v")]
    twins = table(spark, [(0, 10.0, "A"), (1, None, "A"), (2, 10.0, "B")], "line int, x double, y string")
    fresh = cleaning.new_issues(twins, cleaning.apply_cleaning(twins, "line", ["impute_x"])[0], "line").collect()
    assert [(r.kind, r.field) for r in fresh] == [("duplicate_rows", None)]


def test_findings(spark):
    rows = [(k + 1, v, g, f"2024-01-0{d}", None) for k, (v, g, d) in enumerate(zip([1.0, 2, 3, 4, 100], "aabbb", [1, 2, 3, 5, 6]))]
    df = table(spark, rows, "record_id int, value double, `group` string, `when` string, empty string")
    flags = {r.column_name: r for r in profile.structure(df).collect()}
    assert {c for c, r in flags.items() if r.candidate_key} == {"record_id", "value", "when"} and flags["empty"].empty and flags["record_id"].candidate_identifier
    found = {r.finding_id for r in findings.findings(df).collect()}
    assert {"missing:empty", "empty:empty", "sparse:empty", "role:record_id", "unusual:value", "skew:value", "group:group", "temporal:when", "group_difference:group:value"} <= found and "target:value" not in found
    frame = table(spark, [(1.0, 2.0, 1.0), (2.0, 4.0, 4.0), (3.0, 6.0, 1.0), (4.0, 8.0, 4.0)], "target double, support double, other double")
    ranked = findings.relevance(profile.attribute_counts(frame), findings.relationship_findings(frame), "predict target", ("target",)).collect()
    assert {r.attribute: r.category for r in ranked}["target"] == "potentially_relevant"
    both = relate.associations(table(spark, list(zip("xxxyy", "aaabb")), "a string, b string"), ["a", "b"]).head()
    assert both.v == 1.0 and both.n == 5
    (empty,) = findings.dataset_findings(df.limit(0)).collect()
    assert empty.finding_id == "empty_dataset"


def test_conditions(spark):
    texts = ["100% pellet burden with 34% CO and 6% hydrogen, 60% nitrogen.", "CO= 36%, H2=4% & N2=60%, sinter only", "", "ore 50% sinter 50% co 50%"]
    df = table(spark, [(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", domain.condition(domain.condition_numbers(F.col("t"))).alias("c")).orderBy("k")
    found = [tuple(r.c)[:9] for r in df.collect()]
    assert found[0] == (34.0, 0.0, 66.0, 0.0, 0.0, 100.0, 0.0, 1, "P")
    assert found[1] == (36.0, 4.0, 60.0, 100.0, 0.0, 0.0, 0.0, 1, "SO")
    assert found[2][:7] == (0.0,) * 7 and found[3][:6] == (50.0, 0.0, 50.0, 50.0, 50.0, 0.0)


def test_texts(spark):
    doc = "TOPIC: Heat\nROLE: reference\nFirst words.\n\n# Process View\nIt runs.\nREFERENCES\nold\nscenario 3 (hot)\nDone."
    df = table(spark, [("experiments/x.y.txt", doc), ("b/plain.txt", "one\n \ntwo   words\n\n"), ("c.txt", None)], "source string, text string")
    found = [tuple(r) for r in text.chunks(df).select("source", "position", "topic", "role", "section", "content").orderBy("source", "position").collect()]
    assert found == [
        ("b/plain.txt", 0, "plain", "reference", "body", "one"), ("b/plain.txt", 1, "plain", "reference", "body", "two words"), ("experiments/x.y.txt", 0, "heat", "reference", "introduction", "First words."),
        ("experiments/x.y.txt", 1, "heat", "reference", "process view", "It runs."), ("experiments/x.y.txt", 2, "heat", "reference", "scenario 3 (hot)", "Done."),
    ]
    said = table(spark, [("The basicity is around 1.6 °C but basicity near Ts 3 °C",)], "t string").select(fidelity.plain_basicity(F.col("t"))).head()[0]
    assert said == "The basicity is around 1.6 but basicity near Ts 3 °C"
    names = table(spark, [("a/b\\c:d?.txt. ",), ("...",)], "n string").select(text.safe_filename(F.col("n")).alias("n")).collect()
    assert [r.n for r in names] == ["c_d_.txt", None]


def test_search_falls_back_to_all(spark):
    rows = [(k, [float(k), 1.0], "slag" if k < 2 else "other", "reference", "body") for k in range(8)]
    chunks = table(spark, rows, "chunk_id int, embedding array<double>, topic string, role string, section string")
    found = retrieval.search(chunks, "slag formation", [1.0, 0.0], 3, {"slag": ["slag"]}).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == [7, 6, 5]
