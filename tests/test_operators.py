"""Hand-computed values, missing values, and answers to wrong requests."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import domain, text
from lodestone.operators import cleaning, evaluate, profile, query, relate, retrieval
from lodestone.sources import readers
from lodestone.streaming.windows import windowed_counts


def one(df):
    return df.head().asDict()


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b"), (4, 4.0, "b"), (5, 100.0, "b")], "record_id long, value double, grp string")


def test_statistics(small):
    assert one(query.statistics(small, "value"))["mean"] == 22.0
    assert one(query.statistics(small, "grp")) == {"count": 5, "unique": 2, "top": "b"}
    assert one(query.statistics(small)) == {"row_count": 5, "column_count": 3}


def test_wrong_requests_are_answers(small):
    ask = lambda op, **a: query.query_dataset({"d": small}, "d", op, **a)
    for op, args in (("filter_rows", {"column": "x", "operator": "eq", "value": 1}), ("filter_rows", {"column": "value", "operator": "like", "value": 1}), ("filter_rows", {"column": "value", "operator": "eq", "value": "abc"}), ("get_top_rows", {"column": "grp"}), ("aggregate", {"agg_column": "value", "agg_func": "mode"}), ("drop", {})):
        found = ask(op, **args)
        assert not found.success and found.error and found.data is None
    assert not query.query_dataset({}, "d", "get_columns").success
    assert ask("filter_rows", column="value", operator="in", value="1, 100").data.count() == 2
    assert ask("filter_rows", column="value", operator="gt", value=1000).data.count() == 0


def test_missing_values(spark):
    df = query.missing_free(spark.createDataFrame([(1, float("nan"), "a"), (2, None, "a"), (3, 5.0, None)], "i long, x double, g string"))
    assert query.filter_rows(df, "x", "ne", 5.0).count() == 2
    assert one(query.aggregate(df, "x", "sum", "g")) == {"g": "a", "value": 0.0}
    assert [r.i for r in query.top_rows(df, "x", 3, True, "i").collect()] == [3, 1, 2]


def test_column_names_with_marks(spark):
    df = spark.createDataFrame([(1.0, 2)], "`a.b c%` double, n int")
    assert one(query.aggregate(df, "a.b c%", "mean"))["value"] == 1.0


def test_profile(small, spark):
    found = one(profile.outliers(small, "value"))
    assert (found["iqr_outliers"], found["mad"]) == (1, 1.0)
    assert one(profile.dataset_counts(small.unionByName(small.limit(1))))["duplicate_rows"] == 1
    flags = {r.column_name: r for r in profile.structure(small).collect()}
    assert flags["record_id"].candidate_key and flags["value"].candidate_key and not flags["grp"].candidate_key
    days = spark.createDataFrame([(k, d) for k, d in enumerate(["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05", "2024-01-06"])], "k long, d string").withColumn("d", F.to_timestamp("d"))
    times = one(profile.temporal(days, "d", "k"))
    assert (times["gap_count"], times["median_interval"], times["ordered"]) == (1, 86400.0, True)
    single = one(profile.distribution(spark.createDataFrame([(3.0,)], "x double"), "x"))
    assert (single["std"], single["skewness"]) == (0.0, None)


def test_relations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0, "x", "a"), (2.0, 4.0, 7.0, "x", "a"), (3.0, 6.0, 7.0, "x", "a"), (4.0, 8.0, 7.0, "y", "b"), (5.0, 10.0, 7.0, "y", "b")], "a double, b double, c double, p string, q string")
    found = {(r.left_column, r.right_column): (r.n, r.r) for r in relate.pearson_pairs(df, ["a", "b", "c"]).collect()}
    assert found == {("a", "b"): (5, 1.0), ("a", "c"): (5, None), ("b", "c"): (5, None)}
    assert one(relate.spearman(df, "a", "b"))["rho"] == 1.0
    assert one(relate.cramers_v(df, "p", "q"))["v"] == 1.0


def test_cleaning(spark):
    x = lambda *v: spark.createDataFrame([(None if a is None else float(a),) for a in v], "x double")
    assert one(cleaning.ks_distance(x(1, 2), x(3, 4), "x"))["ks"] == 1.0
    assert one(cleaning.ks_distance(x(1.0, 2.0, 3.0, 4.0), x(1.0, 2.0, 2.0, 3.0), "x"))["ks"] == 0.25
    shift = one(cleaning.moment_shift(x(10.0, 20.0, 30.0, None), x(10.0, 20.0, 30.0, 20.0), "x"))
    assert (shift["n_before"], shift["n_after"], shift["mean_shift"]) == (3, 4, 0.0)
    s = lambda t: spark.createDataFrame([(c,) for c in t], "c string")
    assert one(cleaning.total_variation(s("AABB"), s("AAAB"), "c"))["tvd"] == 0.25
    assert one(cleaning.entropy(s("A" * 30), "c"))["entropy"] == 0.0
    assert one(cleaning.entropy(s("A" * 15 + "B" * 15), "c"))["entropy"] == 1.0
    assert one(cleaning.imputation_confidence(x(*[5.0] * 30, *[None] * 10), "x"))["confidence"] == 0.925
    keyed = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (1, 40)], "id long, val long")
    assert one(cleaning.conflicting_keys(keyed, "id"))["conflicting"]
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "k long, v string")
    assert sorted(r.k for r in cleaning.duplicates(rows, ["v"], "k").collect()) == [2, 4]


def test_retrieval(spark):
    rows = spark.createDataFrame([(-0.4, True, False), (-0.35, False, False), (-0.4, False, True)], "s double, p boolean, n boolean")
    assert [round(r[0], 4) for r in rows.select(retrieval.reranked(F.col("s"), F.col("p"), F.col("n"))).collect()] == [-0.34, -0.35, -0.5]
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [10.0, 10.0])], "vec_id long, embedding array<double>")
    assert one(retrieval.nearest(points, [3.0, 0.0])) == {"distance": 3.0, "confidence": "low"}
    assert [r.vec_id for r in retrieval.top_k(points, [1.0, 0.0], 2).collect()] == [2, 1]
    ranked = spark.createDataFrame([(1, 1, True, 2), (1, 2, False, 2), (2, 1, False, 1), (2, 2, True, 1)], "query_id long, rank int, relevant boolean, n_relevant long")
    assert one(evaluate.retrieval_metrics(ranked, 1)) == {"queries": 2, "hit_rate": 0.5, "recall": 0.25, "mrr": 0.75}


def test_domain_and_text(spark):
    row = one(spark.createDataFrame([("CO= 36%, H2=4% & N2=60%", "S1-70%+O1-30%", "100% P")], "a string, b string, c string").select(domain.gas(F.col("a"), "CO").alias("co"), domain.burden(F.col("b"), "S").alias("s"), domain.burden(F.col("c"), "P").alias("p"), domain.burden(F.col("c"), "S").alias("z")))
    assert row == {"co": 36.0, "s": 70.0, "p": 100.0, "z": 0.0}
    parts = spark.createDataFrame([(1, "Lead in.\nSECTION: Method\nDo  this.\nSECTION: Results\nFound that.")], "k long, text string")
    assert [(r.section, r.content) for r in text.sections(parts, "k").orderBy("position").collect()] == [("introduction", "Lead in."), ("method", "Do this."), ("results", "Found that.")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,x\n1,2\n")
    (tmp_path / "c.json").write_text(json.dumps([{"a": 1, "b": {"c": 2}}]))
    (tmp_path / "d.txt").write_bytes("é".encode("cp1252"))
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).dtypes == [("x", "int"), ("y", "int")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError):
        readers.read_json(spark, str(tmp_path / "c.json"))
    assert [r.text for r in readers.read_documents(spark, str(tmp_path)).collect()] == ["é"]
    with pytest.raises(ValueError):
        readers.check_size(spark, str(tmp_path / "a.csv"), most=3)


def test_windows_on_a_table(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 3.0)], "ts string, event_type string, value double")
    assert sorted(r.n for r in windowed_counts(events).collect()) == [1, 2]


def test_every_50th_row_is_a_query(spark, tmp_path):
    import random

    from lodestone.plans import catalog

    random.seed(5)
    rows = [(k, [float(random.randint(-3, 3)) for _ in range(4)], k % 3 if k < 20 else k % 7) for k in range(320)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits, recall, first = [], [], []
    for q, v, label in rows[::50]:
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), k, x == label) for k, w, x in rows if k != q)[:10]
        hits.append(sum(x[2] for x in ranked[:5]))
        recall.append(hits[-1] / (sum(x == label for _, _, x in rows) - 1))
        first.append(next((1 / (n + 1) for n, x in enumerate(ranked) if x[2]), 0))
    assert one(catalog.QUERIES["retrieval_metrics"](spark, str(tmp_path))) == {"queries": 7, "hit_rate": round(sum(h > 0 for h in hits) / 7, 6), "recall": round(sum(recall) / 7, 6), "mrr": round(sum(first) / 7, 6)}


def test_top_k_in_blocks(spark):
    rows = [(k, None if k == 7 else [float(k % 5), 1.0]) for k in range(60)] + [(None, [9.0, 9.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(3, [1.0, 0.0]), (4, [0.0, 0.0])], "query_id long, q array<float>")
    told = lambda df: sorted(map(tuple, df.select("query_id", "vec_id", "score", "rank").collect()))
    for k in (5, 100):
        assert told(retrieval.top_k_in_blocks(corpus, asked, k)) == told(retrieval.top_k_of(corpus, asked, k))


def test_edge_order_of_all_rows(spark, tmp_path):
    from lodestone.plans import catalog

    spark.range(45).selectExpr("id * 3 AS item_id", "'x' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    places = {r.item_id: r.place for r in catalog.QUERIES["edge_order"](spark, str(tmp_path)).collect()}
    assert sorted(places.values()) == list(range(1, 46)) and [places[k] for k in (0, 3, 6, 126, 129, 132)] == [1, 45, 2, 22, 24, 23]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("turns"))
    rows = [(1, 0, "Rate 4.0 and 5% with alpha beta gamma"), (1, 1, "Rate 4 with gamma delta"), (1, 3, "gamma -0.50 delta omega rate"), (2, 0, "alone 7"), (3, 5, "same words 12"), (3, 6, "same words 12.000")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def _told(spark, folder, name, *columns):
    from lodestone.plans import catalog

    return {(r.conv_id, r.turn): tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, folder).collect()}


def test_every_turn_has_a_novelty(spark, turns):
    assert _told(spark, turns, "novelty_ratio", "novelty") == {(1, 1): (0.25,), (1, 3): (0.25,), (3, 6): (0.0,)}


def test_reconciled(spark):
    from lodestone.sources import catalogue

    entries = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    files = spark.createDataFrame([("a", "1"), ("c", "4"), ("d", "5")], "path string, content_hash string")
    assert {r.path: r.state for r in catalogue.reconciled(entries, files).collect()} == {"a": "ok", "b": "missing", "c": "hash_mismatch", "d": "orphan"}


def test_numbers_and_tokens_of_turn_pairs(spark, turns):
    assert _told(spark, turns, "number_fidelity", "n_facts", "lost") == {(1, 1): (2, "5%"), (1, 3): (1, "4"), (3, 6): (1, "")}
    assert _told(spark, turns, "token_overlap", "n_shared") == {(1, 1): (3,), (1, 3): (3,), (3, 6): (2,)}
