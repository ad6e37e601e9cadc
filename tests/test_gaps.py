"""NaN, literals, ranges of keys, number facts, the catalogue's claims and normal forms."""

import datetime
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.functions import fidelity, text
from lodestone.operators import cleaning, evaluate, explain, order, profile, query, relate
from lodestone.sources import catalogue, normalise, readers


@pytest.fixture(scope="module")
def nan(spark):
    return spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0), (4, None)], "i int, x double")


def test_nan_is_missing_everywhere(nan):
    counts = {r.column_name: r for r in profile.attribute_counts(nan).collect()}
    assert (counts["x"].non_null, counts["x"].missing, counts["x"].unique_count) == (2, 2, 2)
    d = profile.distribution(nan, "x").head()
    assert (d.max, d.mean, d.variance, d.q75, d["median"]) == (3.0, 2.0, 2.0, 2.5, 2.0)
    assert cleaning.fill_value(nan, "x", True).head().fill == 2.0
    assert (profile.outliers(nan, "x").head().iqr_outliers, profile.shapes(nan, ["x"]).head().mad_outliers) == (0, 0)
    assert relate.spearman(nan, "i", "x").head().n == 2
    assert {r.i: r.x for r in cleaning.imputed(nan, "x").collect()} == {1: 1.0, 2: 2.0, 3: 3.0, 4: 2.0}


def test_percentiles_of_groups_and_of_few_values(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.choice([rng.gauss(0, 1), 5.0, -5.0])), rng.randrange(1, 4)) for g in range(3) for _ in range(997)]
    df = spark.createDataFrame(rows, "g int, x double, w int")

    def plain(values, share):
        values = sorted(values)
        place = (len(values) - 1) * share
        low = int(place)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low)

    shares = [0.0, 0.1, 0.5, 0.93, 1.0]
    for r in order.percentiles(df, F.col("x"), shares, F.col("w"), by="g").collect():
        own = [x for g, x, w in rows if g == r.g for _ in range(w)]
        assert r.p == pytest.approx([plain(own, s) for s in shares])
    assert order.percentiles(df.limit(0), F.col("x"), [0.5]).head().p == [None]
    assert order.percentiles(df.limit(1), F.col("x"), [0.25, 0.75]).head().p == [rows[0][1]] * 2


@pytest.mark.parametrize("key", ["n", "s", "big"])
def test_running_and_previous_over_keys_of_any_type(spark, key):
    df = spark.range(500).selectExpr("id AS n", "printf('k%05d', id) AS s", f"id + {2**60} AS big", "id * 2 AS v").repartition(6, "v")
    assert sorted((r.v, r.upto_v) for r in order.running(df.select(key, "v"), key, "v").collect()) == [(2 * k, k * (k + 1)) for k in range(500)]
    assert sorted((r.v, r.previous) for r in order.previous(df.select(key, "v"), key, "v").collect() if r.previous is not None) == [(2 * k, 2 * k - 2) for k in range(1, 500)]


def test_literals(spark):
    df = spark.createDataFrame([(2**53, datetime.date(2024, 1, 1), True), (2**53 + 1, datetime.date(2024, 1, 2), False)], "n long, d date, b boolean")
    df = df.withColumn("m", F.col("n").cast("decimal(20,2)"))
    ask = lambda op="filter_rows", **a: query.query_dataset({"d": df}, "d", op, **a)
    size = lambda **a: ask(operator="eq", **a).data.count()
    assert size(column="n", value=str(2**53 + 1)) == 1 and size(column="n", value=2**53) == 1 and size(column="m", value=f"{2**53 + 1}.00") == 1
    assert size(column="d", value="2024-01-02") == 1 and size(column="d", value=datetime.date(2024, 1, 1)) == 1 and size(column="b", value="TRUE") == 1
    assert ask(column="n", operator="in", value=f"{2**53 + 1}, 7").data.count() == 1 and ask(column="n", operator="gt", value=str(10**30)).data.count() == 0
    assert ask(column="d", operator="lt", value="2024-01-01T12:00:00").data.count() == 1
    for wrong in (dict(column="d", operator="eq", value="zz"), dict(column="n", operator="eq", value="nan"), dict(column="b", operator="eq", value="yes")):
        assert not ask(**wrong).success
    for n in ("3", 0, -1, 2.5, True, None):
        assert not ask("get_top_rows", column="n", n=n).success
    assert ask("get_top_rows", column="n", n=1).data.count() == 1


def test_too_few_rows_for_folds(spark):
    with pytest.raises(Exception, match="Too few rows"):
        evaluate.time_folds(spark.range(3), "id", 5).collect()


def test_number_facts(spark):
    said = ["4 and 4.0 and 4%", "-0.5, 1234567 and 0.00001234 or 100000 and 1e5", "12.50% 007 3.", "0 and -0", "999999.5 1000000", None, ""]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select(text.numeric_facts(F.col("t")).alias("f")).collect()
    import re

    for s, r in zip(said, rows):
        wanted = None if s is None else list(dict.fromkeys(f"{float(x.rstrip('%')):g}" + "%" * x.endswith("%") for x in re.findall(r"-?\d+\.?\d*%?", s)))
        assert r.f == wanted


def test_facts_in_other_forms(spark):
    rows = [("A share of 0.8 is high.", 0.8, "80% is high", True), ("A share of 0.8 is high.", 0.8, "0.8 it is", True), ("A share of 0.8 is high.", 0.8, "8 it is", False), ("80% parse", 0.786885, "0.79 parse", False), ("79% parse", 0.786885, "0.786885 parse", True), ("No numbers", 0.5, "50%", True), ("No numbers", 0.5, "none", False), ("No numbers", None, "none", True)]
    df = spark.createDataFrame(rows, "m string, a double, e string, ok boolean")
    assert [r[0] for r in df.select(fidelity.keeps_facts(F.col("m"), F.create_map(F.lit("x"), F.col("a")), F.col("e"))).collect()] == [r[3] for r in rows]


def test_basicity_loses_only_its_own_degrees(spark):
    said = {"Basicity of 1.5 °C held": "Basicity of 1.5 held", "basicity 1.6-1.9 deg C, Ts 1200 °C": "basicity 1.6-1.9, Ts 1200 °C", "basicity (around 1.6)°C": "basicity (around 1.6)", "basicity at temp 3°C": "basicity at temp 3°C", "basicity was fine. 1200 °C reached": "basicity was fine. 1200 °C reached", "no such word 3 °C": "no such word 3 °C", "": ""}
    df = spark.createDataFrame([(s,) for s in said], "t string")
    assert [r[0] for r in df.select(fidelity.plain_basicity(F.col("t"))).collect()] == list(said.values())


def test_templates(spark):
    df = spark.createDataFrame([("Share {a:%}, {a:2}, {n} of {x}{y}",)], "t string")
    row = df.select(explain.filled(F.col("t"), F.create_map(F.lit("x"), F.lit("it's")), F.create_map(F.lit("a"), F.lit(0.456), F.lit("n"), F.lit(12.0)))).head()
    assert row[0] == "Share 46%, 0.46, 12 of it's{y}"


def test_narrative(spark):
    report = spark.createDataFrame([("statistics", "mean", 2.0), ("statistics", "rows", 3.0), ("evaluation", "mae", 0.5), ("regimes", "a", 1.0)], "section string, name string, value double")
    found = spark.createDataFrame([("b", "Second.", ["L2"]), ("a", "First.", ["L1", "L2"])], "finding_id string, message string, limitations array<string>")
    assert explain.narrative(report, found, "Report").head().text == "Report\n\nKEY STATISTICS\n- mean: 2.0000\n- rows: 3.0000\n\nKEY FINDINGS\n1. First.\n2. Second.\n\nEVALUATION\n- mae: 0.5000\n\nLIMITATIONS\n- L1\n- L2"


def test_empty_frames_have_facts(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert {r.column_name: (r.kind, r.candidate_target) for r in profile.roles(df).collect()} == {"a": ("unknown", False), "b": ("numeric", False)}
    assert profile.shapes(df, ["b"]).collect() == [] and relate.contingency(df, "a", "a").head().sufficient is False


# --- catalogue ------------------------------------------------------------------


def test_of_many_writers_one_registers(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for k in range(3):
        (tmp_path / f"files/{k}.txt").write_text(f"text {k}")
    root, faults = str(tmp_path / "catalogue"), []

    def work():
        try:
            catalogue.Catalogue(spark, root).register(str(tmp_path / "files"), "document")
        except Exception as error:  # noqa: BLE001
            faults.append(error)

    threads = [threading.Thread(target=work) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = catalogue.Catalogue(spark, root)
    assert not faults and found.entries.count() == 3 and found.entries.select("resource_id").distinct().count() == 3
    assert sorted((r.state, r.seq) for r in found.states.collect()) == [("registered", 1)] * 3


def test_a_claim_without_an_entry_is_released(spark, tmp_path):
    kept = catalogue.Catalogue(spark, str(tmp_path / "catalogue"))
    assert kept._claimed("sources", "x") and not kept._claimed("sources", "x")
    assert kept.release("x") and kept._claimed("sources", "x")


def test_stored_bytes_are_verified(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for name in "ab":
        (tmp_path / f"files/{name}.txt").write_text(name)
    kept = catalogue.Catalogue(spark, str(tmp_path / "catalogue"))
    kept.register(str(tmp_path / "files"), "document")
    incoming = catalogue.duplicates(kept.entries, catalogue.entries_of(spark, str(tmp_path / "files"), "document"))
    table = catalogue.duplicates(kept.entries, catalogue.entries_of(spark, str(tmp_path / "files"), "table"))
    (tmp_path / "files/b.txt").write_text("other")
    stored = kept.stored().withColumn("resource_class", F.lit("document"))
    said = lambda df, cls: {r.filename: r for r in catalogue.verified(df.withColumn("resource_class", F.lit(cls)), stored).collect()}
    same = said(incoming, "document")
    assert (same["a.txt"].artifact_verified, same["a.txt"].conflict, same["a.txt"].advice) == (True, None, "Reuse the existing source.")
    assert "Existing source is classified as 'document'" in said(incoming, "policy")["a.txt"].conflict
    assert "already registered as 'document', not 'table'" in said(table, "document")["a.txt"].conflict


def test_tables_read_back_equal(spark, tmp_path):
    rows = [(1, 0.1 + 0.2, "a,\"b\"\nc", True, datetime.date(2024, 2, 29), datetime.datetime(2024, 1, 1, 0, 0, 7, 179575)), (2, 1e-310, "", False, None, None), (3, float("nan"), None, None, None, None), (2**62, -1.7976931348623157e308, " lead and trail ", True, None, None)]
    df = spark.createDataFrame(rows, "n long, x double, s string, b boolean, d date, t timestamp")
    manifest = normalise.write_table(df, str(tmp_path / "t"))
    back = normalise.read_table(spark, str(tmp_path / "t"), json.loads(json.dumps(manifest)))
    plain = lambda frame: sorted(map(tuple, query.missing_free(frame).collect()), key=str)
    assert plain(back) == plain(df) and back.dtypes == df.dtypes
    assert manifest["missing_value_counts"] == {"x": 1, "s": 1, "b": 1, "d": 3, "t": 3} and manifest["row_count"] == 4 and len(manifest["issues"]) == 5


def test_a_confirmed_upload_is_normalised_once(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up/data.csv").write_text("a,b\n1,x\n2,\n")
    kept = catalogue.Catalogue(spark, str(tmp_path / "catalogue"))
    df = readers.read_csv(spark, str(tmp_path / "up/data.csv"))
    manifest = kept.register_confirmed(str(tmp_path / "up"), "table", df)
    (row,) = kept.listed().collect()
    assert row.state == "normalized" and manifest["row_count"] == 2 and manifest["missing_value_counts"] == {"b": 1}
    assert sorted(map(tuple, kept.read_normalised(row.resource_id).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileExistsError):
        kept.normalise_table(row.resource_id, df)


def test_documents_are_cut_into_the_same_sections(spark, tmp_path):
    said = [("a.txt", "TOPIC: Heat\nintro here\nSECTION: Overview\nBody  of it\nSECTION: Key limits\nnone\n"), ("b.txt", "## Process View\nwords\nLIMITS OF HEAT\nmore words\n"), ("c.txt", "plain one\n\nplain two")]
    docs = spark.createDataFrame(said, "source string, text string")
    manifest = normalise.write_documents(docs, str(tmp_path / "d"))
    cut = lambda d: sorted((r.source, r.position, r.topic, r.section, r.content) for r in text.chunks(d).collect())
    assert cut(spark.read.parquet(str(tmp_path / "d"))) == cut(docs) and manifest["chunk_count"] == 7 and manifest["document_count"] == 3
    with pytest.raises(ValueError):
        normalise.write_documents(docs.limit(0), str(tmp_path / "none"))


def test_csv_with_a_late_quoted_line_end(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a,b\n" + "".join(f"{k},plain\n" for k in range(12_000)) + '12000,"two\nlines"\n')
    df = readers.read_csv(spark, str(path))
    assert df.count() == 12_001 and df.where("a = 12000").head().b == "two\nlines"


# --- sources ----------------------------------------------------------------------


def test_chunks_of_folders_and_their_fingerprint(spark, tmp_path):
    for folder, name, said in (("one", "a.txt", "TOPIC: Heat\nSECTION: Overview\nbody"), ("one", "sub/b.txt", "plain"), ("two", "a.txt", "other")):
        path = tmp_path / folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(said)
    found = readers.load_chunks(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()
    assert sorted((r.source, r.topic, r.section, r.content) for r in found) == [("one/a.txt", "heat", "overview", "body"), ("one/sub/b.txt", "b", "body", "plain"), ("two/a.txt", "a", "body", "other")]
    first = readers.fingerprint(spark, str(tmp_path / "one"))
    assert len(first) == 8 and first == readers.fingerprint(spark, str(tmp_path / "one"))
    (tmp_path / "one/a.txt").write_text("longer than it was before, and written again")
    assert readers.fingerprint(spark, str(tmp_path / "one")) != first


def test_names_from_a_row(spark):
    from lodestone.sources import loaders

    df = spark.createDataFrame([(0, "x", None), (1, " Ts ", None), (2, "1200", "dry"), (3, "1300", "wet")], "row int, _c0 string, _c1 string")
    assert [r.asDict() for r in loaders.promoted(df).orderBy("Ts").collect()] == [{"Ts": "1200", "Test Type": "dry"}, {"Ts": "1300", "Test Type": "wet"}]
    with pytest.raises(ValueError):
        loaders.promoted(df, 9)
    with pytest.raises(ValueError):
        loaders.read_registered(spark, "nothing", "x")


def test_places_of_equal_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / f"files/{name}.txt").write_text("same")
    kept = catalogue.Catalogue(spark, str(tmp_path / "catalogue"))
    kept.register(str(tmp_path / "files"), "document")
    kept.register(str(tmp_path / "files"), "document")
    assert kept.entries.count() == 1 and kept.locations.count() == 2


def test_duplicates_tell_nulls_apart(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "x", None), (3, None, "x"), (4, None, None), (5, None, None), (6, "", None)], "row int, a string, b string")
    assert sorted(r.row for r in cleaning.duplicates(df, ["a", "b"], "row").collect()) == [3, 5]


def test_predictions_are_explained(spark):
    from lodestone.operators import learning
    from lodestone.plans import workflows

    training = spark.createDataFrame([(k, float(k), float(k % 3), 2.0 * k) for k in range(30)], "id long, heat double, load_kg double, y double")
    model = learning.ridge(learning.moments(training, "y", ["heat", "load_kg"]), 1e-6)
    asked = spark.createDataFrame([(100, 29.5, 2.0), (101, 5000.0, 1.0), (102, None, 1.0)], "k long, heat double, load_kg double")
    passages = spark.createDataFrame([(1, "a", "reference", "effect", "Higher heat raises the melting point of every burden.")], "chunk_id int, source string, role string, section string, content string")
    found = {r.k: r for r in workflows.explained_predictions(asked, "k", learning.by_line(model, ["heat", "load_kg"]), {"heat": (0.0, 30.0), "load_kg": (0.0, 2.0)}, training, "id", passages, "melting_point").collect()}
    assert found[100].prediction == pytest.approx(59, abs=1e-3) and (found[100].confidence, found[101].confidence, found[102].confidence) == ("high", "low", "failed")
    assert found[100].state == "answered" and "Higher heat" in found[100].answer and found[102].state is None and found[102].prediction is None
