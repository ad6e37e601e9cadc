"""Readers, loaders, sinks and the catalogue, on files."""

import json

import pytest

from lodestone.sources import loaders, readers
from lodestone.sources.catalogue import Catalogue


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv(spark, tmp_path):
    good = write(tmp_path / "a.csv", '\ufeffid,"two\nlines",x\n1,a,2.5\n2,"b, c",3\n')
    rows = readers.read_csv(spark, good).collect()
    assert len(rows) == 2 and rows[1][1] == "b, c" and rows[0][2] == 2.5
    for name, content in {"twice": "a,a\n1,2\n", "blank": "\n\n", "empty": "", "latin": b"a,b\n1,\xe9\n"}.items():
        with pytest.raises(ValueError):
            readers.read_csv(spark, write(tmp_path / f"{name}.csv", content))


def test_json(spark, tmp_path):
    good = write(tmp_path / "a.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert [tuple(r) for r in readers.read_json(spark, good).collect()] == [(1, "x"), (2, None)]
    lines = write(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.read_json(spark, lines, lines=True).collect()] == [1, 2]
    for name, content in {"one": '{"a": 1}', "nested": '[{"a": [1]}]', "twice": '[{"a": 1, "a": 2}]', "broken": "[{"}.items():
        with pytest.raises(ValueError):
            readers.read_json(spark, write(tmp_path / f"{name}.json", content)).collect()


def test_size(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a\n1\n")
    with pytest.raises(ValueError):
        readers.check_size(spark, path, 3)


def test_documents(spark, tmp_path):
    folder = tmp_path / "docs"
    write(folder / "b.txt", "\ufeffb é")
    write(folder / "sub/a.txt", "caf\xe9 – x".encode("cp1252"))
    write(folder / "c.txt", "c".encode("utf-16"))
    write(folder / "empty.txt", "  ")
    write(folder / "odd.txt", "x\x01y")
    write(folder / "other.md", "no")
    found = [tuple(r) for r in readers.read_documents(spark, str(folder)).collect()]
    assert found == [("b.txt", "b é"), ("c.txt", "c"), ("sub/a.txt", "café – x")]
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(folder), strict=True)


def test_energy_and_sinter(spark, tmp_path):
    path = write(tmp_path / "e.csv", "date,Usage_kWh\n02/01/2018 00:15,3\n01/01/2018 23:45,2\nnever,1\n")
    assert [r.Usage_kWh for r in loaders.read_energy(spark, path).where("datetime is not null").collect()] == [2, 3]
    df, features = loaders.read_sinter(spark, write(tmp_path / "s.csv", "Sample No,x\n1,2\n"))
    assert features == ["x"] and df.columns == ["Sample No", "x"]


def test_experiments(spark, tmp_path):
    names = ["Sinter", "Ore", "Pellet", "T Fe %", "FeO %", "SiO2 %", "CaO %", "Al2O3 %", " MgO%", "Basicity", "Ts", "Td", "Tm", "Tm-Ts", "DelP", "NDM"]
    rows = [[70, 30, 0, 60, 5, 4, 2, 1, 1, 1.5, 1300, 1400, 1500, 999, 1, 2], [70, 30, 0, 60, "x", 4, 2, 1, 1, 1.5, 1300, 1400, 1510, 210, 1, ""]]
    path = write(tmp_path / "x.csv", "\n".join(",".join(map(str, r)) for r in [names, *rows]))
    df, issues = loaders.read_experiments(spark, path)
    assert [(r.row_index, r.Tm_Ts, r.FeO_pct) for r in df.collect()] == [(1, 200.0, 5.0), (2, 210.0, None)]
    assert issues == ["FeO_pct: 1 non-numeric value(s)", "NDM: 1 missing value(s)"]
    with pytest.raises(ValueError):
        loaders.read_experiments(spark, write(tmp_path / "y.csv", "Ts,Tm\n1,2\n"))
    with pytest.raises(ValueError):
        loaders.complete(df, ["absent"])
    assert loaders.complete(df, ["FeO_pct", "Ts"]).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    loaders.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).collect()), key=str) == [(1, 2.5), (2, None)]
    with pytest.raises(Exception):  # noqa: B017
        loaders.write_csv(df, str(tmp_path / "out"))
    loaders.write_matrix(df, ["a", "b"], str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/matrix")).count() == 2
    path = str(tmp_path / "once/f.bin")
    assert loaders.write_once(path, b"x") and not loaders.write_once(path, b"x")
    with pytest.raises(FileExistsError):
        loaders.write_once(path, b"y")
    assert json.loads(loaders.to_json({"a": float("nan"), "b": [1, float("inf"), "x"], "c": {"d": None}})) == {"a": None, "b": [1, None, "x"], "c": {"d": None}}


def test_catalogue(spark, tmp_path):
    files = tmp_path / "files"
    write(files / "a.txt", "one")
    write(files / "copy.txt", "one")
    write(files / "b.txt", "two")
    kept = Catalogue(spark, str(tmp_path / "catalogue"))
    assert sorted(r.status for r in kept.register(str(files), "document").collect()) == ["new", "new"]
    assert sorted(r.status for r in kept.register(str(files), "document").collect()) == ["known", "known"]
    assert sorted(r.action for r in kept.register(str(files), "table").collect()) == ["review", "review"]
    first = kept.listed().orderBy("filename").collect()
    assert [(r.filename, r.state) for r in first] == [("a.txt", "registered"), ("b.txt", "registered")]
    kept.mark(first[0].resource_id, "normalized")
    assert kept.get(first[0].resource_id).head().state == "normalized"
    for wrong in ("registered", "nonsense"):
        with pytest.raises(ValueError):
            kept.mark(first[0].resource_id, wrong)
    (files / "b.txt").write_text("other")
    (files / "a.txt").unlink()
    assert sorted((r.path.rsplit("/", 1)[-1], r.state) for r in kept.reconcile(str(files)).collect()) == [("a.txt", "missing"), ("b.txt", "hash_mismatch"), ("copy.txt", "orphan")]
