"""Every registered query against its SQL in DuckDB on the same tables."""

import os

import duckdb
import pytest

from lodestone.plans import catalog

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(TABLES):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{TABLES}/{name}')")
    return c


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    ours = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=str)
    found = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert ours == sorted((tuple(row[p] for p in places) for row in found.fetchall()), key=str)
    assert ours


def test_every_query_but_those_of_trees_has_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"train_search", "workflow_productivity"}


def test_a_search_over_a_table_gives_the_same_models_again(spark):
    one, two = (sorted(map(str, catalog.QUERIES["train_search"](spark, TABLES).collect())) for _ in range(2))
    assert one == two and len(one) == 2


def test_report_of_a_forest(spark):
    found = {(r.section, r.name): r.value for r in catalog.QUERIES["workflow_productivity"](spark, TABLES).collect()}
    assert found["statistics", "rows"] == 2000 and found["evaluation", "folds"] == 2 and ("anomalies", "small") in found


def test_topics_beside_letters_beyond_ascii_equal_sql(spark, tmp_path):
    texts = ["éque", "les\u0301 x", "ÉAND", "lesß", "and\u0663", "中and", "\u0130and", "x and y", "and_", "of the que", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    ours = {r.item_id: r.topic for r in catalog.QUERIES["topic_detect"](spark, str(tmp_path)).collect()}
    assert ours == dict(c.sql(catalog.SQL["topic_detect"]).fetchall())
    assert [ours[k] for k in (0, 2, 5, 6, 8)] == ["two", "one", "one", None, None]
