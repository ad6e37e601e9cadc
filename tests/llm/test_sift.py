"""Rows that may have a key, told apart where they are read."""

from lodestone.llm.common import Workspace, sift


def test_sift_keeps_all_that_have_a_key_and_few_others(spark):
    df = spark.range(20_000).selectExpr("id", "id * 7 AS b", "id AS `_bits`").drop("_bits")
    keys = spark.range(0, 20_000, 40).selectExpr("id", "id * 7 AS b")
    may, not_ = sift(df, keys, ["id", "b"], Workspace(spark, "sift"), "bits")
    may, not_ = ({r.id for r in x.collect()} for x in (may, not_))
    assert may | not_ == set(range(20_000)) and not may & not_
    assert set(range(0, 20_000, 40)) <= may and len(may) < 3_000


def test_sift_without_keys(spark):
    may, not_ = sift(spark.range(10), spark.range(0), ["id"], Workspace(spark, "sift"), "bits")
    assert may.count() == 0 and not_.count() == 10


def test_sift_with_repeated_keys_repeats_nothing(spark):
    may, _ = sift(spark.range(100), spark.range(50).unionByName(spark.range(50)), ["id"], Workspace(spark, "sift"), "bits")
    assert sorted(r.id for r in may.collect())[:50] == list(range(50))
