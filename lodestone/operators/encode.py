"""Texts as vectors without a model: hashed terms, weighted and of unit length.

A term is a run of letters and digits in lower case; its bucket comes from its MD5, so
every cluster and every language of a reader finds the same one.  A bucket weighs its
count in the text times 1 + ln((1 + N) / (1 + n)), n of N texts having it.  A table of
weights has one row for each bucket at most, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .query import q

#: Buckets, and how many of a question's terms, the heaviest, look for passages.
BUCKETS, TERMS = 1 << 16, 12
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def term_counts(df: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """key, bucket, n: how often a bucket's terms are in each text.  Keys differ."""
    exploded = df.select(q(key).alias("key"), F.explode(terms(q(text))).alias("term"))
    return exploded.groupBy("key", bucket(F.col("term"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def inverse_frequencies(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """bucket, idf; ``texts`` is the table whose terms were counted."""
    whole = F.broadcast(texts.agg(F.count("*").alias("_rows")))
    found = counts.groupBy("bucket").agg(F.count("*").alias("_n")).crossJoin(whole)
    return found.select("bucket", (1 + F.log((1 + F.col("_rows")) / (1 + F.col("_n")))).alias("idf"))


def weighted(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """key, bucket, weight: unit vectors, one row for each bucket; buckets that ``idf``
    doesn't know are left out."""
    raw = counts.join(F.broadcast(idf), "bucket").select("key", "bucket", (F.col("n") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return raw.select("key", "bucket", (F.col("w") / length).alias("weight"))


def encode(df: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """key, indices, values of each text's vector, indices ascending; no entries for a
    text without terms."""
    counts = term_counts(df, key, text, buckets)
    rows = weighted(counts, inverse_frequencies(counts, df)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("_v"))
    found = df.select(q(key).alias("key")).join(rows, "key", "left")
    return found.select(F.col("key").alias(key), F.coalesce(F.col("_v.bucket"), F.array().cast("array<int>")).alias("indices"), F.coalesce(F.col("_v.weight"), F.array().cast("array<double>")).alias("values"))


def heaviest(vectors: DataFrame, most: int = TERMS) -> DataFrame:
    """The ``most`` heaviest buckets of each vector (of ``weighted``); the smaller on ties."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "bucket"))
    return vectors.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def matches(questions: DataFrame, passages: DataFrame, top_n: int, most: int = TERMS) -> DataFrame:
    """question, passage, score, rank: for each question the ``top_n`` passages with the
    largest inner product over the question's ``most`` heaviest buckets; ties go to the
    smaller passage.  Both sides are vectors (of ``weighted``).

    A question meets only passages that share a heavy, so a rare, term with it; products
    are added up before the shuffle."""
    asked = heaviest(questions, most).select(F.col("key").alias("question"), "bucket", F.col("weight").alias("_a"))
    met = asked.join(passages.select(F.col("key").alias("passage"), "bucket", F.col("weight").alias("_b")), "bucket")
    scored = met.groupBy("question", "passage").agg(F.round(F.sum(F.col("_a") * F.col("_b")), 6).alias("score"))
    order = Window.partitionBy("question").orderBy(F.desc("score"), "passage")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def scores(df: DataFrame, key: str, text: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """key, score of the texts that share a term with a query, by cosine."""
    counts = term_counts(df, key, text, buckets)
    idf = inverse_frequencies(counts, df)
    asked = term_counts(df.sparkSession.createDataFrame([(0, query)], "k int, t string"), "k", "t", buckets)
    # The query's buckets are no more than its terms.
    mine = F.broadcast(weighted(asked, idf).select("bucket", F.col("weight").alias("_q")))
    return weighted(counts, idf).join(mine, "bucket").groupBy(F.col("key").alias(key)).agg(F.round(F.sum(F.col("weight") * F.col("_q")), 6).alias("score"))
