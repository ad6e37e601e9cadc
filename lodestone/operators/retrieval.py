"""Evidence retrieval: exact top-k by inner product, reranking, context packing."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOOST, CONTEXT_BUDGET, FAR_DISTANCE, MIN_TOPIC, NEAR_DISTANCE, PENALTY, POOL_FACTOR, TOP_K
from . import encode


def scorable(score: Column) -> Column:
    """False for null, NaN and the infinities: what vectors of different lengths, or with
    such entries, give."""
    return F.coalesce(~F.isnan(score) & (F.abs(score) < F.lit(float("inf"))), F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    """Null for vectors of different lengths."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def top_k(corpus: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows with the largest inner product; ties go to the smaller key.  The
    query is a literal, so this is one narrow pass and one top-n."""
    score = F.round(inner_product(F.col(vector), F.array(*(F.lit(float(x)) for x in query))), 6)
    return corpus.select(key, score.alias("score")).where(scorable(F.col("score"))).orderBy(F.desc("score"), key).limit(k)


def top_k_of(corpus: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, key, score, rank for each row of ``queries`` (query_id, q); a stated
    and small set of queries, all of which every corpus row meets once."""
    score = F.round(inner_product(F.col(vector), F.col("q")), 6)
    scored = corpus.select(key, vector).crossJoin(queries).where(F.col(key) != F.col("query_id")).select("query_id", key, score.alias("score")).where(scorable(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row for each batch of rows: its keys and vectors as bytes.  Rows without a
    key are left out, a vector that is null or has a null is all NaN."""

    def pack(batches):
        for batch in batches:
            rows = [(k, v) for k, v in zip(batch[0].to_pylist(), batch[1].to_pylist()) if k is not None]
            wide = max((len(v) for _, v in rows if v is not None), default=0)
            table = np.array([v if v is not None and None not in v else [np.nan] * wide for _, v in rows], "f8").reshape(len(rows), wide)
            if rows:
                yield pa.RecordBatch.from_pydict({"ids": [np.array([k for k, _ in rows], "i8").tobytes()], "vectors": [table.tobytes()]})

    return df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(pack, "ids binary, vectors binary")


def top_k_in_blocks(corpus: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """What ``top_k_of`` gives, for query sets that grow with the corpus: keys are whole
    numbers, unique in both, and vectors have one length.  A block of corpus rows meets
    a block of queries as a matrix product, and a task keeps k rows a query.  Rows
    without a score are left out; ties go to the smaller key."""

    def first(keys, scores):
        low = np.where(np.isnan(scores), -np.inf, scores)
        if len(low) > k:  # all rows as good as the k-th, so that ties are settled by key
            some = low >= np.partition(low, len(low) - k)[len(low) - k]
            keys, scores, low = keys[some], scores[some], low[some]
        order = np.lexsort((keys, -low))[:k]
        return keys[order], scores[order]

    def run(batches):
        best: dict[bytes, list] = {}
        for batch in batches:
            for ids, vectors, asked, wanted in zip(*(column.to_pylist() for column in batch.columns)):
                keys, q = np.frombuffer(ids, "i8"), np.frombuffer(asked, "i8")
                a, b = np.frombuffer(wanted, "f8").reshape(len(q), -1), np.frombuffer(vectors, "f8").reshape(len(keys), -1)
                scores = np.round(a @ b.T, 6) if a.shape[1] == b.shape[1] else np.full((len(q), len(keys)), np.nan)  # a block of nulls alone has no width
                held = best.get(asked, [(np.empty(0, "i8"), np.empty(0))] * len(q))
                best[asked] = [first(np.concatenate([held[i][0], keys[keys != q[i]]]), np.concatenate([held[i][1], scores[i][keys != q[i]]])) for i in range(len(q))]
        for asked, found in best.items():
            ids = np.repeat(np.frombuffer(asked, "i8"), [len(x) for x, _ in found])
            yield pa.RecordBatch.from_pydict({"query_id": ids, key: np.concatenate([x for x, _ in found]), "score": pa.array(np.concatenate([y for _, y in found]), from_pandas=True)})

    blocks = _blocks(corpus, queries, vector, key)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return blocks.mapInArrow(run, f"query_id long, `{key}` long, score double").where(scorable(F.col("score"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(corpus: DataFrame, queries: DataFrame, vector: str, key: str) -> DataFrame:
    """Every block of rows beside every block of queries.  Spark broadcasts the queries if
    they are as small as it allows, and deals pairs of partitions out if they aren't."""
    return _packed(corpus, key, vector).crossJoin(_packed(queries, "query_id", "q").toDF("asked", "wanted"))


def nearest_in_blocks(corpus: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, distance: how far the nearest other row of ``corpus`` is from each of
    ``queries`` (query_id, q), for query sets that grow with the corpus; keys are whole
    numbers.  Queries without a finite vector, or without another row, are left out.

    A block's distances are worked out only for queries that it could come nearer to: two
    vectors are at least as far apart as their lengths are."""

    def run(batches):
        best: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for ids, vectors, asked, wanted in zip(*(column.to_pylist() for column in batch.columns)):
                keys, q = np.frombuffer(ids, "i8"), np.frombuffer(asked, "i8")
                a, b = np.frombuffer(wanted, "f8").reshape(len(q), -1), np.frombuffer(vectors, "f8").reshape(len(keys), -1)
                held = best.setdefault(asked, np.full(len(q), np.inf))
                fine = np.isfinite(b).all(axis=1) if b.shape[1] else np.zeros(len(keys), bool)
                if a.shape[1] != b.shape[1] or not fine.any():
                    continue
                keys, b = keys[fine], b[fine]
                long, own = np.linalg.norm(b, axis=1), np.linalg.norm(a, axis=1)
                gap = np.maximum(0, np.maximum(long.min() - own, own - long.max()))
                some = np.flatnonzero(gap < held)  # not those that are NaN
                for at in range(0, len(some), 64):
                    i = some[at : at + 64]
                    square = ((a[i][:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
                    square[q[i][:, None] == keys[None, :]] = np.inf
                    held[i] = np.fmin(held[i], np.sqrt(square.min(axis=1)))
        for asked, found in best.items():
            near = np.isfinite(found)
            yield pa.RecordBatch.from_pydict({"query_id": np.frombuffer(asked, "i8")[near], "distance": found[near]})

    found = _blocks(corpus, queries, vector, key).mapInArrow(run, "query_id long, distance double")
    return found.groupBy("query_id").agg(F.round(F.min("distance"), 6).alias("distance"))


def confidence(distance: Column) -> Column:
    """high, medium or low by the distance to the nearest row; null without one."""
    return F.when(distance <= NEAR_DISTANCE, "high").when(distance <= FAR_DISTANCE, "medium").when(distance.isNotNull(), "low")


def nearest(corpus: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """Distance to the nearest row, and the confidence it gives."""
    d = distance(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return corpus.agg(F.round(F.min(d), 6).alias("distance")).withColumn("confidence", F.coalesce(confidence(F.col("distance")), F.lit("low")))


def reranked(score: Column, preferred: Column, penalised: Column) -> Column:
    """Boosts and penalties that raise and lower negative scores too."""
    return F.when(preferred, score + F.abs(score) * (BOOST - 1)).when(penalised, score + F.abs(score) * (PENALTY - 1)).otherwise(score)


# What a query that asks for an explanation, or for a scenario, looks like.
EXPLANATORY_WORDS = ("explain", "what is", "what are", "how does", "describe", "define", "overview", "process", "mechanism")
EXPLANATORY_SECTIONS = ("overview", "definition", "process", "key mechanisms", "mechanism", "production", "microstructure", "blast furnace significance", "key takeaways", "summary", "effect", "effects")
LOW_VALUE_SECTIONS = ("limitations", "disadvantages", "challenges", "drawbacks")
SCENARIO_INTENT = r"\b(?:scenario\s*\d*|experiment\b|experimental|burden mix|blend case)\b"
SCENARIO_POOL = 20


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector without length."""
    return F.try_divide(inner_product(a, b), F.nullif(F.sqrt(inner_product(a, a) * inner_product(b, b)), F.lit(0.0)))


def adjusted(query: str, score: Column, section: Column, role: Column) -> Column:
    """A score as the query's kind would have it: the scenario it names, scenarios at
    all, sections that explain, sections of little value.  Other queries leave it."""
    low, section = query.lower(), F.lower(section)
    named = re.search(r"\bscenario\s*(\d+)\b", low)
    within = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: section.contains(w))
    rules = []
    if named:
        rules.append((section.contains(f"scenario {named[1]}"), F.when(score >= 0, score * 1.35).otherwise(score * 0.65)))
        rules.append((role == "experiment_scenario", score * 0.95))
    elif re.search(SCENARIO_INTENT, low):
        rules.append((role == "experiment_scenario", score * 1.15))
    if any(w in low for w in EXPLANATORY_WORDS):
        rules.append((within(EXPLANATORY_SECTIONS), score + F.abs(score) * (BOOST - 1)))
        rules.append((within(LOW_VALUE_SECTIONS), score + F.abs(score) * (PENALTY - 1)))
    out = score
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def candidates(chunks: DataFrame, query: str, vocabulary: dict[str, list[str]], least: int = MIN_TOPIC) -> DataFrame:
    """The chunks of the only topic that the query names, and those of scenarios where it
    asks for one; all chunks where there is no such topic or it has too few."""
    low = query.lower()
    topics = [name for name, words in vocabulary.items() if any(re.search(rf"\b{re.escape(w)}\b", low) for w in words)]
    if len(topics) != 1 or chunks.where(F.col("topic") == topics[0]).limit(least).count() < least:
        return chunks
    chosen = F.col("topic") == topics[0]
    return chunks.where(chosen | (F.col("role") == "experiment_scenario") if re.search(SCENARIO_INTENT, low) else chosen)


def search(chunks: DataFrame, query: str, vector: list[float], top_n: int = TOP_K, vocabulary: dict[str, list[str]] | None = None, key: str = "chunk_id") -> DataFrame:
    """``chunks`` with score and rank: the best ``top_n`` of a pool found by inner product
    among the query's candidates, re-ranked.  Ties go to the first of the pool."""
    pool = _pool(query, top_n)
    score = inner_product(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector)))
    scored = candidates(chunks, query, vocabulary or {}).withColumn("score", F.round(score, 6)).where(scorable(F.col("score")))
    return _best(scored, query, pool, top_n, key)


def search_text(chunks: DataFrame, query: str, top_n: int = TOP_K, vocabulary: dict[str, list[str]] | None = None, key: str = "chunk_id", text: str = "embed_text") -> DataFrame:
    """``search`` from texts alone: vectors are hashed terms (``encode``), so chunks need
    none and only those that share a term with the query are found."""
    found = candidates(chunks, query, vocabulary or {})
    return _best(found.join(encode.scores(found, key, text, query), key), query, _pool(query, top_n), top_n, key)


def _pool(query: str, top_n: int) -> int:
    return max(POOL_FACTOR * top_n, SCENARIO_POOL) if re.search(SCENARIO_INTENT, query.lower()) else POOL_FACTOR * top_n


def _best(scored: DataFrame, query: str, pool: int, top_n: int, key: str) -> DataFrame:
    best = scored.orderBy(F.desc("score"), key).limit(pool)
    again = best.withColumn("first", F.col("score")).withColumn("score", F.round(adjusted(query, F.col("score"), F.col("section"), F.col("role")), 9))
    order = Window.orderBy(F.desc("score"), F.desc("first"), key)  # over the pool
    return again.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).drop("first")


CUT_MARK = "\n[Passage truncated to fit context budget.]"


def context(ranked: DataFrame, budget: int = CONTEXT_BUDGET, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """by, place, rank, passage, body, keep: the labelled passages of a context, best ones
    at both ends, the longest run from the front that the budget holds; a first one that
    is too long is cut and says so.  ``ranked``, a search's few rows, or those of each
    search in ``by``: rank, source, role, section, content."""
    placed = ranked.withColumn("place", edge_position(F.col("rank"), F.count("*").over(Window.partitionBy(*by))))
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), "source", F.lit(" | Role: "), "role", F.lit(" | Section: "), "section", F.lit("]\n"))
    first = F.col("place") == 1
    passage = F.concat(F.when(first, "").otherwise("\n\n"), F.col("head"), F.col("content"))
    sized = placed.withColumn("head", head).withColumn("passage", passage).withColumn("used", F.sum(F.length("passage")).over(Window.partitionBy(*by).orderBy("place")))
    room = F.lit(budget) - F.length("head") - len(CUT_MARK)
    cut = first & (F.col("used") > budget) & (room > 0)
    kept = sized.where((F.col("used") <= budget) | cut).withColumn("body", F.when(cut, F.left("content", room)).otherwise(F.col("content")))
    return kept.select(*by, "place", "rank", F.when(cut, F.concat("head", "body", F.lit(CUT_MARK))).otherwise(F.col("passage")).alias("passage"), "body", *keep)


def corpus_union(project: DataFrame, catalogued: DataFrame) -> DataFrame:
    return project.unionByName(catalogued, allowMissingColumns=True)


def similar(rows: DataFrame, asked: dict[str, float], k: int, key: str) -> DataFrame:
    """key, similarity of the ``k`` rows most like the asked one by the cosine of
    standardised features; incomplete rows are left out.  A constant feature counts 0."""
    names = list(asked)
    complete = rows.select(key, *(F.col(f"`{n}`").cast("double").alias(n) for n in names)).na.drop()
    s = complete.agg(*(f(F.col(f"`{n}`")).alias(f"{p}{i}") for i, n in enumerate(names) for p, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = lambda c, i: (c - F.col(f"m{i}")) / F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}"))
    both = complete.crossJoin(F.broadcast(s))
    mine = F.array(*(scaled(F.col(f"`{n}`"), i) for i, n in enumerate(names)))
    theirs = F.array(*(scaled(F.lit(float(asked[n])), i) for i, n in enumerate(names)))
    return both.select(key, F.round(F.coalesce(cosine(mine, theirs), F.lit(0.0)), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def edge_position(rank: Column, n: Column) -> Column:
    """Even places to the front, odd ones to the back in reverse."""
    return F.when((rank - 1) % 2 == 0, (rank + 1) / 2).otherwise(n - rank / 2 + 1).cast("long")
