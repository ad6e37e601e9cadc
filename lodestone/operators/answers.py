"""Answers from passages, for whole tables of questions at once.

Passages are found by the terms they share with a question, packed into a context, and
the sentences that share most words with the question are the answer.  What can't be
answered says why; no question stops another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTEXT_BUDGET, TOP_K
from ..functions import fidelity
from . import encode, retrieval
from .query import q

# What is said instead of an answer.
SAID = {
    "no_index": "No document index is available.",
    "no_match": "No relevant content found for that question. Try rephrasing, or upload the relevant document using the sidebar.",
    "no_room": "The context limit is too small to include source evidence.",
    "ungrounded": fidelity.NO_ANSWER,
}
SENTENCE = r"[^.!?]+[.!?]*"
SENTENCES, LONG = 2, 4


def sentences(text: Column) -> Column:
    """The sentences of a text; the point of a number ends none."""
    kept = F.regexp_replace(text, "([0-9])[.]([0-9])", "$1\u0001$2")
    plain = lambda s: F.trim(F.regexp_replace(F.translate(s, "\u0001", "."), r"\s+", " "))
    return F.filter(F.transform(F.regexp_extract_all(kept, F.lit(SENTENCE), F.lit(0)), plain), lambda s: s != "")


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(encode.terms(text), lambda w: F.length(w) >= LONG))


def chosen(asked: DataFrame, packed: DataFrame, most: int = SENTENCES) -> DataFrame:
    """question, answer: the ``most`` sentences that share most words with each question,
    in the order of the context.  Sentences that share none are left out.  ``asked``:
    question, text; ``packed``: question, place, content."""
    said = packed.select("question", "place", F.posexplode(sentences(F.col("content"))).alias("at", "sentence"))
    shared = said.join(asked.select("question", long_words(F.col("text")).alias("_words")), "question").withColumn("shared", F.size(F.array_intersect(long_words(F.col("sentence")), F.col("_words")))).where("shared > 0")
    best = Window.partitionBy("question").orderBy(F.desc("shared"), "place", "at")
    few = shared.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    ordered = F.sort_array(F.collect_list(F.struct("place", "at", "sentence")))
    return few.groupBy("question").agg(F.array_join(F.transform(ordered, lambda s: s["sentence"]), " ").alias("answer"))


def answer_all(questions: DataFrame, passages: DataFrame, key: str, text: str, top_n: int = TOP_K, budget: int = CONTEXT_BUDGET, most: int = SENTENCES) -> DataFrame:
    """key, state, answer, sources of every question.  ``passages``: chunk_id, source,
    role, section, content.  state: answered, ungrounded, no_room, no_match, no_index;
    sources are the chunk_ids of the context in its order."""
    asked = questions.select(q(key).alias("question"), q(text).alias("text"))
    counts = encode.term_counts(passages, "chunk_id", "content")
    idf = encode.inverse_frequencies(counts, passages)
    found = encode.matches(encode.weighted(encode.term_counts(asked, "question", "text"), idf), encode.weighted(counts, idf), top_n)
    ranked = found.join(passages.withColumnRenamed("chunk_id", "passage"), "passage")
    packed = retrieval.context(ranked.withColumnRenamed("passage", "chunk_id"), budget, ["question"], keep=["chunk_id"])
    parts = F.sort_array(F.collect_list(F.struct("place", "passage", "chunk_id")))
    contexts = packed.groupBy("question").agg(parts.alias("_p")).select("question", F.array_join("_p.passage", "").alias("context"), F.col("_p.chunk_id").alias("sources"))
    picked = chosen(asked, packed.select("question", "place", F.col("body").alias("content")), most)
    any_match = found.select("question").distinct().withColumn("matched", F.lit(True))
    rows = asked.select("question").join(any_match, "question", "left").join(contexts, "question", "left").join(picked, "question", "left")
    indexed = F.broadcast(passages.agg((F.count("*") > 0).alias("indexed")))
    answer = F.coalesce("answer", F.lit(""))
    state = (
        F.when(~F.col("indexed"), "no_index").when(F.col("matched").isNull(), "no_match").when(F.col("context").isNull(), "no_room")
        .when(fidelity.grounded(answer, F.col("context")), "answered").otherwise("ungrounded")
    )
    told = F.create_map(*(F.lit(x) for pair in SAID.items() for x in pair))
    done = rows.crossJoin(indexed).withColumn("state", state)
    return done.select(F.col("question").alias(key), "state", F.when(F.col("state") == "answered", fidelity.plain_basicity(answer)).otherwise(F.element_at(told, F.col("state"))).alias("answer"), F.coalesce("sources", F.array().cast(passages.schema["chunk_id"].dataType.simpleString().join(("array<", ">")))).alias("sources"))
