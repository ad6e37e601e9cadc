"""Hashed vectors, answers and their states, coverage, against plain Python."""

import hashlib
import math
import re
from collections import Counter

import pytest

from lodestone.functions import fidelity
from lodestone.operators import answers, encode, evaluate, retrieval

TEXTS = {1: "The furnace melts the sinter. Slag forms at the tap!", 2: "Sinter strength depends on basicity", 3: "", 4: None, 5: "sinter SINTER sinter"}


def plain_vectors(texts, buckets):
    terms = {k: [w.lower() for w in re.findall(r"[^\W_]+", t or "")] for k, t in texts.items()}
    hashed = {k: Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets for w in ws) for k, ws in terms.items()}
    df = Counter(b for c in hashed.values() for b in c)
    idf = {b: 1 + math.log((1 + len(texts)) / (1 + n)) for b, n in df.items()}
    out = {}
    for k, c in hashed.items():
        w = {b: n * idf[b] for b, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        out[k] = sorted((b, x / length) for b, x in w.items())
    return out


@pytest.mark.parametrize("buckets", [16, 1 << 16])
def test_vectors(spark, buckets):
    df = spark.createDataFrame(list(TEXTS.items()), "id int, text string")
    wanted = plain_vectors(TEXTS, buckets)
    for r in encode.encode(df, "id", "text", buckets).collect():
        assert r.indices == [b for b, _ in wanted[r.id]] and r["values"] == pytest.approx([x for _, x in wanted[r.id]])


def test_search_by_text_finds_only_what_shares_a_term(spark):
    df = spark.createDataFrame([(k, t, "s", "reference", "Overview" if k == 2 else "Other") for k, t in TEXTS.items()], "chunk_id int, embed_text string, topic string, role string, section string")
    found = retrieval.search_text(df, "sinter basicity", 3).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == [2, 5, 1] and found[0].score > found[1].score


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "q int, text string")


@pytest.fixture(scope="module")
def passages(spark):
    rows = [(1, "a.txt", "reference", "overview", "Coke breeze feeds the sinter strand. The strand moves slowly. Ignition happens at the hood."), (2, "b.txt", "reference", "limits", "Basicity near 1.8 °C was held for pellets. Nothing else matters."), (3, "c.txt", "reference", "body", "Ok so.")]
    return spark.createDataFrame(rows, "chunk_id int, source string, role string, section string, content string")


def test_states_and_sentences(spark, passages):
    found = {r.q: r for r in answers.answer_all(asked(spark, "Which ignition happens on the sinter strand?", "zzz qqq", None, "ok", "basicity held pellets"), passages, "q", "text").collect()}
    assert found[0].state == "answered" and found[0].answer == "Coke breeze feeds the sinter strand. Ignition happens at the hood." and found[0].sources[0] == 1
    assert (found[1].state, found[1].answer) == ("no_match", answers.SAID["no_match"]) and found[2].state == "no_match"
    assert (found[3].state, found[3].answer, found[3].sources) == ("ungrounded", fidelity.NO_ANSWER, [3])
    assert found[4].answer == "Basicity near 1.8 was held for pellets."


def test_no_room_and_no_index(spark, passages):
    one = asked(spark, "sinter strand")
    assert answers.answer_all(one, passages, "q", "text", budget=40).head().state == "no_room"
    row = answers.answer_all(one, passages.limit(0), "q", "text").head()
    assert (row.state, row.answer, row.sources) == ("no_index", answers.SAID["no_index"], [])


def test_a_long_first_passage_is_cut_and_its_body_answers(spark):
    long = spark.createDataFrame([(1, "a", "r", "s", "Sinter strand first. " + "filler words here. " * 200)], "chunk_id int, source string, role string, section string, content string")
    row = answers.answer_all(asked(spark, "first sinter strand"), long, "q", "text", budget=200).head()
    assert row.state == "answered" and row.answer.startswith("Sinter strand first.")


def test_coverage(spark):
    queries = spark.createDataFrame([(1, True, 5.0), (2, True, 7.0), (3, True, 9.0), (4, False, 1.0), (5, False, 3.0)], "query_id int, answerable boolean, elapsed_ms double")
    needed = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (2, "b", "x"), (3, "c", "x")], "query_id int, source string, section string")
    found = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "z", "x"), (1, 3, "a", "y"), (2, 2, "b", "q"), (2, 4, "b", "x"), (4, 1, "a", "x")], "query_id int, rank int, source string, section string")
    m = {r.metric: r.value for r in evaluate.coverage_metrics(queries, needed, found, (1, 3)).collect()}
    third = lambda x: round(x / 3, 6)
    assert m["recall@1"] == third(0.5) and m["recall@3"] == third(1) and m["hit_rate@1"] == third(1) and m["hit_rate@3"] == third(1)
    assert m["source_coverage@1"] == third(1) and m["source_coverage@3"] == third(2) and m["complete@1"] == 0 and m["complete@3"] == third(1)
    assert m["mrr"] == third(1.25) and m["nonempty_rate"] == 0.5 and (m["mean_ms"], m["median_ms"]) == (5.0, 5.0) and (m["query_count"], m["answerable_count"]) == (5, 3)
    for ks in ((), (0,), (3, 1), (1, 1), (True,)):
        with pytest.raises(ValueError):
            evaluate.coverage_metrics(queries, needed, found, ks)
