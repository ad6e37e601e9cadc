"""Registered queries of hashed vectors, searches by text, answers and their coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, encode, evaluate, retrieval
from .catalog import _asked, register
from .text_queries import _LONG

_BUCKETS = encode.BUCKETS


def _counts(table: str, key: str) -> str:
    return f"(SELECT {key} AS key, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {_BUCKETS} AS INT) AS bucket, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '{encode.TERM}')) AS w FROM {table}) GROUP BY 1, 2)"


def _idf(table: str, key: str) -> str:
    return f"(SELECT bucket, 1 + ln((1 + (SELECT count(*) FROM {table})) / (1 + count(*))) AS idf FROM {_counts(table, key)} GROUP BY 1)"


def _vectors(table: str, key: str, idf: str) -> str:
    return f"(SELECT key, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM (SELECT key, bucket, n * idf AS w FROM {_counts(table, key)} JOIN {idf} USING (bucket)))"


register("encode_texts", f"SELECT doc_id, coalesce(vector, '') AS vector FROM documents LEFT JOIN (SELECT key, string_agg(bucket || ':' || CAST(round(weight * 1000000) AS BIGINT), ' ' ORDER BY bucket) AS vector FROM {_vectors('documents', 'doc_id', _idf('documents', 'doc_id'))} GROUP BY 1) ON key = doc_id")(
    lambda t: encode.encode(t("documents"), "doc_id", "text").select("doc_id", F.array_join(F.zip_with("indices", "values", lambda i, v: F.concat(i.cast("string"), F.lit(":"), F.round(v * 1000000).cast("long").cast("string"))), " ").alias("vector")))

_TEXT = "Explain the process of that and the thing with those"
_SECTIONED = "SELECT doc_id, text, lang AS topic, CASE WHEN doc_id % 7 = 0 THEN 'experiment_scenario' ELSE 'reference' END AS role, CASE doc_id % 3 WHEN 0 THEN 'Overview' WHEN 1 THEN 'limitations' ELSE 'Other' END AS section FROM {documents}"
_HIT = f"(SELECT d.key, round(sum(d.weight * a.weight), 6) AS s FROM {_vectors('documents', 'doc_id', _idf('documents', 'doc_id'))} d JOIN {_vectors('(SELECT 0 AS k, ' + repr(_TEXT) + ' AS text)', 'k', _idf('documents', 'doc_id'))} a USING (bucket) GROUP BY 1)"
register("search_text", f"""WITH p AS (SELECT doc_id, section, s FROM {_HIT} JOIN ({_SECTIONED.format(documents='documents')}) ON doc_id = key ORDER BY s DESC, doc_id LIMIT 10),
a AS (SELECT doc_id, s, round(CASE section WHEN 'Overview' THEN s + abs(s) * (1.15 - 1) WHEN 'limitations' THEN s + abs(s) * (0.75 - 1) ELSE s END, 9) AS score FROM p)
SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, s DESC, doc_id) AS INT) AS rank FROM a QUALIFY rank <= 5""")(
    lambda t: retrieval.search_text(_sectioned(t), _TEXT, key="doc_id", text="text").select("doc_id", "score", "rank"))


def _sectioned(t):
    return t("documents").selectExpr("doc_id", "text", "lang AS topic", "CASE WHEN doc_id % 7 = 0 THEN 'experiment_scenario' ELSE 'reference' END AS role", "CASE doc_id % 3 WHEN 0 THEN 'Overview' WHEN 1 THEN 'limitations' ELSE 'Other' END AS section")


# --- answers --------------------------------------------------------------------

_BUDGET = 700
_ASKED = "(SELECT conv_id * 1000 + turn AS question, text FROM conversations)"
_PASSAGES = "(SELECT item_id AS chunk_id, 'bench/' || item_id % 7 AS source, 'reference' AS role, 'part ' || item_id % 3 AS section, text AS content, text FROM benchmark)"


def _words(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '{encode.TERM}'), lambda w: length(w) >= {answers.LONG}))"


_SAID = {k: v.replace("'", "''") for k, v in answers.SAID.items()}
register("answers", f"""WITH idf AS MATERIALIZED {_idf(_PASSAGES, 'chunk_id')}, p AS MATERIALIZED {_vectors(_PASSAGES, 'chunk_id', 'idf')}, a AS MATERIALIZED {_vectors(_ASKED, 'question', 'idf')},
h AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY weight DESC, bucket) <= {encode.TERMS}),
s AS (SELECT h.key AS question, p.key AS chunk_id, round(sum(h.weight * p.weight), 6) AS score FROM h JOIN p USING (bucket) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5),
q AS (SELECT *, CAST(CASE WHEN rank % 2 = 1 THEN (rank + 1) / 2 ELSE count(*) OVER (PARTITION BY question) - rank / 2 + 1 END AS BIGINT) AS place, '[Source ' || rank || ': ' || source || ' | Role: ' || role || ' | Section: ' || section || ']' || chr(10) AS head FROM r JOIN {_PASSAGES} USING (chunk_id)),
u AS (SELECT *, CASE WHEN place = 1 THEN '' ELSE chr(10) || chr(10) END || head || content AS passage, sum(length(CASE WHEN place = 1 THEN '' ELSE '##' END || head || content)) OVER (PARTITION BY question ORDER BY place) AS used, {_BUDGET} - length(head) - {len(retrieval.CUT_MARK)} AS room FROM q),
k AS (SELECT question, chunk_id, place, CASE WHEN used <= {_BUDGET} THEN passage ELSE head || left(content, room) || '{retrieval.CUT_MARK.replace(chr(10), "' || chr(10) || '")}' END AS passage, CASE WHEN used <= {_BUDGET} THEN content ELSE left(content, room) END AS body FROM u WHERE used <= {_BUDGET} OR (place = 1 AND room > 0)),
c AS (SELECT question, string_agg(passage, '' ORDER BY place) AS context, string_agg(chunk_id, ',' ORDER BY place) AS sources FROM k GROUP BY 1),
l AS (SELECT question, place, x.nth, trim(regexp_replace(replace(x.s, chr(1), '.'), '\\s+', ' ', 'g')) AS sentence FROM (SELECT * REPLACE (regexp_replace(body, '([0-9])[.]([0-9])', '\\1' || chr(1) || '\\2', 'g') AS body) FROM k) k, LATERAL (SELECT unnest(regexp_extract_all(body, '{answers.SENTENCE}')) AS s, generate_subscripts(regexp_extract_all(body, '{answers.SENTENCE}'), 1) AS nth) AS x),
m AS (SELECT l.*, len(list_intersect({_words('sentence')}, {_words('text')})) AS shared FROM l JOIN {_ASKED} t USING (question) WHERE sentence <> ''),
n AS (SELECT * FROM m WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY question ORDER BY shared DESC, place, nth) <= {answers.SENTENCES}),
o AS (SELECT question, string_agg(sentence, ' ' ORDER BY place, nth) AS answer FROM n GROUP BY 1),
z AS (SELECT t.question, CASE WHEN r.question IS NULL THEN 'no_match' WHEN context IS NULL THEN 'no_room' WHEN len(list_intersect({_LONG.format(c="coalesce(answer, '')")}, {_LONG.format(c='context')})) >= 3 THEN 'answered' ELSE 'ungrounded' END AS state, answer, coalesce(sources, '') AS sources
  FROM {_ASKED} t LEFT JOIN (SELECT DISTINCT question FROM r) r USING (question) LEFT JOIN c USING (question) LEFT JOIN o USING (question))
SELECT question, state, CASE state WHEN 'answered' THEN answer WHEN 'no_match' THEN '{_SAID['no_match']}' WHEN 'no_room' THEN '{_SAID['no_room']}' ELSE '{_SAID['ungrounded']}' END AS answer, sources FROM z""")(
    lambda t: answers.answer_all(t("conversations").selectExpr("conv_id * 1000 + turn AS question", "text"), _passages(t), "question", "text", budget=_BUDGET).withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ",")))


def _passages(t):
    return t("benchmark").selectExpr("item_id AS chunk_id", "concat('bench/', item_id % 7) AS source", "'reference' AS role", "concat('part ', item_id % 3) AS section", "text AS content")


# --- coverage -------------------------------------------------------------------

#: A passage of the vectors: its source and section.
_PLACE = "'s' || label % 7 AS source, 'p' || vec_id % 5 AS section"
_KS = (1, 3, 5)


def _placed(e):
    return e.select("vec_id", F.expr("concat('s', label % 7)").alias("source"), F.expr("concat('p', vec_id % 5)").alias("section"))


def _covered(t):
    """Every row whose vec_id is divisible by 50 asks; it needs the passages of the three
    rows after it, and those divisible by 100 can be answered."""
    e = t("embeddings")
    asked = _asked(e, "vec_id % 50 = 0")
    needed = asked.select("query_id", F.explode(F.array(*(F.col("query_id") + k for k in (1, 2, 3)))).alias("vec_id")).join(_placed(e), "vec_id")
    found = retrieval.top_k_in_blocks(e, asked.select("query_id", "q"), 10).join(_placed(e), "vec_id")
    return evaluate.coverage_metrics(asked.select("query_id", (F.col("query_id") % 100 == 0).alias("answerable")), needed, found, _KS)


_K = {k: (f"list_sum(list_transform(ps, lambda r: CASE WHEN r <= {k} THEN 1 ELSE 0 END)) / len(ps)", f"list_sum(list_transform(ss, lambda r: CASE WHEN r <= {k} THEN 1 ELSE 0 END)) / len(ss)") for k in _KS}
_AVG = "SELECT '{m}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM e"
_METRICS = [("query_count", "count(*)"), ("answerable_count", "count(*) FILTER (ok)")]
for _k, (_p, _s) in _K.items():
    _METRICS += [(f"recall@{_k}", f"avg({_p}) FILTER (ok)"), (f"hit_rate@{_k}", f"avg(CASE WHEN {_p} > 0 THEN 1.0 ELSE 0.0 END) FILTER (ok)"), (f"source_coverage@{_k}", f"avg({_s}) FILTER (ok)"), (f"complete@{_k}", f"avg(CASE WHEN {_p} = 1 THEN 1.0 ELSE 0.0 END) FILTER (ok)")]
_METRICS += [("mrr", "avg(coalesce(1 / nullif(list_min(ps), 1000000), 0.0)) FILTER (ok)"), ("nonempty_rate", "avg(1.0) FILTER (NOT ok)")]
register("coverage_metrics", f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10), pl AS (SELECT vec_id, {_PLACE} FROM embeddings),
f AS (SELECT query_id, source, section, min(rank) AS rank FROM r JOIN pl USING (vec_id) GROUP BY 1, 2, 3), need AS (SELECT DISTINCT q.vec_id AS query_id, source, section FROM embeddings q JOIN pl ON pl.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 3 WHERE q.vec_id % 50 = 0),
p AS (SELECT query_id, list(coalesce(rank, 1000000)) AS ps FROM need LEFT JOIN f USING (query_id, source, section) GROUP BY 1), so AS (SELECT query_id, list(coalesce(rank, 1000000)) AS ss FROM (SELECT DISTINCT query_id, source FROM need) LEFT JOIN (SELECT query_id, source, min(rank) AS rank FROM f GROUP BY 1, 2) USING (query_id, source) GROUP BY 1),
e AS (SELECT vec_id AS query_id, vec_id % 100 = 0 AS ok, ps, ss FROM embeddings LEFT JOIN p ON p.query_id = vec_id LEFT JOIN so ON so.query_id = vec_id WHERE vec_id % 50 = 0)
""" + " UNION ALL ".join(_AVG.format(m=m, e=x) for m, x in _METRICS))(_covered)
