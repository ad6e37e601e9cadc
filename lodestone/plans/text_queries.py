"""Registered queries of chunking, retrieval, fidelity and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fidelity, text
from ..operators import evaluate, order, retrieval
from .catalog import _LIST, _QUERY, TURN_PAIRS, _turn_pairs, register

# --- chunks ---------------------------------------------------------------------

_MARKED = "concat('TOPIC: Sinter\\nROLE: experiment plan\\nintro words\\n here\\nSECTION: Overview\\n', text, '\\n\\nSECTION: References\\nold\\nSection:  Key limits \\n tail   end \\n')"
_ONE_LINE = "trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))"
register("chunk_sections", f"""WITH b AS (SELECT 'docs/' || item_id || '.txt' AS source, {_ONE_LINE} AS one FROM benchmark), s(position, section, content) AS (VALUES (0, 'introduction', 'intro words here'), (1, 'overview', NULL), (2, 'key limits', 'tail end'))
SELECT source, CAST(position AS BIGINT) AS position, 'sinter' AS topic, 'experiment_scenario' AS role, section, coalesce(content, one) AS content FROM b, s""")(
    lambda t: text.chunks(t("benchmark").selectExpr("concat('docs/', item_id, '.txt') AS source", _MARKED + " AS text")).drop("embed_text", "chunk_id"))
register("chunk_headings", f"""WITH b AS (SELECT 'lab/Experiments/' || item_id || '.note.txt' AS source, item_id, {_ONE_LINE} AS one FROM benchmark), s(position, section, content) AS (VALUES (0, 'process view', NULL), (1, 'limits of heat', 'none seen'), (2, 'advantages (new)', 'good'))
SELECT source, CAST(position AS BIGINT) AS position, item_id || '.note' AS topic, 'experiment_scenario' AS role, section, 'TOPIC: ' || item_id || '.note' || chr(10) || 'SECTION: ' || section || chr(10) || coalesce(content, one) AS embed_text FROM b, s""")(
    lambda t: text.chunks(t("benchmark").selectExpr("concat('lab/Experiments/', item_id, '.note.txt') AS source", "concat('## Process View\\n', trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ')), '\\nLIMITS OF HEAT\\nnone seen\\n\\nadvantages (new)\\ngood\\nSEE ALSO\\nx') AS text")).drop("content", "chunk_id"))
register("corpus_union", "SELECT item_id AS id, 'project' AS origin, text FROM benchmark UNION ALL SELECT conv_id * 1000 + turn, 'catalogue', text FROM conversations")(
    lambda t: retrieval.corpus_union(t("benchmark").selectExpr("item_id AS id", "'project' AS origin", "text"), t("conversations").selectExpr("text", "conv_id * 1000 + turn AS id", "'catalogue' AS origin")))
register("follow_up_queries", "SELECT conv_id, turn, CASE WHEN len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) <= 4 AND b <> '' THEN b || ' ' || q ELSE q END AS query FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'and  why so' ELSE text END AS q, before AS b FROM " + TURN_PAIRS + ")")(
    lambda t: _turn_pairs(t).select("conv_id", "turn", text.follow_up(F.expr("CASE WHEN turn % 2 = 1 THEN 'and  why so' ELSE text END"), F.col("before")).alias("query")))
register("safe_filenames", r"SELECT page_id, nullif(regexp_replace(regexp_replace(trim(regexp_extract(u, '([^/]*)$', 1)), '[<>:\"/\\|?*\x00-\x1f]', '_', 'g'), '[. ]+$', ''), '') AS name FROM (SELECT page_id, replace(url || '/a<b>:' || page_id || CASE WHEN page_id % 4 = 0 THEN '\..' ELSE '? x. .' END, '\', '/') AS u FROM pages)")(
    lambda t: t("pages").select("page_id", text.safe_filename(F.concat("url", F.lit("/a<b>:"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, "\\..").otherwise("? x. ."))).alias("name")))

# --- search ---------------------------------------------------------------------

_CHUNK = "vec_id, embedding, CASE WHEN label % 3 = 0 THEN 'sinter' ELSE 'slag' END AS topic, CASE WHEN vec_id % 7 = 0 THEN 'experiment_scenario' ELSE 'reference' END AS role, CASE vec_id % 4 WHEN 0 THEN 'Overview' WHEN 1 THEN 'Scenario 2 results' WHEN 2 THEN 'limitations' ELSE 'Other' END AS section"
_EXPLAIN, _SCENARIO, _BLEND = "What is the coke breeze process?", "Explain scenario 2", "burden mix of coke breeze"
_VOCABULARY = {"sinter": ["sinter", "coke breeze"], "slag": ["slag formation"]}
_SCORED = f"(SELECT *, round(list_inner_product(embedding::DOUBLE[], {_LIST}), 6) AS s FROM (SELECT {_CHUNK} FROM embeddings))"
_HIGH, _LOW = "s + abs(s) * 0.15", "s - abs(s) * 0.25"
_CASES = {
    _EXPLAIN: f"CASE WHEN section = 'Overview' THEN {_HIGH} WHEN section = 'limitations' THEN {_LOW} ELSE s END",
    _SCENARIO: f"CASE WHEN section LIKE 'Scenario 2%' THEN CASE WHEN s >= 0 THEN s * 1.35 ELSE s * 0.65 END WHEN role = 'experiment_scenario' THEN s * 0.95 WHEN section = 'Overview' THEN {_HIGH} WHEN section = 'limitations' THEN {_LOW} ELSE s END",
    _BLEND: "CASE WHEN role = 'experiment_scenario' THEN s * 1.15 ELSE s END",
}


def _chunks(t):
    return t("embeddings").selectExpr(*_split(_CHUNK))


for _k, _q in enumerate(_CASES):
    register(f"rerank_adjust_{_k}", f"SELECT vec_id, round({_CASES[_q]}, 9) AS adjusted FROM {_SCORED}")(
        lambda t, q=_q: _chunks(t).withColumn("s", F.round(retrieval.inner_product(F.col("embedding"), F.array(*map(F.lit, _QUERY))), 6)).select("vec_id", F.round(retrieval.adjusted(q, F.col("s"), F.col("section"), F.col("role")), 9).alias("adjusted")))
_KEPT = {_EXPLAIN: ("topic = 'sinter'", 10), _SCENARIO: ("true", 20), _BLEND: ("topic = 'sinter' OR role = 'experiment_scenario'", 20)}
for _k, _q in enumerate(_CASES):
    register(f"search_{_k}", f"WITH p AS (SELECT * FROM {_SCORED} WHERE {_KEPT[_q][0]} ORDER BY s DESC, vec_id LIMIT {_KEPT[_q][1]}), a AS (SELECT vec_id, s, round({_CASES[_q]}, 9) AS score FROM p) SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, s DESC, vec_id) AS INT) AS rank FROM a QUALIFY rank <= 5")(
        lambda t, q=_q: retrieval.search(_chunks(t), q, _QUERY, vocabulary=_VOCABULARY, key="vec_id").select("vec_id", "score", "rank"))
register("cosine", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_LIST}), 6) AS cosine FROM embeddings")(lambda t: t("embeddings").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.array(*map(F.lit, _QUERY))), 6).alias("cosine")))
register("similar_rows", """WITH s AS (SELECT avg(p_size) m1, stddev_pop(p_size) s1, avg(p_retailprice) m2, stddev_pop(p_retailprice) s2 FROM part), z AS (SELECT p_partkey, (p_size - m1) / s1 AS a, (p_retailprice - m2) / s2 AS b, (10 - m1) / s1 AS c, (1200 - m2) / s2 AS d FROM part, s)
SELECT p_partkey, round((a * c + b * d) / sqrt((a * a + b * b) * (c * c + d * d)), 6) AS similarity FROM z ORDER BY similarity DESC, p_partkey LIMIT 5""")(lambda t: retrieval.similar(t("part"), {"p_size": 10, "p_retailprice": 1200}, 5, "p_partkey"))
#: The passages of a conversation are its turns, ranked in their order.
_TURNS = "(SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, count(*) OVER (PARTITION BY conv_id) AS n, '[Source ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ': talk | Role: ' || role || ' | Section: turn]' || chr(10) AS head FROM conversations)"


def _packed(budget: int) -> str:
    """conv_id, place, rank, passage of every conversation's context."""
    return f"""WITH p AS (SELECT conv_id, rank, CAST(CASE WHEN rank % 2 = 1 THEN (rank + 1) / 2 ELSE n - rank / 2 + 1 END AS BIGINT) AS place, head, text FROM {_TURNS}),
u AS (SELECT *, CASE WHEN place = 1 THEN '' ELSE chr(10) || chr(10) END || head || text AS passage, sum(length(head || text) + CASE WHEN place = 1 THEN 0 ELSE 2 END) OVER (PARTITION BY conv_id ORDER BY place) AS used, {budget} - length(head) - 43 AS room FROM p)
SELECT conv_id, place, CAST(rank AS INT) AS rank, CASE WHEN used <= {budget} THEN passage ELSE head || left(text, room) || chr(10) || '[Passage truncated to fit context budget.]' END AS passage FROM u WHERE used <= {budget} OR (place = 1 AND room > 0)"""


def _contexts(t, budget: int):
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    ranked = t("conversations").select("conv_id", F.row_number().over(by_turn).alias("rank"), F.lit("talk").alias("source"), "role", F.lit("turn").alias("section"), F.col("text").alias("content"))
    return retrieval.context(ranked, budget, ["conv_id"]).drop("body")


register("contexts_by_conversation", _packed(900))(lambda t: _contexts(t, 900))
register("contexts_by_conversation_cut", _packed(100))(lambda t: _contexts(t, 100))
_PASSAGE = "'[Source ' || rank || ': bench | Role: reference | Section: body]' || chr(10) || text"
register("context_pack", f"""WITH r AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS rank, count(*) OVER () AS n FROM benchmark), p AS (SELECT rank, CAST(CASE WHEN rank % 2 = 1 THEN (rank + 1) / 2 ELSE n - rank / 2 + 1 END AS BIGINT) AS place, {_PASSAGE} AS passage FROM r),
c AS (SELECT place, CAST(rank AS INT) AS rank, CASE WHEN place = 1 THEN '' ELSE chr(10) || chr(10) END || passage AS passage FROM p), u AS (SELECT *, sum(length(passage)) OVER (ORDER BY place) AS used FROM c) SELECT place, rank, passage FROM u WHERE used <= 3000""")(
    lambda t: retrieval.context(_ranked(t), 3000).drop("body"))
register("context_pack_cut", f"WITH p AS (SELECT {_PASSAGE} AS passage FROM (SELECT text, 1 AS rank FROM benchmark ORDER BY item_id LIMIT 1)) SELECT CAST(1 AS BIGINT) AS place, 1 AS rank, left(passage, 100 - 43) || chr(10) || '[Passage truncated to fit context budget.]' AS passage FROM p")(lambda t: retrieval.context(_ranked(t), 100).drop("body"))


def _ranked(t):
    """All items ranked by their id, without a task that sorts them all."""
    rows = t("benchmark").select("item_id", F.col("text").alias("content"), F.lit(1).cast("long").alias("one"))
    ranked = order.running(rows.select("item_id", "one"), "item_id", "one").select("item_id", F.col("upto_one").cast("int").alias("rank"))
    return rows.join(ranked, "item_id").select("item_id", "rank", F.lit("bench").alias("source"), F.lit("reference").alias("role"), F.lit("body").alias("section"), "content")

# --- fidelity -------------------------------------------------------------------

_PAIR = "conv_id, turn, before AS message, CASE WHEN turn % 2 = 0 THEN 'interpretation' ELSE 'other' END AS kind, {limits} AS limitations, CASE WHEN turn % 3 = 0 THEN concat('Consider ', left(before, 60)) WHEN turn % 3 = 1 THEN 'Rows are required' END AS recommendation, concat(text, CASE turn % 5 WHEN 0 THEN ' This leads to a loss.' WHEN 1 THEN ' You must remove the column.' WHEN 2 THEN ' The range of values is due to the median value.' ELSE '' END) AS explanation"
_SQL_PAIRS = "(SELECT " + _PAIR.format(limits="[left(before, 80)]") + f" FROM {TURN_PAIRS})"


def _sql_any(text_, phrases):
    return "(" + " OR ".join(f"contains({text_}, '{p}')" for p in phrases) + ")"


def _pairs(t):
    return _turn_pairs(t).selectExpr(*_split(_PAIR.format(limits="array(left(before, 80))")), "concat(conv_id, '/', turn) AS pair")


def _split(sql):
    """The columns of a select list, cut at commas outside brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(sql):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out, start = [*out, sql[start:k]], k + 1
    return [*out, sql[start:]]


_SAID, _SOURCE, _ASKED = "lower(explanation)", "lower(message)", "lower(trim(coalesce(recommendation, '')))"
_TOK = "list_distinct(regexp_extract_all({x}, '[a-z]{{4,}}'))"
_PLAIN = "[" + ", ".join(f"'{w}'" for w in fidelity.COMMON) + "]"
_NOT_MEANT = "['consider', 'suggest', 'potential', 'optional', 'investigate', 'evaluate']"
_NUMBERS = r"list_distinct(list_transform(regexp_extract_all({c}, '-?\d+\.?\d*%?'), lambda x: format('{{:g}}', CAST(rtrim(x, '%') AS DOUBLE)) || CASE WHEN suffix(x, '%') THEN '%' ELSE '' END))"
_MEANT = f"list_filter({_TOK.format(x=_ASKED)}, lambda x: NOT list_contains({_PLAIN}, x) AND NOT list_contains({_NOT_MEANT}, x))"
_CHECKS = {
    "numerical_fidelity": f"len(list_filter({_NUMBERS.format(c='message')}, lambda x: NOT list_contains({_NUMBERS.format(c='explanation')}, x))) = 0",
    "causal_language": f"NOT ({_sql_any(_SAID, fidelity.CAUSAL)} AND (kind = 'interpretation' OR {_sql_any(_SOURCE, fidelity.ASSOCIATIONAL)}) AND NOT {_sql_any(_SOURCE, fidelity.CAUSAL)})",
    "limitation_preserved": f"len(list_intersect({_TOK.format(x='lower(limitations[1])')}, {_TOK.format(x=_SAID)})) >= 2",
    "recommendation_fidelity": f"CASE WHEN {_ASKED} = '' THEN NOT regexp_matches({_SAID}, '{fidelity.UNASKED[4:]}') ELSE NOT ({_sql_any(_ASKED, fidelity.TENTATIVE)} AND NOT {_sql_any(_ASKED, fidelity.MANDATORY)} AND (regexp_matches({_SAID}, '\\b(?:{'|'.join(fidelity.MANDATORY)})\\b') OR (regexp_matches({_SAID}, '{fidelity.COMMAND[4:]}') AND NOT {_sql_any(_SAID, fidelity.TENTATIVE)}))) AND (len({_MEANT}) = 0 OR list_has_any({_MEANT}, {_TOK.format(x=_SAID)})) END",
    "metric_semantics": f"NOT (({_sql_any(_SOURCE, ('iqr', 'interquartile'))} AND NOT contains({_SOURCE}, 'range') AND regexp_matches({_SAID}, '{fidelity.WHOLE_RANGE}')) OR ({_sql_any(_SOURCE, ('quartile', 'q1', 'q3'))} AND NOT contains({_SOURCE}, 'median') AND regexp_matches({_SAID}, '\\b(?:the\\s+median|median\\s+value)\\b')))",
    "unsupported_novelty": f"coalesce(len(list_filter({_TOK.format(x=_SAID)}, lambda x: NOT list_contains({_TOK.format(x=_SOURCE)}, x) AND NOT list_contains({_TOK.format(x='lower(limitations[1])')}, x) AND NOT list_contains({_TOK.format(x=_ASKED)}, x) AND NOT list_contains({_PLAIN}, x))) / nullif(len({_TOK.format(x=_SAID)}), 0), 0) <= 0.45",
}
_CHECKED = " UNION ALL ".join(f"SELECT conv_id || '/' || turn AS pair, '{name}' AS \"check\", {sql} AS passed FROM {_SQL_PAIRS}" for name, sql in _CHECKS.items())
register("fidelity_checks", _CHECKED)(lambda t: fidelity.checks(_pairs(t), "pair"))
register("fidelity_pass_rates", f"SELECT \"check\", count(*) AS n, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM ({_CHECKED}) GROUP BY 1")(lambda t: evaluate.pass_rates(fidelity.checks(_pairs(t), "pair")))
_LONG = r"list_filter(list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+(?:[''-]+[\p{{L}}\p{{N}}_]+)*')), lambda w: length(w) > 3)"
register("grounding_guard", f"SELECT conv_id, turn, CASE WHEN len(list_intersect({_LONG.format(c='text')}, {_LONG.format(c='before')})) >= 3 THEN text ELSE '{fidelity.NO_ANSWER}' END AS answer FROM {TURN_PAIRS}")(lambda t: _turn_pairs(t).select("conv_id", "turn", fidelity.guarded(F.col("text"), F.col("before")).alias("answer")))
register("basicity_units", "SELECT p_partkey, 'Basicity of ' || p_size || '.5 was held; basicity at temp 3°C, basicity (around 1.6-1.9) and Ts 1200°C' AS fixed FROM part")(
    lambda t: t("part").select("p_partkey", fidelity.plain_basicity(F.concat(F.lit("Basicity of "), F.col("p_size").cast("string"), F.lit(".5 °C was held; basicity at temp 3°C, basicity (around 1.6-1.9)°C and Ts 1200°C"))).alias("fixed")))
_MARKS = {"direction": (fidelity.direction_score, {"a": "increase", "b": "wide"}), "variables": (fidelity.variable_score, ["the", "zzz"]), "concepts": (fidelity.concept_score, ["that thing", "xyzzy", "to be"]), "caveats": (fidelity.caveat_score, ["x"])}
_ONE = "CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
register("qualitative_scores", f"""SELECT item_id, CAST(({_ONE.format(c=_sql_any('x', fidelity.DIRECTIONS['increase']))} + {_ONE.format(c=_sql_any('x', fidelity.DIRECTIONS['wide']))}) / 2 AS DOUBLE) AS direction, CAST({_ONE.format(c="regexp_matches(x, '(^|[^a-z0-9_])the($|[^a-z0-9_])')")} / 2 AS DOUBLE) AS variables,
round(CAST({_ONE.format(c=_sql_any('x', ('that', 'thing')))} + {_ONE.format(c="contains(x, 'xyzzy')")} AS DOUBLE) / 3, 6) AS concepts, CAST({_ONE.format(c=_sql_any('x', fidelity.CAVEATS))} AS DOUBLE) AS caveats FROM (SELECT item_id, lower(text) AS x FROM benchmark)""")(
    lambda t: t("benchmark").select("item_id", *(F.round(f(F.col("text"), w), 6).alias(k) for k, (f, w) in _MARKS.items())))
