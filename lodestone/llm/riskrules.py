"""Quality rules whose cutoffs come with a guarantee (native).

For each document: words, symbols, repeated lines and repeated three-word windows
are counted over the whole text.  A rule rejects documents on one side of a cutoff
of one of these ratios (``RULES``).  For each stratum (language; null is one of its own) and
rule, every cutoff of a fixed grid is tested on the labelled documents that are
good: the null hypothesis is that it rejects more than ``ALPHA`` of the stratum's
good documents, and the p-value is the exact binomial probability of as few
rejections as were seen.  The strictest cutoff whose p-value is at most
``DELTA / (strata * rules * cutoffs)`` (Bonferroni) is used; a stratum with too
few labelled documents has none.  So with confidence 1 - ``DELTA`` no used rule
falsely rejects more than ``ALPHA`` of a stratum's good documents.

Everything is DataFrame operations; the repeats of a text are found within its
row by sorting, so no row per word exists and nothing is shuffled but one row of
counts per document and rule bin.

Query ``op1_risk_controlled_rules``: one row per row of ``documents``.  Null and
empty texts: zero counts, base_failed.  Labels without quality or doc_id don't
count; repeated labels of a document count once (its smaller quality), repeated
documents each.  Ties between cutoffs can't occur: the strictest passing one is
used.  Without labels no cutoff is used and kept is the negation of base_failed.
Very long texts are counted whole, within their row.  An empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, Workspace, blank_text, docs_of, let, read_table

ALPHA, DELTA = 0.02, 0.05
STEPS = 20
#: rule: (numerator, denominator, widest cutoff, rejects above). Bin b of STEPS is
#: the ratio in steps of the widest cutoff; a cutoff rejects bins from it on.
RULES = {
    "symbols": ("n_symbols", "n_words", 1.0),
    "dup_lines": ("n_dup_lines", "n_lines", 0.5),
    "repeats": ("n_repeat_words", "n_words", 0.5),
    "long_words": ("word_chars", "n_words", 20.0),
}
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50
_INDEX_BITS = 24


def _near(s: Column, x: Column, k: Column, same) -> Column:
    """Whether element k of the sorted array has an equal neighbour."""
    return ((k > 0) & same(F.get(s, k - 1), x)) | ((k < F.size(s) - 1) & same(F.get(s, k + 1), x))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more.

    Windows are sorted by 40 bits of a hash together with their place in one number;
    equal bits of neighbours name the few windows worth a look, which are then
    compared word by word, so the count is exact.  Texts too long for the place's
    bits are compared without the first step."""
    n = F.size(words)
    places = F.sequence(F.lit(0), n - 3)
    high = F.lit(-(1 << _INDEX_BITS)).cast("long")
    packed = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")))
    bits = lambda a, b: F.shiftright(a, _INDEX_BITS) == F.shiftright(b, _INDEX_BITS)
    near = let(F.sort_array(packed), lambda s: F.transform(F.filter(s, lambda x, k: _near(s, x, k, bits)), lambda x: x.bitwiseAND((1 << _INDEX_BITS) - 1).cast("int")))
    looked = F.when(n < (1 << _INDEX_BITS), near).otherwise(places)
    spelled = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    found = let(spelled(looked), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: _near(s, x, k, same)), lambda x: x["i"])))
    covered = let(found, lambda p: F.aggregate(F.transform(p, lambda i, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), i - F.get(p, k - 1)))), F.lit(0).cast("long"), lambda total, w: total + w))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(covered)


def features(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the counts of each text."""
    text = blank_text(F.col("text"))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    both = docs.select(*columns, words.alias("words"), lines.alias("lines"), (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    return both.select(
        *columns,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("words"), repeat_words).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


def _bin(rule: str) -> Column:
    """The highest cutoff at or under the ratio: rejected by cutoffs 1 to it."""
    top, under, widest = RULES[rule]
    ratio = F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(under)), F.lit(0.0))
    return F.least(F.lit(STEPS), F.floor(ratio * (STEPS / widest))).cast("int")


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, eight steps up, where it's exact to a double."""
    x = n + F.lit(9.0)
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    product = n + F.lit(1.0)
    for j in range(2, 9):
        product = product * (n + F.lit(float(j)))
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n trials of chance p: the chance of k, and those
    of fewer, which follow from it one by one.  What lies over 12 standard deviations
    below both k and the mean is under a double's last place, so the steps grow with
    the root of n."""
    from math import log

    n, k = n.cast("double"), k.cast("double")
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * log(p) + (n - k) * log(1 - p)
    steps = F.least(k, F.ceil(F.greatest(k - n * p, F.lit(0.0)) + 12 * F.sqrt(n * (p * (1 - p)))) + 64).cast("int")
    start = F.struct(F.lit(1.0).alias("factor"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        factor = acc["factor"] * (k - i) * ((1 - p) / p) / (n - k + i + 1)
        return F.struct(factor.alias("factor"), (acc["total"] + factor).alias("total"))

    below = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    return F.exp(top) * F.aggregate(below, start, step, lambda acc: acc["total"])


def cutoffs(labelled: DataFrame) -> DataFrame:
    """lang, rule, cut: the strictest cutoff whose false rejections are bounded.
    ``labelled``: lang and bins (a map of rule and bin) of good documents."""
    binned = labelled.select("lang", F.explode("bins").alias("rule", "bin")).groupBy("lang", "rule", "bin").agg(F.count("*").alias("k"))
    cells = binned.select("lang", "rule", "k", F.explode(F.expr(f"sequence(0, {STEPS})")).alias("cut"), "bin")
    seen = cells.groupBy("lang", "rule", "cut").agg(F.sum(F.when(F.col("bin") >= F.col("cut"), F.col("k")).otherwise(0)).alias("k"), F.sum("k").alias("n")).where("cut > 0")
    strata = seen.select(F.count_distinct(F.coalesce("lang", F.lit("")), F.col("lang").isNull()).alias("strata"))
    level = F.lit(DELTA) / (F.col("strata") * len(RULES) * STEPS)
    # A share of rejections at or over ALPHA can't pass; the sum is spared.
    tested = seen.where(F.col("k") < ALPHA * F.col("n")).crossJoin(F.broadcast(strata))
    passing = tested.where(binomial_tail(F.col("k"), F.col("n"), ALPHA) <= level)
    return passing.groupBy("lang", "rule").agg(F.min("cut").alias("cut"))


def judged(docs: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, lang, the counts, base_failed and kept of every row."""
    bins = F.create_map(*(x for rule in RULES for x in (F.lit(rule), _bin(rule))))
    counted = work.table(features(docs, "doc_id", "lang"), "features").withColumn("base_failed", base_failed()).withColumn("bins", bins)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = counted.join(marks.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    # One row for each stratum, a map of few rules; written, so that its size decides the join.
    used = work.table(cutoffs(good).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts")), "cutoffs")
    joined = counted.join(used.withColumnRenamed("lang", "stratum"), F.col("lang").eqNullSafe(F.col("stratum")), "left")
    broken = F.exists(F.map_entries("bins"), lambda e: F.coalesce(e["value"] >= F.element_at(F.col("cuts"), e["key"]), F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(broken, F.lit(False)))


def risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    found = judged(docs_of(documents, "doc_id", "text", "lang"), docs_of(labels, "doc_id", "quality"), Workspace(spark, "rules"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_CASES = " UNION ALL ".join(f"SELECT doc_id, lang, '{rule}' AS rule, CAST(least({STEPS}, floor(coalesce(CAST({top} AS DOUBLE) / nullif({under}, 0), 0.0) * {STEPS / widest})) AS INT) AS bin FROM f" for rule, (top, under, widest) in RULES.items())

SQL = rf"""
WITH d AS (SELECT doc_id AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS g FROM w, range(1, CAST(len(ws) - 1 AS BIGINT)) AS t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(3) AS o(j) GROUP BY r),
f AS (SELECT d.doc_id, d.lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, d.r FROM d JOIN w USING (r) LEFT JOIN covered c USING (r)),
b AS ({_CASES.replace("SELECT doc_id", "SELECT r, doc_id")}),
marks AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
seen AS (SELECT lang, rule, cut, sum(CASE WHEN bin >= cut THEN 1 ELSE 0 END) AS k, count(*) AS n FROM b SEMI JOIN marks USING (doc_id), range(1, {STEPS + 1}) AS c(cut) GROUP BY 1, 2, 3),
strata AS (SELECT count(DISTINCT coalesce(lang, '') || CASE WHEN lang IS NULL THEN '0' ELSE '1' END) AS s FROM seen),
tail AS (SELECT lang, rule, cut, sum(exp(lgamma(CAST(n AS DOUBLE) + 1) - lgamma(CAST(j AS DOUBLE) + 1) - lgamma(CAST(n - j AS DOUBLE) + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))) AS p
  FROM seen, LATERAL (SELECT unnest(range(0, CAST(k + 1 AS BIGINT))) AS j) WHERE k < {ALPHA} * n GROUP BY 1, 2, 3),
used AS (SELECT lang, rule, min(cut) AS cut FROM tail, strata WHERE p <= {DELTA} / (s * {len(RULES) * STEPS}) GROUP BY 1, 2),
broken AS (SELECT DISTINCT r FROM b JOIN used ON b.rule = used.rule AND b.lang IS NOT DISTINCT FROM used.lang WHERE bin >= cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words) AND broken.r IS NULL AS kept FROM f LEFT JOIN broken USING (r)
"""
