"""How filters of a corpus interact, by a relational word pipeline.

Five filters fail documents by whole texts (null: empty); words are maximal runs of
characters other than space and \\t to \\r:

A  under 100 words            B  distinct words under 80 % of all words
C  over 10 % of A to Z        D  a character of ``#$%&*|``
E  a smaller doc_id, anywhere in the table, has the same text

1. Texts are dealt by (doc_id, text) and exploded into words, which are counted by
   (document, word) and then by document: totals and distinct words.  Both counts keep the
   first dealing, so words are never shuffled.
2. These totals are joined, as an outer join, with each row's other flags; texts that
   occur more than once bring their smallest doc_id.
3. A document's five flags are one of 32 masks.  One aggregate per part has 32
   conditional counts, for all, good (quality 1) and toxic (toxic 1) documents each.
4. All 120 orders of the filters are read off the 32 counts.

Hot groups: rows with equal doc_id and text are one key in step 1, dealt out by a salt,
and count as often as they occur; joins on keys that many rows have are ``keyed_join``.
Rows are summed up by (doc_id, part, mask) before labels are joined.

Query ``op12_filter_interactions``: one row per part, order and step.  Null and blank
texts have no words: they fail A, not B.  Null doc_ids are neither smaller nor larger
than others: such rows never fail E and make none fail it.  Rows with the same doc_id and
text (repeated rows): none is smaller, so they don't fail E for each other.  Repeated
labels of a document: the smaller quality, the larger toxic; labels without doc_id
don't count.  Very long texts are exploded whole.  An empty table gives no rows.  Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, Workspace, blank_text, docs_of, keyed_join, read_table

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = "[#$%&*|]"
#: Rows of one key are dealt to 2 ** SALT_BITS places.
SALT_BITS = 6
KINDS = ("every", "good", "toxic")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of (doc_id, text): i and k.  i is the doc_id, for null a hash
    of the text; k has ``62 - SALT_BITS`` bits or more of another hash of both."""
    text, none = blank_text(F.col("text")), F.col("doc_id").isNull()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", text.alias("text"))
    return docs.withColumns({"i": F.coalesce("doc_id", F.xxhash64("text", F.lit(1))), "k": F.shiftrightunsigned(F.xxhash64("text", none), SALT_BITS)})


def word_totals(docs: DataFrame) -> DataFrame:
    """i, k, n, d: words of all rows with a key, which have the same ones, and distinct
    words."""
    salted = F.shiftleft("k", SALT_BITS).bitwiseOR(F.monotonically_increasing_id() % (1 << SALT_BITS))
    dealt = docs.select("i", salted.alias("s"), "text").repartition("i", "s")
    # Splitting leaves empty strings at a text's ends.
    words = dealt.select("i", "s", F.explode(F.split("text", WORD_GAP)).alias("word")).where("word <> ''")
    by_word = words.groupBy("i", "s", "word").agg(F.count("*").alias("c"))
    by_doc = by_word.groupBy("i", "s").agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    return by_doc.select("i", F.shiftrightunsigned("s", SALT_BITS).alias("k"), "n", "d")


def flagged(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, part and mask of every row of ``docs`` (doc_id, text, lang)."""
    docs = keyed(docs)
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length("text")
    flags = docs.select("i", "k", "doc_id", blank_text(F.col("lang")).alias("part"), capitals.alias("capitals"), F.col("text").rlike(SYMBOLS).alias("symbols"), F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("t"))
    flags = work.table(flags, "flags")
    rows = flags.count()
    # How many rows have a key divides the words of all of them.
    none = F.lit(0).cast("long")
    both = word_totals(docs).withColumn("m", none).unionByName(flags.select("i", "k", none.alias("n"), none.alias("d"), F.lit(1).cast("long").alias("m")))
    totals = both.groupBy("i", "k").agg(F.sum("n").alias("n"), F.max("d").alias("d"), F.sum("m").alias("m")).withColumn("n", F.expr("n div m"))
    totals = work.table(totals, "totals")
    full = keyed_join(flags, totals, ["i", "k"], "m", rows, outer=True)
    copies = work.table(flags.groupBy("digest", "t").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    full = keyed_join(full.select("doc_id", "part", "capitals", "symbols", "n", "d", "digest", "t"), copies, ["digest", "t"], "copies", rows, outer=True)
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))
    fails = {"A": n < LEAST_WORDS, "B": 100 * d < DISTINCT_PERCENT * n, "C": F.col("capitals"), "D": F.col("symbols"), "E": F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))}
    mask = sum((F.when(fails[x], 1 << at).otherwise(0) for at, x in enumerate(LETTERS)), F.lit(0))
    return full.select("doc_id", "part", mask.alias("mask"))


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and for every kind an array of the counts of the 32 masks."""
    summed = flags.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("c"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    joined = summed.join(marks, "doc_id", "left")
    kinds = F.array(F.lit("every"), F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic")))
    by_kind = joined.select("part", "mask", "c", F.explode(F.array_compact(kinds)).alias("kind"))
    counts = by_kind.groupBy("part", "kind").agg(*(F.sum(F.when(F.col("mask") == m, F.col("c")).otherwise(0)).alias(f"c{m}") for m in range(MASKS)))
    arrays = counts.select("part", "kind", F.array(*(f"c{m}" for m in range(MASKS))).alias("counts"))
    none = F.array(*(F.lit(0).cast("long") for _ in range(MASKS)))
    return arrays.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("counts"))), none).alias(kind) for kind in KINDS))


def _total(counts: str, chosen) -> Column:
    """The sum of the counts of the masks that ``chosen`` names."""
    return F.aggregate(F.transform(F.col(counts), lambda c, m: F.when(chosen(m), c).otherwise(0)), F.lit(0).cast("long"), lambda a, c: a + c)


def interactions(counts: DataFrame) -> DataFrame:
    """What every filter does at every step of every order, by part."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.array(*(F.lit(s) for s in range(1, 6)))).alias("step"))
    letter, earlier = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits = {x: 1 << at for at, x in enumerate(LETTERS)}
    own = sum((F.when(letter == x, bit).otherwise(0) for x, bit in bits.items()), F.lit(0))
    prior = sum((F.when(F.contains(earlier, F.lit(x)), bit).otherwise(0) for x, bit in bits.items()), F.lit(0))
    steps = steps.withColumns({"own": own, "prior": prior})
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("prior")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # Of a mask's s filters, each is the first to remove it in 120 / s of the orders.
    share = F.transform(F.col("every"), lambda c, m: F.when(fails(m), (c * len(list(permutations(LETTERS))) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return steps.select(
        "part", "filter_order", "step",
        _total("every", lambda m: m.bitwiseAND(F.col("own").bitwiseOR(F.col("prior"))) == 0).alias("kept"),
        _total("every", removed).alias("removed"),
        _total("every", lambda m: fails(m) & gone(m)).alias("redundant"),
        _total("every", lambda m: m == F.col("own")).alias("unique_fails"),
        _total("good", removed).alias("good_lost"),
        _total("toxic", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, c: a + c).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    counts = work.table(mask_counts(flagged(docs, work), labels), "counts")
    work.drop("flags", "totals", "copies")
    return interactions(counts)


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return audit(docs_of(documents, "doc_id", "text", "lang"), docs_of(labels, "doc_id", "quality", "toxic"), Workspace(spark, "audit"))


SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
m AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, [len(ws) < {LEAST_WORDS}, 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(t), regexp_matches(t, '{SYMBOLS}'),
    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN m USING (doc_id)),
g AS (SELECT part, fails, count(*) AS c, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS v(x, place)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.place, b.place, c.place, d.place, e.place] AS places FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.place, b.place, c.place, d.place, e.place])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, places[step] AS own, places[1:step - 1] AS prior FROM o, range(1, 6) AS r(step)),
j AS (SELECT part, filter_order, step, own, c, good, toxic, fails[own] AS fail, len(list_filter(prior, lambda p: fails[p])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n FROM s, g),
a AS (SELECT part, filter_order, step, own, CAST(sum(c) FILTER (NOT fail AND NOT gone) AS BIGINT) AS kept, CAST(sum(c) FILTER (fail AND NOT gone) AS BIGINT) AS removed, CAST(sum(c) FILTER (fail AND gone) AS BIGINT) AS redundant,
    CAST(sum(c) FILTER (fail AND n = 1) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (fail AND NOT gone) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (fail AND NOT gone) AS BIGINT) AS toxic_lost FROM j GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""
