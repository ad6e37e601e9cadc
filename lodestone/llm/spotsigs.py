"""Document fingerprints from spot signatures (native).

A text is lower-cased and cut into runs of letters and digits.  Common words are anchors,
and so that no stretch of a text goes without, its beginning and every ``STRIDE``-th word
of a run without common words are anchors too.  An anchor's signature is the anchor and
the chain of the ``CHAIN`` content words (words that aren't common) that follow it,
whatever common words stand between.  An anchor with fewer content words after it has
none.  Ten hexadecimal digits of a signature's MD5
stand for it; the fingerprint is the sorted set of these, joined without a gap.  A text of
words that has no signature is one signature as a whole; a text without words has an empty
fingerprint.  Fingerprints depend on the text alone, not on the corpus.

Fingerprints are compared by Jaccard's measure, pruned: sets are parted by length, so
that sets of a likeness of ``floor`` or more are in one class or in neighbouring ones
(``length_class``), and only such sets are compared, if the shorter has at least a
``floor`` of the longer's signatures; what can't reach ``floor`` is 0.  Equal fingerprints
have 1, empty ones too.

The next document: keys of the rows, without texts, are dealt to value ranges of doc_id
and a row's predecessor is looked up within its range, or at the end of the range before;
the first follows the last.  Every document then sends its beginning and its fingerprint
to its predecessor.  Texts are shuffled once, by key, for both sides of that join.

Query ``op13_spot_signatures``: one row per row of ``documents``.  Null texts are empty.
Null doc_ids come last.  Documents of one doc_id follow each other by hashes of their
texts; rows of one doc_id and text (repeated rows) are one document here, and all have its
result.  A document alone in its table is its own next.  Texts of under four code
points are their own edited texts.  Very long texts are read whole.  An empty table
gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, blank_text, docs_of, let, read_table

CHAIN = 3
STRIDE = 6
DIGITS = 10
#: Likeness under this bound is 0.
FLOOR = 0.02
GAP = r"[^\p{L}\p{N}]+"
# Common words of English, German, Spanish and French.
COMMON = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "al con de del el en es la las lo los no para por que se su un una y "
    "au avec dans de des du elle en est et il la le les ou par pas pour qui que sur un une"
).split()
#: Rows of one document that an array stands for at once.
BLOCK = 1 << 16
KEY = ["z", "i", "k", "l"]


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures."""
    hashed = lambda s: F.substring(F.md5(s), 1, DIGITS)
    common = sorted(set(COMMON))

    def of(words: Column) -> Column:
        spots = F.filter(F.transform(words, lambda w, at: F.when(w.isin(common), at).otherwise(-1)), lambda at: at >= 0)
        bounds = F.concat(F.array(F.lit(-1)), spots, F.array(F.size(words)))

        # Before and at an anchor at place ``at``, with ``gap`` common words up to it, are at - gap + 1 content words.
        def signed(content: Column, at: Column, gap: Column) -> Column:
            chain = [F.get(content, at - gap + 1 + j) for j in range(CHAIN)]
            return F.when(at - gap + 1 + CHAIN <= F.size(content), hashed(F.concat_ws(" ", F.get(words, at), *chain)))

        def chains(content: Column, bounds: Column) -> Column:
            starts = F.slice(bounds, 1, F.size(bounds) - 1)
            per_gap = F.transform(starts, lambda b, gap: F.transform(F.sequence(b, F.get(bounds, gap + 1) - 1, F.lit(STRIDE)), lambda at: signed(content, at, gap)))
            return F.array_compact(F.flatten(per_gap))

        found = let(F.filter(words, lambda w: ~w.isin(common)), lambda content: let(bounds, lambda b: chains(content, b)))
        return let(found, lambda s: F.when((F.size(s) > 0) | (F.size(words) == 0), F.sort_array(F.array_distinct(s))).otherwise(F.array(hashed(F.array_join(words, " ")))))

    return let(F.filter(F.split(F.lower(text), GAP), lambda w: w != ""), of)


def fingerprint(found: Column) -> Column:
    return F.array_join(found, "")


def signatures_of(print_: Column) -> Column:
    """The set of signatures that a fingerprint stands for."""
    return F.regexp_extract_all(print_, F.lit(f"([0-9a-f]{{{DIGITS}}})"), 1)


def length_class(size: Column, floor: float = FLOOR) -> Column:
    """Sets of a likeness of ``floor`` or more are at most one class apart."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / -log(floor)))


def likeness(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """Jaccard's measure of two sets, worked out only where their lengths let it reach
    ``floor``; 0 elsewhere."""

    def compared(x: Column, y: Column) -> Column:
        m, n = F.size(x), F.size(y)
        near = (F.abs(length_class(m, floor) - length_class(n, floor)) <= 1) & (F.least(m, n) >= floor * F.greatest(m, n))
        shared = let(F.size(F.array_intersect(x, y)), lambda s: s / (m + n - s))
        return F.when(x == y, 1.0).when(near, F.when(shared >= floor, shared).otherwise(0.0)).otherwise(0.0)

    return let(a, lambda x: let(b, lambda y: compared(x, y)))


def keyed(docs: DataFrame) -> DataFrame:
    """z (whether doc_id is null), i, two hashes of the text, and the text."""
    text, i = blank_text(F.col("text")), F.col("doc_id").cast("long")
    return docs.select(i.isNull().alias("z"), F.coalesce(i, F.lit(0).cast("long")).alias("i"), F.xxhash64(text).alias("k"), F.xxhash64(text, F.lit(1)).alias("l"), text.alias("text"))


def predecessors(docs: DataFrame, work: Workspace) -> DataFrame:
    """The key of each document and its predecessor's: key, code points (n) and rows (m)."""
    keys = docs.select(*KEY, F.length("text").cast("long").alias("n")).groupBy(*KEY).agg(F.max("n").alias("n"), F.count("*").alias("m"))
    ranged = work.table(keys.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()), "ranges")
    each = F.struct(*KEY, "n", "m")
    # One row for each range: as many as there are partitions.
    ends = ranged.groupBy("range").agg(F.max(each).alias("end"))
    before = F.coalesce(F.lag("end").over(Window.orderBy("range")), F.max("end").over(Window.partitionBy()))
    ends = ends.select("range", before.alias("before"))
    within = F.lag(each).over(Window.partitionBy("range").orderBy(*KEY))
    found = ranged.withColumn("within", within).join(F.broadcast(ends), "range").withColumn("p", F.coalesce("within", "before"))
    return found.select(*KEY, *(F.col(f"p.{c}").alias(f"p_{c}") for c in [*KEY, "n", "m"]))


def edited(docs: DataFrame, work: Workspace) -> DataFrame:
    """One row per document, so many rows of the table have it (m): doc_id, text, the
    edited text (last quarter from the next document's beginning), and the next
    document's fingerprint."""
    docs = keyed(docs)
    links = work.table(predecessors(docs, work), "links")
    texts = docs.groupBy(*KEY).agg(F.first("text").alias("text"))
    quarter = lambda n: F.floor(n / 4).cast("int")
    # Sets go as bytes: half as long as digits, and not compressible.
    sent = texts.join(links, KEY).select(*(F.col(f"p_{c}").alias(c) for c in KEY), F.col("p_m").alias("m"), F.substring("text", F.lit(1), quarter(F.col("p_n"))).alias("head"), F.unhex(fingerprint(signatures(F.col("text")))).alias("next"))
    both = texts.join(sent, KEY)
    n = F.length("text")
    kept = F.substring("text", F.lit(1), n - quarter(n))
    return both.select(F.when(~F.col("z"), F.col("i")).alias("doc_id"), "m", "text", F.concat(kept, "head").alias("edited"), F.lower(F.hex("next")).alias("next"))


def compared(docs: DataFrame, work: Workspace) -> DataFrame:
    """What the query returns."""
    found = edited(docs, work).select("doc_id", "m", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(signatures(F.col("text"))).alias("fingerprint"), fingerprint(signatures(F.col("edited"))).alias("edited_fingerprint"), "next")
    near = lambda other: likeness(signatures_of(F.col("fingerprint")), signatures_of(F.col(other)))
    rows = found.select("m", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next").alias("near_next"))
    # Every row again, some at a time.
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {BLOCK}"))).alias("block"))
    again = blocks.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.col("m") - F.col("block") * BLOCK))))
    return again.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(docs_of(read_table(spark, sf_dir, "documents"), "doc_id", "text"), Workspace(spark, "spots"))


_COMMON = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))
_SIGNED = f"""(SELECT doc_id, CASE WHEN len(s) > 0 OR len(ws) = 0 THEN list_sort(list_distinct(s)) ELSE [substr(md5(array_to_string(ws, ' ')), 1, {DIGITS})] END AS s FROM
  (SELECT doc_id, ws, list_filter(flatten(list_transform(range(1, len(bounds)), lambda g: list_transform(range(bounds[g], bounds[g + 1], {STRIDE}), lambda p: CASE WHEN p - g + 1 + {CHAIN} <= len(content)
      THEN substr(md5(coalesce(ws[p] || ' ', '') || array_to_string(content[p - g + 2:p - g + 1 + {CHAIN}], ' ')), 1, {DIGITS}) END))), lambda x: x IS NOT NULL) AS s FROM
    (SELECT doc_id, ws, list_filter(ws, lambda w: NOT list_contains(common, w)) AS content, [0] || list_filter(list_transform(ws, lambda w, g: CASE WHEN list_contains(common, w) THEN g END), lambda x: x IS NOT NULL) || [len(ws) + 1] AS bounds FROM
      (SELECT doc_id, list_filter(string_split_regex(lower(t), '{GAP}'), lambda w: w <> '') AS ws, [{_COMMON}] AS common FROM (TEXTS)))))"""
_NEAR = f"CASE WHEN a.s = b.s THEN 1.0 WHEN least(len(a.s), len(b.s)) >= {FLOOR} * greatest(len(a.s), len(b.s)) AND c / (len(a.s) + len(b.s) - c) >= {FLOOR} THEN c / (len(a.s) + len(b.s) - c) ELSE 0.0 END"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT doc_id, next_id, n, substr(t, 1, n - n // 4) || substr(u, 1, n // 4) AS t FROM o),
x AS {_SIGNED.replace("TEXTS", "SELECT doc_id, t FROM d")},
y AS {_SIGNED.replace("TEXTS", "SELECT doc_id, t FROM e")},
z AS (SELECT e.doc_id, {_NEAR} AS near FROM e JOIN x a USING (doc_id) JOIN y b USING (doc_id), LATERAL (SELECT len(list_intersect(a.s, b.s))) AS l(c)),
v AS (SELECT e.doc_id, {_NEAR} AS near FROM e JOIN x a USING (doc_id) JOIN x b ON b.doc_id = e.next_id, LATERAL (SELECT len(list_intersect(a.s, b.s))) AS l(c))
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.t) AS edited_sha256, array_to_string(x.s, '') AS fingerprint, array_to_string(y.s, '') AS edited_fingerprint, CAST(z.near AS DOUBLE) AS near_edited, CAST(v.near AS DOUBLE) AS near_next
FROM e JOIN x USING (doc_id) JOIN y USING (doc_id) JOIN z USING (doc_id) JOIN v USING (doc_id)
"""
