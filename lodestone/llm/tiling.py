"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case; in scripts without spaces
between words each character is one.  Every window of ``MIN_MATCH`` words of a
document and of the benchmark has a Karp-Rabin hash; a document joins the items that
share a window with it.  For such a pair, the longest match of unmarked words of both
is marked, again and again, until none of ``MIN_MATCH`` words is left (Wise's greedy
string tiling).  Tiles may stand in any order, so a passage with its sentences moved
about is still covered.  An item is leaked by a document if tiles cover at least
``COVERAGE`` of the item's words.  An item of fewer than ``MIN_MATCH`` words is leaked
by a document that holds it whole.

The length of the longest match is found by halving, from the sets of window hashes
of that length, and all matches of one length are marked in one sweep; so a pair
costs about its words times the number of different lengths, however many windows
are equal to each other.

The benchmark goes to the tasks in blocks of at most ``BLOCK_WORDS`` words, one
scan of the documents for each block, so what is broadcast has a fixed bound.

Query ``op10_string_tiling``: one row for each document row and item it leaks,
over the whole tables.  Null and empty texts leak nothing; items without words are
never leaked; repeated item rows count once, repeated documents each; a null doc_id
or item_id is kept as null.  Ties between matches go to the smaller start in the
item, then in the document.  Very long texts are tiled whole.  Empty tables give no
rows.  Other columns, whatever their names, are not read.

Stage ``keep_unseen``: rows go or stay by their text alone, with or without a doc_id;
other columns, whatever their names, aren't read or changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chosenpath import Words
from .common import Workspace, docs_of, frugal, read_table, text_bytes
from .words import ragged

MIN_MATCH = 4
COVERAGE = 0.5
BLOCK_WORDS = 1 << 20
BASE = 0x9E3779B97F4A7C15

_SPLIT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Whatever isn't ASCII or a letter of the Latin alphabet.
_OTHER = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
#: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: bytes, table: Words) -> np.ndarray:
    if not text.isascii():
        lowered = text.decode("utf-8").lower()
        if _OTHER.search(lowered):
            found = _WORD.findall(_UNSPACED.sub(r" \1 ", lowered))
            return np.fromiter((table[w.encode("utf-8")] for w in found), np.uint64, len(found))
        text = lowered.encode("utf-8")
    return np.fromiter(map(table.__getitem__, text.translate(_SPLIT).split()), np.uint64)


def windows(w: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash (polynomial, modulo 2**64) of each window of k words."""
    if len(w) < k:
        return np.empty(0, np.uint64)
    m = len(w) - k + 1
    h = w[:m].copy()
    for j in range(1, k):
        h = h * np.uint64(BASE) + w[j : j + m]
    return h


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Side:
    """A sequence's words, which of them are free, and hashes of windows of any length."""

    def __init__(self, w: np.ndarray, free: np.ndarray) -> None:
        n = len(w)
        powers, self.inverse = (_powers(base, n) for base in (BASE, pow(BASE, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * powers[:n], dtype=np.uint64)])
        self.w, self.free = w, free
        self.measure()

    def measure(self) -> None:
        """How many words from each on are free."""
        n = len(self.w)
        stops = np.where(self.free, n, np.arange(n))
        self.runs = np.minimum.accumulate(stops[::-1])[::-1] - np.arange(n)

    def windows(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the free windows of s words."""
        at = np.flatnonzero(self.runs >= s)
        return at, (self.sums[at + s] - self.sums[at]) * self.inverse[at]


def _marked(item: _Side, doc: _Side, s: int) -> list[tuple[int, int, int]]:
    """Marks the matches of s words, given that no longer one is left."""
    qs, item_hash = item.windows(s)
    ps, doc_hash = doc.windows(s)
    order = np.argsort(doc_hash, kind="stable")
    ps, doc_hash = ps[order], doc_hash[order]
    low, high = np.searchsorted(doc_hash, item_hash), np.searchsorted(doc_hash, item_hash, "right")
    out, end, next_of = [], 0, {}
    for q, a, b in zip(qs.tolist(), low.tolist(), high.tolist()):
        if q < end or a == b:
            continue
        at = next_of.get(a, a)
        while at < b and not (doc.free[ps[at]] and doc.free[ps[at] + s - 1]):
            at += 1
        next_of[a] = at  # what is marked stays marked
        for p in ps[at:b].tolist():
            if doc.free[p] and doc.free[p + s - 1] and np.array_equal(item.w[q : q + s], doc.w[p : p + s]):
                out.append((s, q, p))
                item.free[q : q + s] = False
                doc.free[p : p + s] = False
                end = q + s
                break
    item.measure()
    doc.measure()
    return out


def tiles(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in item, start in doc) of at least k words.  Longest
    first; ties go to the smaller start in the item, then in the document."""
    own, all_ = windows(item, k), windows(doc, k)
    free = np.zeros(len(doc) + k, bool)
    for at in range(k):  # only words under a window of the item matter
        free[at : at + len(all_)] |= np.isin(all_, own)
    a, b, out = _Side(item, np.ones(len(item), bool)), _Side(doc, free[: len(doc)]), []
    most = len(item)
    while True:
        low, high = k - 1, min([most, *(side.runs.max(initial=0) for side in (a, b))])
        while low < high:  # the longest length that both have a window of
            s = (low + high + 1) // 2
            if np.isin(a.windows(s)[1], b.windows(s)[1]).any():
                low = s
            else:
                high = s - 1
        if low < k:
            return out
        found = _marked(a, b, low)
        out += found
        # Nothing found: equal hashes of different words.
        most = low if found else low - 1


class Seeds:
    """A block of the benchmark: its items' words and the places of every window, by
    the length of windows."""

    def __init__(self, items: list[tuple[object, bytes]], k: int) -> None:
        table = Words()
        self.ids = [i for i, _ in items]
        self.words = [words_of(t, table) for _, t in items]
        self.by_length = {}
        for length in range(1, k + 1):
            some = [j for j, w in enumerate(self.words) if min(k, len(w)) == length]
            if some:
                hashes = [windows(self.words[j], length) for j in some]
                flat, sizes = np.concatenate(hashes), [len(h) for h in hashes]
                item = np.repeat(np.array(some), sizes)
                start = np.concatenate([np.arange(n) for n in sizes])
                order = np.argsort(flat, kind="stable")
                self.by_length[length] = flat[order], item[order], start[order]

    def leaked(self, text: bytes, table: Words, coverage: float) -> Iterator[tuple[object, int, int]]:
        """item, its words, covered words"""
        doc = words_of(text, table)
        for length, (seeds, item_of, start_of) in self.by_length.items():
            h = np.unique(windows(doc, length))
            low, high = np.searchsorted(seeds, h), np.searchsorted(seeds, h, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            at = ragged(np.arange(len(seeds)), low[hit], high[hit] - low[hit])
            items, starts = item_of[at], start_of[at]
            order = np.argsort(items, kind="stable")
            found, firsts, sizes = np.unique(items[order], return_index=True, return_counts=True)
            for j, first, size in zip(found.tolist(), firsts.tolist(), sizes.tolist()):
                item = self.words[j]
                if size * length < coverage * len(item):
                    continue
                # No tiling covers more than the words under shared windows.
                under = np.zeros(len(item), bool)
                under[(starts[order[first : first + size]][:, None] + np.arange(length)).ravel()] = True
                if under.sum() >= coverage * len(item):
                    covered = sum(t[0] for t in tiles(item, doc, length))
                    if covered and covered >= coverage * len(item):
                        yield self.ids[j], len(item), covered


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, bytes]]]:
    block, size = [], 0
    for row in docs_of(benchmark, "item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        text = row.text.encode("utf-8")
        n = text.count(b" ") + 1
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += n
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, item_words, covered_words of every leak."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_words int, covered_words int"
    found = None
    for block in blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(Seeds(block, min_match))

        @frugal
        def run(rows, shared=shared):
            seeds, table = shared.value, Words()
            for batch in rows:
                out = [(i, *leak) for i, t in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))) for leak in seeds.leaked(t, table, coverage)]
                columns = list(zip(*out)) if out else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "item_words", "covered_words"])

        part = docs_of(docs, "doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("coverage", F.round(F.col("covered_words") / F.col("item_words"), 6))


def clean(spark: SparkSession, block: list[tuple[object, bytes]], text: Column, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> Column:
    """Whether a text leaks no item of the block."""
    shared = spark.sparkContext.broadcast(Seeds(block, min_match))

    @F.arrow_udf("boolean")
    @frugal
    def unseen(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seeds, table = shared.value, Words()
        for column in columns:
            yield pa.array([next(seeds.leaked(t, table, coverage), None) is None for t in text_bytes(column)], pa.bool_())

    return unseen(text)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pipeline stage: the documents that leak no benchmark item.  Rows are dropped in
    the scan; what a block leaves is written before the next block's scan."""
    work = Workspace(spark, "tiling")
    for k, block in enumerate(blocks(read_table(spark, sf_dir, "benchmark"), block_words)):
        docs = (work.table(docs, f"left{k}") if k else docs).where(clean(spark, block, F.col("text")))
        if k > 1:
            work.drop(f"left{k - 1}")
    return docs
