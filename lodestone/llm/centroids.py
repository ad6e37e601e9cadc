"""Language identification by nearest centroids.

A text's vector counts its byte n-grams of one to three bytes, with Latin letters
in lower case and everything but letters taken as one gap; counts are dampened by
a logarithm, weighted by inverse document frequency, and normalised.  Each
language has ``CLUSTERS`` centroids, found by spherical k-means.  A text takes
the language of the centroid with the largest cosine, which is its score; it is
rejected if the cosine is under its language's bound, ``REJECT_SHARE`` of the
``REJECT_QUANTILE`` of that language's learning texts' cosines.

The model is fitted on a bounded sample (``PER_LANG`` documents of each language,
by a hash of the doc_id, never from the held-out quarter, each of them whole; one
task gets the dampened counts, which have a fixed size) and classifies every text,
whole and slice by slice.

Query ``op9_centroid_langid``: one row per row of ``documents``.  Null texts and
texts without a letter: ``und``, score 0.  Others get a learned language, with
``rejected`` beside it.  Ties go to the language that sorts first.  Without
learning texts everything is ``und``.  lang, source and doc_id are no inputs of a
prediction.  Repeated rows give equal rows, an empty table gives none.  Other columns,
whatever their names, are not read.

Stage ``keep_known``: rows go or stay by their text alone; other columns, whatever
their names, aren't read or changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytecnn import held_out
from .common import Workspace, docs_of, frugal, learned, read_table, text_bytes

BIGRAMS, TRIGRAMS = 1 << 12, 1 << 13
DIMS = 256 + BIGRAMS + TRIGRAMS
CLUSTERS = 3
PER_LANG = 300
REJECT_QUANTILE, REJECT_SHARE = 0.01, 0.2
SLICE = 1 << 20
UNKNOWN = "und"

_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    _FOLD[_b] = _b + 32 if 65 <= _b <= 90 else _b if 97 <= _b <= 122 or _b >= 128 else 0


def counts(data: np.ndarray) -> np.ndarray:
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(data), SLICE):
        part = data[max(0, at - 2) : at + SLICE]
        skip = at - max(0, at - 2)
        b = np.concatenate([np.zeros(2 - skip, np.uint8), _FOLD[part]])
        accented = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3)
        b[1:][accented] += 0x20
        b = b.astype(np.uint32)
        two, three = b[1:-1] << 8 | b[2:], b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        total[:256] += np.bincount(b[2:], minlength=256)
        total[256 : 256 + BIGRAMS] += np.bincount((two[two > 0] * np.uint32(2654435761)) >> np.uint32(20), minlength=BIGRAMS)
        total[256 + BIGRAMS :] += np.bincount((three[three > 0] * np.uint32(2246822519)) >> np.uint32(19), minlength=TRIGRAMS)
    total[0] = 0
    return total


def has_letter(data: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", data)) or any(c.isalpha() for c in data.decode("utf-8", "ignore"))


class Centroids:
    def __init__(self) -> None:
        self.langs: list[str] = []  # of each centroid
        self.idf = np.ones(DIMS, np.float32)
        self.matrix = np.zeros((0, DIMS), np.float32)
        self.bounds = np.zeros(0, np.float32)

    def vector(self, data: np.ndarray) -> np.ndarray:
        v = np.log1p(counts(data)).astype(np.float32) * self.idf
        norm = np.sqrt(v @ v)
        return v / norm if norm else v

    def fit(self, langs: list[str], rows: np.ndarray, clusters: int = CLUSTERS, seed: int = 3) -> Centroids:
        """``rows``: the dampened counts of each text, which become its vectors, some
        rows at a time, so that no second table of this size is held."""
        if not langs:
            return self
        blocks = [rows[at : at + 64] for at in range(0, len(rows), 64)]
        found_in = sum(np.count_nonzero(block, axis=0) for block in blocks)
        self.idf = np.log((1 + len(rows)) / (1 + found_in)).astype(np.float32) + np.float32(0.1)
        for block in blocks:
            block *= self.idf
            block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
        names = np.array(langs)
        rng, found, bounds = np.random.default_rng(seed), [], []
        for lang in sorted(set(names.tolist())):
            own = rows[names == lang]
            k = min(clusters, len(own))
            centres = own[rng.choice(len(own), k, replace=False)]
            for _ in range(12):
                nearest = (own @ centres.T).argmax(axis=1)
                sums = np.stack([own[nearest == j].sum(axis=0) if (nearest == j).any() else centres[j] for j in range(k)])
                centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
            bounds += [REJECT_SHARE * np.quantile((own @ centres.T).max(axis=1), REJECT_QUANTILE)] * k
            found.append(centres)
            self.langs += [lang] * k
        self.matrix, self.bounds = np.concatenate(found), np.array(bounds, np.float32)
        return self

    def predict(self, data: bytes) -> tuple[str, float, bool]:
        """language, cosine, rejected"""
        if not len(self.langs) or not has_letter(data):
            return UNKNOWN, 0.0, True
        cosines = self.matrix @ self.vector(np.frombuffer(data, np.uint8))
        best = int(cosines.argmax())
        return self.langs[best], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] < self.bounds[best])


def learning_texts(documents: DataFrame, work: Workspace, per_lang: int = PER_LANG) -> DataFrame:
    """lang, text of the sample: the first ``per_lang`` ids of a language by their hash.
    Only ids under a share of the hash's range are ranked, which by a language's count
    holds enough of them with a chance of all but 1e-8, so no task ranks a language.
    The chosen ids are written, so their size decides how the texts are joined."""
    rows = docs_of(documents, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    counts = work.table(rows.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    likely = rows.select("doc_id", "lang", draw.alias("draw")).join(counts, "lang").where(F.col("draw") * F.col("n") < per_lang + 6 * per_lang**0.5 + 20)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    ids = likely.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang)
    chosen = work.table(ids.select("doc_id", "lang").distinct(), "chosen")
    return rows.join(chosen, ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang", "text"]).select("lang", "text")


def train(documents: DataFrame, per_lang: int = PER_LANG) -> Centroids:
    work = Workspace(documents.sparkSession, "langid")

    @frugal
    def counted(rows):
        for batch in rows:
            kept = [(lang, np.log1p(counts(np.frombuffer(t, np.uint8))).astype("<f4")) for lang, t in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))) if has_letter(t)]
            places = [np.flatnonzero(v) for _, v in kept]
            yield pa.RecordBatch.from_pydict({"lang": [lang for lang, _ in kept], "places": [p.astype("<i4").tobytes() for p in places], "values": [v[p].tobytes() for (_, v), p in zip(kept, places)]}, schema=schema)

    schema = pa.schema([("lang", pa.string()), ("places", pa.binary()), ("values", pa.binary())])
    sample = learning_texts(documents, work, per_lang).mapInArrow(counted, "lang string, places binary, values binary")
    model = learned(sample, fitted)
    work.drop("langs", "chosen")
    return model


def fitted(sample: list[dict]) -> Centroids:
    sample.sort(key=lambda r: (r["lang"], r["places"], r["values"]))
    rows = np.zeros((len(sample), DIMS), np.float32)
    for row, one in zip(rows, sample):
        row[np.frombuffer(one["places"], "<i4")] = np.frombuffer(one["values"], "<f4")
    return Centroids().fit([one["lang"] for one in sample], rows)


def found_of(model: Centroids, text: Column) -> Column:
    """A struct of lang_pred, score and rejected."""

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    @frugal
    def classified(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs, scores, rejected = zip(*map(model.predict, text_bytes(column))) if len(column) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return classified(text)


def centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    found = docs_of(documents, "doc_id", "text").select("doc_id", found_of(train(documents), F.col("text")).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that aren't rejected."""
    model = train(read_table(spark, sf_dir, "documents"))
    return docs.where(~found_of(model, F.col("text"))["rejected"])
