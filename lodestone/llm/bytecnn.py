"""Quality classifier: a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes.  Each byte is one of 512 symbols: its value, and
whether the four bytes from it occurred 3 to 24 bytes earlier, which shows local
repetition.  ``FILTERS`` filters of ``WIDTH`` symbols slide over the whole
document; a filter's output is rectified and averaged over chunks of 512 bytes
that overlap by half; the largest chunk average of each filter (max pooling)
goes through a logistic layer to one probability.  Filters and layer are learned
together by Adam; the gradient flows through each filter's winning chunk.

The network is fitted on a bounded sample, ``SAMPLE`` labelled documents of each
class (by a hash of the doc_id, never from the held-out quarter), which come whole to
one task, and scores every document, whole and slice by slice.

Query ``op7_byte_cnn_quality``: one row per row of ``documents``.  Null and empty
texts get the score of an empty document; null doc_ids are never held out and
never in the sample; labels without quality are unlabelled, repeated labels of a
document count once (the smaller quality).  Without two classes in the labels,
every score is the share of label 1 (0.5 without labels).  Labels, lang, source
and doc_id are no inputs.  Repeated rows give equal rows.  An empty table gives no
rows.  Other columns, whatever their names, are not read.

Stage ``keep_good``: rows go or stay by their text alone; other columns, whatever
their names, aren't read or changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, frugal, learned, read_table, text_bytes

FILTERS, WIDTH = 16, 6
BLOCK = 256  # a chunk is two blocks; chunks start at each block
SAMPLE = 700
EPOCHS = 6
SLICE = 1 << 20
LAGS = range(3, 25)
GOOD_FROM = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def symbols(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The symbols of ``data``, given the bytes before it (24 at most count)."""
    before = before[-LAGS[-1] :]
    whole = np.concatenate([before, data, np.zeros(3, np.uint8)]).astype(np.uint32)
    grams = whole[:-3] | whole[1:-2] << 8 | whole[2:-1] << 16 | whole[3:] << 24
    seen = np.zeros(len(grams), bool)
    for lag in LAGS:
        seen[lag:] |= grams[lag:] == grams[:-lag]
    return data.astype(np.int64) + 256 * seen[len(before) :]


class ByteNet:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.table = (rng.normal(size=(WIDTH, 512, FILTERS)) * 0.1).astype(np.float32)
        self.bias = np.full(FILTERS, 0.1, np.float32)
        self.out = (rng.normal(size=FILTERS) * 0.3).astype(np.float32)
        self.base = np.float32(0)

    def activations(self, s: np.ndarray, n: int) -> np.ndarray:
        """Rectified filter outputs at the first n positions of s, which holds
        WIDTH - 1 symbols more."""
        acts = np.take(self.table[0], s[:n], axis=0)
        for k in range(1, WIDTH):
            acts += np.take(self.table[k], s[k : k + n], axis=0)
        acts += self.bias
        return np.maximum(acts, 0, out=acts)

    def pooled(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest chunk average of each filter over the whole text, and which
        chunk has it."""
        n = len(data)
        best, chunk = np.full(FILTERS, -1 if n else 0, np.float32), np.zeros(FILTERS, np.int64)
        last = None
        for at in range(0, n, SLICE):
            m = min(SLICE, n - at)
            acts = self.activations(self._symbols(data, at, m), m)
            starts = np.arange(0, m, BLOCK)
            sums = np.add.reduceat(acts, starts, axis=0)
            sizes = np.minimum(BLOCK, m - starts)
            first = at // BLOCK
            if last is not None:
                sums, sizes, first = np.concatenate([last[0], sums]), np.concatenate([last[1], sizes]), first - 1
            if len(sums) > 1:
                means = (sums[:-1] + sums[1:]) / (sizes[:-1] + sizes[1:])[:, None]
            else:  # a block that more follow is no chunk of its own
                means = sums / sizes[:, None] if m == n else np.full((1, FILTERS), -1, np.float32)
            top = means.argmax(axis=0)
            found = means[top, np.arange(FILTERS)]
            better = found > best
            best, chunk = np.where(better, found, best), np.where(better, first + top, chunk)
            last = (sums[-1:], sizes[-1:])
        return best, chunk

    @staticmethod
    def _symbols(data: np.ndarray, at: int, m: int) -> np.ndarray:
        """The symbols of m bytes from ``at`` and of the WIDTH - 1 that follow."""
        part = data[at : at + m + WIDTH - 1]
        return np.concatenate([symbols(part, data[max(0, at - 24) : at]), np.zeros(m + WIDTH - 1 - len(part), np.int64)])

    def score(self, data: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.pooled(data)[0] @ self.out * 4 + self.base))))

    def fit(self, texts: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = 7, batch: int = 16, rate: float = 0.02) -> ByteNet:
        rng = np.random.default_rng(seed)
        share = np.mean(labels)
        weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
        params = [self.table, self.bias, self.out, np.zeros(1, np.float32)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                grads = [np.zeros_like(p) for p in params]
                for k in order[at : at + batch]:
                    pooled, chunk = self.pooled(texts[k])
                    p = 1 / (1 + np.exp(-(pooled @ self.out * 4 + self.base)))
                    g = weight[labels[k]] * (p - labels[k]) / batch
                    grads[2] += 4 * g * pooled
                    grads[3] += g
                    if len(texts[k]):
                        self._back(g, chunk, texts[k], grads)
                step += 1
                now = rate * (0.5 ** (2 * epoch / epochs))
                for p, d, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                self.base = params[3][0]
        return self

    def _back(self, g: float, chunk: np.ndarray, data: np.ndarray, grads: list) -> None:
        for place in np.unique(chunk).tolist():
            low = place * BLOCK
            m = min(len(data) - low, 2 * BLOCK)
            s = self._symbols(data, low, m)
            acts = self.activations(s, m)
            for f in np.flatnonzero(chunk == place).tolist():
                on = np.flatnonzero(acts[:, f] > 0)
                d = 4 * g * self.out[f] / m
                grads[1][f] += d * len(on)
                for k in range(WIDTH):
                    grads[0][k, :, f] += np.float32(d) * np.bincount(s[on + k], minlength=512)


def training_sample(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, quality, text; the ids are chosen from the labels alone, at most
    ``2 * size`` of them, so only those rows' texts move."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    texts = docs_of(documents, "doc_id", "text").where("text <> ''")
    chosen = [marks.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for q in (0, 1)]
    return texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fitted(sample: list[dict]) -> ByteNet:
    sample.sort(key=lambda r: r["doc_id"])
    net, marks = ByteNet(), [r["quality"] for r in sample]
    if len(set(marks)) < 2:
        share = 0.5 if not marks else min(0.99, max(0.01, float(np.mean(marks))))
        net.out[:] = 0
        net.base = np.float32(np.log(share / (1 - share)))
        return net
    return net.fit([np.frombuffer(r["text"].encode("utf-8"), np.uint8) for r in sample], marks)


def train(documents: DataFrame, labels: DataFrame) -> ByteNet:
    return learned(training_sample(documents, labels), fitted)


def score_of(net: ByteNet, text: Column) -> Column:
    """The score of a text; the network, under 1 MB, goes with the tasks."""

    @F.arrow_udf("double")
    @frugal
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([net.score(np.frombuffer(t, np.uint8)) for t in text_bytes(column)], pa.float64())

    return scored(text)


def byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    net = train(documents, read_table(spark, sf_dir, "labels"))
    scored = docs_of(documents, "doc_id", "text").select("doc_id", score_of(net, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that score at least ``GOOD_FROM``."""
    net = train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return docs.where(score_of(net, F.col("text")) >= GOOD_FROM)
