"""BPE encoding through a minimal acyclic transducer of frequent words, and decoding.

1. Words are the parts of texts between which the tokenizer never merges (runs of
   letters, single digits, runs of other characters, in lower case).  All are counted
   over all documents: a batch's distinct words, summed up by Spark.
2. The most frequent, ``LEXICON`` at most, are compiled into a minimal acyclic
   automaton: those whose count lies in the highest sixteenths of powers of two that
   together hold no more.  States are merged by equal futures, so words share
   suffixes as well as prefixes; each arc carries how many words sort before those
   that go through it, the sum along a path numbers the word, and the number picks
   its ids.
3. The automaton's arrays are one file in the shared folder, which workers map
   into memory.  A batch's distinct words are looked up together.
4. Other words are merged exactly, by the library's own merges.

Decoding joins the tokens of the ids, as the library does for a tokenizer file
without a decoder.

Query ``op5_bpe_transducer``: every row of ``documents`` gives one row, in no
order.  Null and empty texts: no ids, the digest of nothing.  Repeated rows give
equal rows; words of equal counts are all in the lexicon or all outside it; an
empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, docs_of, filesystem, frugal, give_back, map_memory, read_table
from .words import BATCH_BYTES, HARD, KEPT_CHARS, WordCoder, batches, default_tokenizer, load_tokenizer, parts_of

LEXICON = 50_000
MAGIC = b"LDTRANS1"


# --- the automaton ------------------------------------------------------------


class Lexicon:
    """Minimal acyclic automaton over bytes with id outputs.

    ``keys`` holds state * 256 + byte of every arc in ascending order, ``targets``
    and ``before`` the arc's end and the number of words that sort before; state
    0 is the start.  Word k's ids are ``ids[starts[k]:starts[k + 1]]``.
    """

    FIELDS = (("keys", "<i8"), ("targets", "<i4"), ("before", "<i4"), ("final", "<u1"), ("starts", "<i8"), ("ids", "<u4"))

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, tuple[int, ...]]) -> Lexicon:
        order = sorted(w for w in words if w)
        registered: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []  # finished states: final, arcs
        counts: list[int] = []

        def finish(final: bool, arcs: list[tuple[int, int]]) -> int:
            signature = (final, tuple(arcs))
            if (state := registered.get(signature)) is None:
                state = registered[signature] = len(states)
                states.append(signature)
                counts.append(final + sum(counts[t] for _, t in arcs))
            return state

        # The path of the last word stays open; what the next word leaves is finished.
        open_arcs: list[list[tuple[int, int]]] = [[]]
        open_final, last = [False], b""

        def close(depth: int) -> None:
            while len(open_arcs) > depth + 1:
                state = finish(open_final.pop(), open_arcs.pop())
                open_arcs[-1].append((last[len(open_arcs) - 1], state))

        for word in order:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared)
            for _ in range(len(word) - shared):
                open_arcs.append([])
                open_final.append(False)
            open_final[-1] = True
            last = word
        close(0)
        root = finish(open_final[0], open_arcs[0])
        number = {s: (0 if s == root else s + 1 if s < root else s) for s in range(len(states))}
        arcs = []
        for state, (final, out) in enumerate(states):
            before = int(final)
            for label, target in out:
                arcs.append((number[state] * 256 + label, number[target], before))
                before += counts[target]
        arcs.sort()
        final = np.zeros(len(states), np.uint8)
        for state, (is_final, _) in enumerate(states):
            final[number[state]] = is_final
        outputs = [words[w] for w in order]
        return cls({
            "keys": np.array([a[0] for a in arcs], "<i8"), "targets": np.array([a[1] for a in arcs], "<i4"), "before": np.array([a[2] for a in arcs], "<i4"), "final": final,
            "starts": np.concatenate([[0], np.cumsum([len(o) for o in outputs], dtype=np.int64)]).astype("<i8"), "ids": np.array([i for o in outputs for i in o], "<u4"),
        })

    def to_bytes(self) -> bytes:
        blobs = [np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS]
        padded = [b + b"\0" * (-len(b) % 8) for b in blobs]
        return MAGIC + struct.pack(f"<{len(blobs)}Q", *map(len, blobs)) + b"".join(padded)

    @classmethod
    def from_buffer(cls, buffer) -> Lexicon:
        """Views into ``buffer``; nothing is copied."""
        view = memoryview(buffer)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        lengths = struct.unpack_from(f"<{len(cls.FIELDS)}Q", view, 8)
        at, arrays = 8 + 8 * len(lengths), {}
        for (name, kind), length in zip(cls.FIELDS, lengths):
            arrays[name] = np.frombuffer(view[at : at + length], kind)
            at += length + -length % 8
        return cls(arrays)

    def numbers(self, words) -> np.ndarray:
        """The number of each word of an Arrow string array, -1 for words that aren't
        in it: one step of all words per byte position."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        flat = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        at, lengths = offsets[:-1], np.diff(offsets)
        rows, state, total = np.flatnonzero(lengths), np.zeros(n, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(rows):
            key = state[rows] * 256 + flat[at[rows] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[arc] == key
            rows, arc = rows[good], arc[good]
            state[rows] = self.targets[arc]
            total[rows] += self.before[arc]
            step += 1
            ended = lengths[rows] == step
            done = rows[ended]
            done = done[self.final[state[done]] == 1]
            out[done] = total[done]
            rows = rows[~ended]
        return out


# --- coding ---------------------------------------------------------------------


class TransducerCoder(WordCoder):
    """Encodes: the lexicon first, exact merging behind it."""

    batch_bytes = BATCH_BYTES // 2  # a batch's tokens are held as well

    def __init__(self, folder: str, name: str, path: str) -> None:
        super().__init__(path)
        self.lexicon = Lexicon.from_buffer(map_memory(folder, name))

    def found(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lexicon = self.lexicon
        numbers = lexicon.numbers(words)
        starts, lengths = lexicon.starts[numbers], lexicon.starts[numbers + 1] - lexicon.starts[numbers]
        other = np.flatnonzero(numbers < 0)
        from_table, sizes, pool = self._tabled(words.take(other).to_pylist())
        starts[other], lengths[other] = from_table + len(lexicon.ids), sizes
        return starts, lengths, np.concatenate([lexicon.ids, pool])


class Decoder:
    """Texts of ids, and the decimal form of ids, by Arrow's kernels."""

    def __init__(self, tokenizer) -> None:
        import pyarrow as pa

        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = pa.array([tokenizer.id_to_token(k) or "" for k in range(size)], pa.large_string())
        self.decimal = pa.array([str(k) for k in range(size)], pa.large_string())

    def joined(self, kind, offsets: np.ndarray, ids: np.ndarray):
        """The entries of ``kind`` that each run of ids names, joined by spaces."""
        import pyarrow as pa
        import pyarrow.compute as pc

        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kind.take(pa.array(ids, pa.uint32())))
        return pc.binary_join(runs, pa.scalar(" ", pa.large_string()))


# --- the operator -------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in all texts.  Words of over ``KEPT_CHARS``
    characters and pieces beyond Latin-1 are no words of a lexicon."""

    @frugal
    def count(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        def counted(texts):
            words = parts_of(texts).values.value_counts()
            names = words.field("values")
            kept = pc.and_(pc.greater(pc.binary_length(names), 0), pc.less_equal(pc.utf8_length(names), KEPT_CHARS))
            return pa.RecordBatch.from_arrays([names, words.field("counts")], ["word", "n"]).filter(kept)

        for batch in rows:
            for _, texts in batches(batch.column("text")):
                if isinstance(texts, bytes):
                    texts = pa.array([texts], pa.binary()).cast(pa.string())
                hard = pc.match_substring_regex(texts, HARD)
                yield counted(texts.filter(pc.invert(hard)))
                if pc.any(hard).as_py():
                    pieces = pc.ascii_split_whitespace(texts.filter(hard)).flatten()
                    yield counted(pieces.filter(pc.invert(pc.match_substring_regex(pieces, HARD))))

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, work: Workspace, size: int = LEXICON) -> list[str]:
    """The most frequent words, ``size`` at most.  The driver gets one number for each
    sixteenth of a power of two, and the words."""
    level = F.floor(F.log2("n") * 16).cast("int")
    counts = work.table(word_counts(docs).withColumn("level", level), "words")
    least, held = None, 0
    for row in counts.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        if (held := held + row.words) > size:
            break
        least = row.level
    words = [] if least is None else [r.word for r in counts.where(F.col("level") >= least).select("word").collect()]
    work.drop("words")
    return words


def compile_lexicon(docs: DataFrame, work: Workspace, tokenizer: str, size: int = LEXICON) -> tuple[str, str]:
    """The folder and name of a new lexicon's file."""
    coder = WordCoder(tokenizer)
    words = frequent_words(docs, work, size) if coder.by_parts else []
    ids = {w.encode("utf-8"): tuple(np.frombuffer(p, "<u4").tolist()) for w, p in zip(words, coder.table.many(words, coder.merged))}
    folder = work.folder("lexicon")
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/lexicon") as out:
        out.write(Lexicon.build(ids).to_bytes())
    del coder, words, ids
    give_back()
    return folder, "lexicon"


def encode(docs: DataFrame, folder: str, name: str, tokenizer: str) -> DataFrame:
    """doc_id and the ids of each text (array<int>)."""

    @frugal
    def run(rows):
        import pyarrow as pa

        coder = TransducerCoder(folder, name, tokenizer)
        for batch in rows:
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for first, offsets, ids in coder.batches(batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(first, len(lists)), lists], ["doc_id", "ids"])

    return docs_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the decoded text of each row's ids."""

    @frugal
    def run(rows):
        import pyarrow as pa

        decoder = Decoder(load_tokenizer(tokenizer))
        for batch in rows:
            column = batch.column("ids")
            offsets = column.offsets.to_numpy().astype(np.int64)
            ids = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            texts = decoder.joined(decoder.tokens, offsets - offsets[0], ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts.cast(pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip of all texts.  Ids
    and decoded texts stay in the worker that makes them."""
    tokenizer = tokenizer or default_tokenizer()
    folder, name = compile_lexicon(docs, Workspace(spark, "bpe"), tokenizer)

    @frugal
    def run(rows):
        import pyarrow as pa

        coder = TransducerCoder(folder, name, tokenizer)
        decoder = Decoder(coder.tokenizer)
        sha = lambda texts: pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())
        for batch in rows:
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for first, offsets, ids in coder.batches(batch.column("text")):
                n = pa.array(np.diff(offsets), pa.int64())
                both = [sha(decoder.joined(kind, offsets, ids)) for kind in (decoder.decimal, decoder.tokens)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(first, len(n)), n, *both], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, read_table(spark, sf_dir, "documents"))
