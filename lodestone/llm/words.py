"""Word-wise encoding with a tokenizer of the tokenizers library.

The tokenizer of these operators drops white space and never merges across it,
normalises no character together with a neighbouring ASCII space, and has no
special token that holds one.  So the ids of a text are those of its parts, in
order: runs of letters, single digits, runs of other characters, and the endings
that the pre-tokenizer names.  ``knows`` checks these conditions on a tokenizer's
file; a tokenizer without them is run over whole texts.

Texts of Latin-1 characters, in which all versions of Unicode agree, are cut into
parts by Arrow's kernels, a batch of texts at once.  Only a batch's distinct parts
become Python strings, and only those that a bounded table doesn't hold go to the
library's merges.  Of other texts, the pieces between ASCII white space that are
Latin-1 take the same way, and the rest is encoded by the library as it stands.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Entries of a task's table of parts; past it, the table starts anew.
TABLE_ENTRIES = 100_000
#: Parts longer than this are encoded each time and not kept.
KEPT_CHARS = 64
#: Bytes of text that are encoded at once; a longer text is cut at white space.
BATCH_BYTES = 8 << 20

# The pre-tokenizer's pattern, and what it means for Latin-1 in lower case.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
NO_LETTERS = rf"('s|'t|'re|'ve|'m|'ll|'d|[{DIGITS}]|[^ \x09-\x0D{LETTERS}{DIGITS}]+)"
#: Beyond Latin-1, white space beyond ASCII, or the start of a special token.
HARD = r"[^\x{00}-\x{84}\x{86}-\x{9f}\x{a1}-\x{ff}]|<\|"

_GAP = re.compile(rb"[ \t-\r]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def knows(spec: dict) -> bool:
    """Whether a tokenizer's file is of the kind that the module describes."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    norm = (spec.get("normalizer") or {}).get("normalizers") or []
    if spec["model"]["type"] != "BPE" or [p["type"] for p in pre] != ["Split", "ByteLevel"] or [n["type"] for n in norm] != ["NFC", "Replace", "Lowercase"]:
        return False
    split, bytewise = pre
    return bool(
        split["invert"] and split["behavior"] == "Removed" and split["pattern"] == {"Regex": SPLIT} and not bytewise["add_prefix_space"] and not bytewise.get("use_regex", True)
        and norm[1]["pattern"] == {"Regex": "\\s+"} and norm[1]["content"] == " " and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")
        and all(t["content"].startswith("<|") and not set(t["content"]) & set(" \t\n\r\v\f") and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    )


def byte_symbols() -> dict[int, str]:
    """Byte-level symbols: printable Latin-1 stands for itself, other bytes for the
    characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Table:
    """A bounded table in two generations: when the young one is full it becomes the
    old one, and what is asked for again moves on."""

    def __init__(self, entries: int = TABLE_ENTRIES) -> None:
        self.entries, self.young, self.old = entries, {}, {}

    def many(self, keys: list[str], find) -> list[bytes]:
        out = list(map(self.young.get, keys))
        for k, value in enumerate(out):
            if value is None:
                key = keys[k]
                value = self.old.get(key)
                out[k] = value = find(key) if value is None else value
                if len(key) <= KEPT_CHARS:
                    self.young[key] = value
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        return out


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return pool[:0]
    kind = np.int32 if max(ends[-1], len(pool)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(ends[-1], dtype=kind)
    return pool[at]


class WordCoder:
    """Encodes Arrow columns of texts; one per task, so that nothing outlives it."""

    batch_bytes = BATCH_BYTES

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = load_tokenizer(path)
        self.by_parts = knows(spec)
        self.merges = self.tokenizer.model.tokenize
        self.symbols = byte_symbols()
        self.table = Table()  # it doesn't know the coder: no cycle keeps a coder alive

    def merged(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = part.encode("utf-8").decode("latin-1").translate(self.symbols)
        return np.array([token.id for token in self.merges(part)], "<u4").tobytes()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def found(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, lengths and a pool of ids that has the ids of each distinct part."""
        return self._tabled(words.to_pylist())

    def _tabled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        packed = self.table.many(words, self.merged) if words else []
        lengths = np.fromiter((len(p) >> 2 for p in packed), np.int64, len(packed))
        return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(packed), "<u4")

    def _plain(self, texts) -> tuple[np.ndarray, np.ndarray]:
        lists = parts_of(texts)
        words = lists.values.dictionary_encode()
        starts, lengths, pool = self.found(words.dictionary)
        at = words.indices.to_numpy(zero_copy_only=False)
        per_word = lengths[at]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        return ends[lists.offsets.to_numpy()], ragged(pool, starts[at], per_word)

    def _pieces(self, text: str) -> np.ndarray:
        """A text with hard characters, by its distinct pieces."""
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = re.split(r"[ \t-\r]+", text)
        distinct = pa.array(list(dict.fromkeys(pieces)), pa.string())
        hard = pc.match_substring_regex(distinct, HARD)
        plain = distinct.filter(pc.invert(hard))
        offsets, ids = self._plain(plain)
        of = {p: ids[a:b] for p, a, b in zip(plain.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())}
        of |= {p: self.whole(p) for p in distinct.filter(hard).to_pylist()}
        return np.concatenate([ids[:0], *(of[p] for p in pieces)])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin and end, and the ids of all texts.  ``texts``:
        an Arrow string array without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_parts:
            return _joined([self.whole(t) for t in texts.to_pylist()])
        hard = pc.match_substring_regex(texts, HARD)
        if not pc.any(hard).as_py():
            return self._plain(texts)
        offsets, ids = self._plain(texts.filter(pc.invert(hard)))
        plain = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        hard_ids = iter([self._pieces(t) for t in texts.filter(pc.fill_null(hard, pa.scalar(False))).to_pylist()])
        return _joined([next(hard_ids) if h else ids[slice(*next(plain))] for h in hard.to_pylist()])

    def batches(self, column):
        """The ids of each text of a column (null: empty), some texts at a time:
        (first row, offsets, ids)."""
        for first, texts in batches(column, self.batch_bytes):
            if isinstance(texts, bytes):  # one long text, slice by slice
                ids = np.concatenate([self.encode(s)[1] for s in cut(texts, self.batch_bytes)])
                yield first, np.array([0, len(ids)]), ids
            else:
                yield first, *self.encode(texts)


def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([np.empty(0, "<u4"), *found])


def parts_of(texts):
    """The parts of Latin-1 texts, an Arrow list of strings for each; empty strings
    stand at the ends of texts that begin or end with white space."""
    import pyarrow.compute as pc

    apart = pc.replace_substring_regex(pc.utf8_lower(texts), NO_LETTERS, r" \1 ")
    return pc.ascii_split_whitespace(apart)


def cut(text: bytes, limit: int):
    """A text cut at white space into slices of about ``limit`` bytes, each an array of
    one string; a longer run without any stays whole."""
    import pyarrow as pa

    at = 0
    while len(text) - at > limit and (gap := _GAP.search(text, at + limit)):
        yield pa.array([text[at : gap.start()]], pa.binary()).cast(pa.string())
        at = gap.start()
    yield pa.array([text[at:]], pa.binary()).cast(pa.string())


def batches(column, limit: int = BATCH_BYTES):
    """Slices of a column of texts (null: empty) of about ``limit`` bytes: the first
    row and an Arrow string array, or the bytes of one longer text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        if ends[at] - base > limit:
            yield at, column[at].as_buffer().to_pybytes()
        else:
            yield at, column.slice(at, to - at)
        at = to
