"""The registered queries against SQL and brute force, whole tables and odd rows."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lodestone.llm import registry, words

from .conftest import SMALL

N_ODD = 11


def run(spark, name, folder):
    found = next(f for k, f in registry.QUERIES.items() if k.startswith(name + "_"))
    return [r.asDict() for r in found(spark, folder).collect()]


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SMALL}/documents.parquet') ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def tokenizer():
    return words.load_tokenizer(words.default_tokenizer())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert registry.QUERIES[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name, folder", [(n, SMALL) for n in sorted(registry.SQL)] + [(n, SMALL.replace("0.01", "0.1")) for n in sorted(registry.SQL) if not n.startswith("op13")])
def test_sql(spark, name, folder):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = registry.QUERIES[name](spark, folder)
    found = c.sql(registry.SQL[name])
    assert found.columns == df.columns
    rows = df.collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, found.fetchall()))
    if name.startswith("op1_") and folder != SMALL:  # here cutoffs decide beyond the base rules
        assert sum(not r.kept and not r.base_failed for r in rows) > 100


def test_op3_rules_with_other_sentences_between(spark):
    from lodestone.llm import licenses

    texts = ["gpl-grant-3", "gpl-warranty", "gpl-received"], ["mit-grant", "mit-notice", "mit-liability", "mit-warranty"], ["bsd-grant", "cc0-short", "isc-short", "mpl-short", "bsd-source", "bsd-binary"], ["mit-warranty", "mit-notice", "mit-grant"]
    rows = [(k, "\n".join(licenses.SENTENCES[x][0] for x in names)) for k, names in enumerate(texts)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in found] == ["GPL-3.0-or-later", "MIT", "MPL-2.0;CC0-1.0;ISC", ""]


def features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_op1_counts(spark, odd):
    rows, folder = odd
    found = run(spark, "op1", folder)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found) == Counter((r[0], *features(r[1])) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in found)


def expected_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("odd_rows", [True, False])
def test_op2(spark, odd, documents, tokenizer, odd_rows):
    rows = [r[:2] for r in odd[0]] if odd_rows else documents
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = sorted(run(spark, "op2", odd[1] if odd_rows else SMALL), key=lambda r: r["start"])
    at = 0
    for (doc_id, text), row in zip(rows, found, strict=True):
        ids = [*expected_ids(tokenizer, text), 2]
        assert row == {"doc_id": doc_id, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))}
        at += len(ids)


@pytest.mark.parametrize("odd_rows", [True, False])
def test_op5(spark, odd, documents, tokenizer, odd_rows):
    rows = [r[:2] for r in odd[0]] if odd_rows else documents
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = Counter((i, len(ids := expected_ids(tokenizer, t)), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))) for i, t in rows)
    assert Counter(tuple(r.values()) for r in run(spark, "op5", odd[1] if odd_rows else SMALL)) == wanted


def test_op3_odd_rows(spark, odd):
    found = run(spark, "op3", odd[1])
    assert len(found) == N_ODD and Counter(r["license"] for r in found) == {None: 9, "CC-BY-4.0": 2}


def test_op3_wrapped_and_commented(spark):
    from lodestone.llm import licenses

    text = "\n".join("# " + s for part in ("mit-grant", "mit-notice", "mit-warranty") for s in re.findall(r".{1,60}(?:\s|$)", licenses.SENTENCES[part][0]))
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_sentences, row.licenses) == (3, "MIT")


@pytest.mark.parametrize("width", [1, 16, 30, 38, 1000])
def test_op3_wrapped_at_any_width(spark, width):
    from lodestone.llm import licenses

    wrapped = lambda s: "\n".join("// " + x for x in re.findall(r".{1,%d}(?:\s|$)|\S+\s?" % width, s))
    rows = [(k, wrapped(s)) for k, s in enumerate(x for texts in licenses.SENTENCES.values() for x in texts)]
    rows += [(1000, "\n".join(wrapped(licenses.SENTENCES[x][0]) for x in ("mit-grant", "mit-notice", "mit-warranty"))), (1001, rows[4][1] + " and more"), (1002, "\n".join(rows[4][1].split("\n")[:-1]) if width < 1000 else "")]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def brute(text):
        parts = [x for x in (licenses.normalised(y) for y in re.split(r"[.!?;:]+(?:[ \t\r\n]|\Z)|\n", text)) if x]
        hits = (next((licenses.KNOWN[j] for n in range(1, len(parts) - i + 1) if (j := " ".join(parts[i : i + n])) in licenses.KNOWN), None) for i in range(len(parts)))
        return ",".join(str(x) for x in hits if x)

    assert {k: r.sentence_ids for k, r in found.items()} == {k: brute(x) for k, x in rows}
    assert found[1000].licenses == "MIT" and all(found[k].n_sentences >= 1 for k in range(len(rows) - 3))


def shingle_sets(rows, n):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((doc_id, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    return out


def brute_components(rows, n, percent):
    sets, up, by_shingle = shingle_sets(rows, n), {}, defaultdict(list)

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for k, (doc_id, s) in enumerate(sets):
        both = Counter(j for x in s for j in by_shingle[x])
        for x in s:
            by_shingle[x].append(k)
        for j, b in both.items():
            if 100 * b >= percent * (len(s) + len(sets[j][1]) - b):
                a, c = find(doc_id), find(sets[j][0])
                up[max(a, c)] = min(a, c)
    return {doc_id: (len(s), find(doc_id)) for doc_id, s in sets}


def test_op4(spark, documents):
    wanted = brute_components(documents, 3, 85)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op4", SMALL)}
    assert found == wanted


def test_op4_large_groups_in_blocks(spark):
    """A group of near copies whose similarities straddle the bound, dealt to
    blocks of 8, and one exact copy of most of it."""
    import random

    from lodestone.llm.chosenpath import near_duplicates

    rng = random.Random(5)
    base = [f"v{k}" for k in range(150)]
    rows = [(k, " ".join(w if rng.random() > 0.02 else f"n{rng.randrange(10**6)}" for w in base)) for k in range(120)]
    rows += [(1000 + k, "the same text again and again of some words") for k in range(200)]
    found = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, small=4, block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 3, 85)


def test_op4_odd_rows(spark, odd):
    found = run(spark, "op4", odd[1])
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in found) == Counter([(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (None, 1, False), (5, 5, True), (6, 6, True), (7, 6, False), (8, 8, True), (9, 9, True), (10, 10, True)])


def test_op4_repeated_and_missing_ids(spark):
    from lodestone.llm.chosenpath import near_duplicates

    a, b, c = ("alpha beta gamma delta", "one two three four", "red green blue black")
    rows = [(1, a), (5, a), (5, b), (7, b), (8, None), (8, c), (9, c), (None, "x y z u"), (None, "x y z u"), (None, b)]
    found = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found) == Counter([(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (8, 8, True), (8, 8, True), (9, 8, False), (None, None, True), (None, None, True), (None, 1, False)])


def test_keyed_join_spreads_hot_keys(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    left = [(k % 7 if k > 20 else 3, k) for k in range(40)] + [(None, 99)]
    right = [(k, sum(x == k for x, _ in left), f"v{k}") for k in range(6)]
    found = common.keyed_join(spark.createDataFrame(left, "k long, x long"), spark.createDataFrame(right, "k long, n long, v string"), ["k"], "n", 41).collect()
    assert sorted((r.k, r.x, r.n, r.v) for r in found) == sorted((k, x, right[k][1], f"v{k}") for k, x in left if k is not None and k < 6)


def test_components(spark):
    from lodestone.llm.common import Workspace
    from lodestone.llm.components import connected_components

    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 150), (7, 7)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()
    assert {r.node: r.component for r in found} == {k: 0 for k in range(51)} | {100: 100, 150: 100, 200: 100}


def test_op6(spark, odd):
    found = Counter(tuple(r.values()) for r in run(spark, "op6", odd[1]))
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    a, empty = sha(b"a" * 1000), sha(b"")
    assert found == Counter([(1, 1000, a, "response", None), (1, 1000, a, "revisit", 1), (2, 1000, a, "revisit", 1), (2, 1000, a, "revisit", 1), (3, 0, empty, "response", None), (4, 0, empty, "revisit", 3), (None, 2, sha(b"zz"), "response", None), (5, 1800, sha("é\r\n\r\n".encode() * 300), "response", None)])


def test_op6_whole(spark):
    pages, first = duckdb.sql(f"SELECT page_id, html FROM read_parquet('{SMALL}/pages.parquet') ORDER BY 1").fetchall(), {}
    wanted = Counter()
    for page_id, html in pages:
        data = (html or "").encode()
        to = first.setdefault(data, page_id)
        wanted[(page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == page_id else "revisit", None if to == page_id else to)] += 1
    assert Counter(tuple(r.values()) for r in run(spark, "op6", SMALL)) == wanted


def test_op6_chunks(spark, odd, tables):
    """Oversized payloads come as many chunks, whose digests run on."""
    from lodestone.llm import warc
    from lodestone.llm.common import Workspace

    work = Workspace(spark, "t")
    folder = work.folder("a")
    files = work.table(warc.write_archives(spark.read.parquet(f"{odd[1]}/pages.parquet"), folder, work, chunk=64, file_bytes=500), "f")
    rows = warc.read_chunks(files, folder, chunk=100).where("page_id = 5").orderBy("chunk").collect()
    digest = hashlib.sha1()
    for row in rows:
        digest.update(row.data)
        assert row.sha1_so_far == base64.b32encode(digest.digest()).decode() and row.n_bytes <= 100
    assert len(rows) == 18


def test_op7(spark, documents):
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{SMALL}/labels.parquet')").fetchall())
    found = run(spark, "op7", SMALL)
    assert len(found) == len(documents) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = [(r["predicted"], quality[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in quality]
    assert sum(p == q for p, q in held) >= 0.93 * len(held)
    assert sum(p for p, q in held if q) >= 0.97 * sum(q for _, q in held)


def test_op7_odd_rows_and_slices(spark, odd, monkeypatch):
    import numpy as np

    from lodestone.llm import bytecnn

    found = run(spark, "op7", odd[1])
    assert len(found) == N_ODD and all(0 <= r["score"] <= 1 for r in found)
    net, data = bytecnn.ByteNet(), np.frombuffer(bytes(range(256)) * 20, np.uint8)
    whole = net.score(data)
    monkeypatch.setattr(bytecnn, "SLICE", 1024)
    assert abs(net.score(data) - whole) < 1e-5


def test_op9(spark, documents, odd):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM read_parquet('{SMALL}/documents.parquet')").fetchall())
    found = run(spark, "op9", SMALL)
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(documents) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in found) <= 0.01 * len(found)
    found = run(spark, "op9", odd[1])
    assert len(found) == N_ODD and Counter(r["doc_id"] for r in found if r["lang_pred"] == "und") == Counter([2, 3, 5, 10])


@pytest.mark.parametrize("odd_rows", [True, False])
def test_op8(spark, odd, documents, odd_rows):
    rows = [r[:2] for r in odd[0]] if odd_rows else documents
    found = run(spark, "op8", odd[1] if odd_rows else SMALL)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = defaultdict(list)
    for r in found:
        shards[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(shards.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    if not odd_rows:
        text, groups = dict(documents), defaultdict(set)
        for r in found:
            groups[text[r["doc_id"]]].add(r["shard"])
        many = [g for t, g in groups.items() if sum(x == t for _, x in documents) > 1]
        assert sum(len(g) > 1 for g in many) <= 0.05 * len(many)


def test_op10(spark, documents, odd):
    found = run(spark, "op10", SMALL)
    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{SMALL}/benchmark.parquet')").fetchall()
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    texts = {i: f" {plain(t)} " for i, t in documents}
    inside = {(i, k) for k, t in items for i, x in texts.items() if f" {plain(t)} " in x}
    assert inside and inside == {(r["doc_id"], r["item_id"]) for r in found if r["covered_words"] == r["item_words"]}
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op10", odd[1])} == {(6, 1), (7, 1), (1, None), (None, None)}


def test_tiles_against_the_plain_algorithm():
    import random

    import numpy as np

    from lodestone.llm.tiling import tiles

    rng = random.Random(2)
    for _ in range(60):
        item = np.array([rng.randrange(4) for _ in range(25)], np.uint64)
        doc = np.array([rng.randrange(4) for _ in range(60)], np.uint64)
        k = 3
        used_item, used_doc, wanted = set(), set(), []
        while True:
            best = None
            for q in range(len(item)):
                for p in range(len(doc)):
                    n = 0
                    while q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n] and q + n not in used_item and p + n not in used_doc:
                        n += 1
                    if n >= k and (best is None or (-n, q, p) < best):
                        best = (-n, q, p)
            if best is None:
                break
            n, q, p = -best[0], best[1], best[2]
            wanted.append((n, q, p))
            used_item |= set(range(q, q + n))
            used_doc |= set(range(p, p + n))
        assert tiles(item, doc, k) == wanted


def test_tiling_catches_reordered_passages(spark):
    from lodestone.llm.tiling import leaks

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "Eta theta, iota KAPPA lambda mu. filler words here. Alpha beta gamma delta epsilon zeta!"
    docs = spark.createDataFrame([(1, moved), (2, "alpha beta gamma and nothing else of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, "one two three four five")], "item_id long, text string")
    assert [tuple(r) for r in leaks(docs, bench, block_words=3).collect()] == [(1, 5, 12, 12)]
    assert [tuple(r) for r in leaks(docs, bench, coverage=0.2).collect()] == [(1, 5, 12, 12)]


def test_tiling_is_quick_on_repeated_words():
    import time

    import numpy as np

    from lodestone.llm.tiling import Seeds, tiles
    from lodestone.llm.chosenpath import Words

    same = np.full(20_000, 7, np.uint64)
    began = time.process_time()
    assert tiles(same, np.full(25_000, 7, np.uint64), 4) == [(20_000, 0, 0)]
    assert list(Seeds([(1, b"word " * 20_000)], 4).leaked(b"Word, " * 20_000, Words(), 0.5)) == [(1, 20_000, 20_000)]
    assert time.process_time() - began < 1


def test_tiling_of_short_items_and_other_scripts(spark):
    from lodestone.llm.tiling import leaks

    docs = [(1, "so zz it is"), (2, "zzz"), (3, "前に 東京都は日本の首都です。と"), (4, "une\u00a0phrase — déjà\u2019vu, ici"), (5, "blue the sky")]
    items = [(1, "ZZ!"), (2, "東京都は日本の首都です"), (3, "phrase déjà vu ici"), (4, "sky the blue"), (5, "..."), (6, "the sky")]
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (3, 2), (4, 3), (5, 6)]


@pytest.mark.parametrize("planes", [4, 32])
def test_plane_files(planes):
    import io

    import numpy as np

    from lodestone.llm.planes import PlaneReader, PlaneWriter

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    kept = io.BytesIO()
    kept.close = lambda: None
    writer, rng, docs = PlaneWriter(kept, planes, block_ids=64), np.random.default_rng(1), []
    for doc_id in (5, None, 7, 8):
        ids = rng.integers(0, 2**32 if doc_id == 7 else 50_000, size=0 if doc_id is None else 1000, dtype=np.uint32)
        docs.append((doc_id, ids.tolist()))
        writer.add(doc_id, ids.astype("<u4").tobytes())
    writer.close()
    reader = PlaneReader(File(kept.getvalue()))
    assert [(i, [x for run in runs for x in run.tolist()]) for i, runs in reader.documents()] == docs
    flat = [x for _, d in docs for x in d]
    assert reader.read_block(3).tolist() == flat[192:256]


def test_lexicon():
    import pyarrow as pa

    from lodestone.llm.transducer import Lexicon

    lexicon = {b"walking": (1, 9), b"talking": (2, 9), b"walked": (1, 8), b"talked": (2, 8), b"a": (), b"\xc3\xa9t\xc3\xa9": (7,)}
    built = Lexicon.from_buffer(Lexicon.build(lexicon).to_bytes())
    asked = pa.array([*lexicon, b"walk", b"", b"b", b"walkings"]).cast(pa.string()).slice(1)
    numbers = built.numbers(asked).tolist()
    ids = [None if k < 0 else tuple(built.ids[built.starts[k] : built.starts[k + 1]].tolist()) for k in numbers]
    assert ids == [*list(lexicon.values())[1:], *[None] * 4]
    # Shared suffixes: fewer states than a trie has.
    assert len(built.final) < len({w[:k] for w in lexicon for k in range(len(w) + 1)})


def test_binomial_tail(spark):
    from fractions import Fraction
    from math import comb

    from pyspark.sql import functions as F

    from lodestone.llm.riskrules import binomial_tail

    cases = [(0, 10), (1, 10), (3, 200), (10, 10), (0, 0), (20, 1000), (170, 10_000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        assert abs(r.p - float(Fraction(sum(comb(r.n, j) * 49 ** (r.n - j) for j in range(r.k + 1)), 50**r.n))) < 1e-9


def test_risk_rules_use_cutoffs_that_hold(spark):
    """Enough labels: the symbol rule gets a cutoff, bad documents go, and no more
    than the allowed share of good ones."""
    from lodestone.llm.common import Workspace
    from lodestone.llm.riskrules import judged

    body = " ".join(f"word{k}" for k in range(60))
    rows = [(k, body + f" tail{k}", None) for k in range(1500)] + [(5000 + k, " ".join(f"w{j}***" for j in range(60)), None) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(1500)], "doc_id long, quality int")
    kept = {r.doc_id for r in judged(docs, labels, Workspace(spark, "t")).where("kept").collect()}
    assert kept == set(range(1500))


def test_op3_expressions_subjects_and_covered_names(spark):
    from lodestone.llm import licenses

    said = lambda *names: "\n".join(licenses.SENTENCES[x][0] for x in names)
    texts = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT;Apache-2.0", "// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND ISC": "GPL-2.0-or-later;ISC",
        "This file is released under the MIT License.": "MIT", "This software is licensed under the ISC License.": "ISC", said("bsd-grant", "bsd-source", "bsd-binary"): "BSD-2-Clause",
        said("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"): "BSD-3-Clause", said("mpl-copy"): "MPL-2.0", said("apache-copy", "apache-unless", "apache-see"): "Apache-2.0", said("gpl-warranty", "gpl-received"): "GPL",
        said("gpl-grant-2", "gpl-warranty", "gpl-received"): "GPL-2.0-or-later", said("isc-warranty"): "ISC", "SPDX-License-Identifier: Unknown OR Other": "", "MIT or Apache-2.0": "",
    }
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in found] == list(texts.values())
    assert not set(licenses.SENTENCES) - {x for _, run in licenses.RULES for x in run}
