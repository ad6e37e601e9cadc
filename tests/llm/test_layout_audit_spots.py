"""Fill-in-middle, filter interactions and spot signatures against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import audit, infilling, spotsigs
from lodestone.llm.common import Workspace

from .test_queries import run

WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def text_of(row):
    return row[1] or ""


# --- fill in middle -------------------------------------------------------------


def laid_out(doc_id, text, units):
    """By the list of all units' ends."""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[k : k + 8], 16) for k in range(0, 32, 8)]
    ends = [0, *(m.end() for m in re.finditer(units, text))]
    n = len(ends) - 1
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_op11_odd_rows(spark, odd):
    rows, folder = odd
    wanted = Counter()
    for r in rows:
        n, form, a, m, output = laid_out(r[0], text_of(r), "(?s:.)")
        wanted[r[0], n, form, a, m, sha(output), sha(text_of(r))] += 1
    assert Counter(tuple(r.values()) for r in run(spark, "op11", folder)) == wanted


@pytest.mark.parametrize("unit", [infilling.CODE_POINT, r"\S+\s*", r"[a-z]+", r"(?:ab|a|b)"])
def test_op11_units_and_forms(spark, unit):
    texts = ["ab" * 300, "one two  three\n\nfour", "x" * 129 + "é" * 63 + "😀" * 65, " lead and trail ", "<P> marked", "a<b<P", "aab" * 50, "", None, "<S", "no<M>"]
    rows = [(k, t) for k, t in enumerate(texts * 12)] + [(None, "null id")]
    found = infilling.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit)
    found = found.withColumn("back", infilling.restored(found.output, found.form)).collect()
    wanted = {k: laid_out(k, t or "", unit) for k, t in rows}
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found} == wanted
    assert all(r.back == (dict(rows)[r.doc_id] or "") for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.text("ab <\n", max_size=400), st.integers(0, 400), st.integers(0, 400), st.sampled_from([infilling.CODE_POINT, r"\S+\s*", "a+", "(?:ab|a)"]))
def test_op11_walk_ends_where_the_list_of_units_does(text, low, high, unit):
    ends = [0, *(m.end() for m in re.finditer(unit, text))]
    assert infilling.count_units(unit, text) == len(ends) - 1
    low, high = sorted((low % len(ends), high % len(ends)))
    assert infilling.ends_of(unit, text, low, high) == (ends[low], ends[high])


# --- filter interactions ----------------------------------------------------------


def interactions(rows, quality, toxic):
    """rows: doc_id, text, lang.  Every order is run filter by filter."""
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    docs = defaultdict(list)
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall(WORD, t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and first[t] < doc_id,
        }
        docs[lang or ""].append((frozenset(x for x in fails if fails[x]), quality.get(doc_id) == 1, toxic.get(doc_id) == 1))
    out, shapley = {}, Counter()
    for part, found in docs.items():
        for order in map("".join, permutations("ABCDE")):
            left = list(found)
            for step, x in enumerate(order, 1):
                removed = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                failing = [d for d in found if x in d[0]]
                out[part, order, step] = [len(left), len(removed), len(failing) - len(removed), sum(d[0] == {x} for d in found), sum(d[1] for d in removed), sum(d[2] for d in removed)]
                shapley[part, x] += len(removed)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_op12_odd_rows(spark, odd):
    rows, folder = odd
    found = run(spark, "op12", folder)
    assert {tuple(r.values()) for r in found} == interactions([(r[0], r[1], r[2]) for r in rows], {1: 0, 2: 0, 6: 1}, {1: 0, 2: 0, 9: 0})
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_op12_copies_and_repeated_rows(spark):
    long = " ".join(f"w{k}" for k in range(150))
    rows = [(None, long, "en")] * 70 + [(5, long, None)] * 130 + [(k, long, "en") for k in range(6, 40)] + [(k, "SHOUT #1 " * 60, "") for k in range(40, 50)] + [(5, "other", "en"), (90, " ", "de"), (91, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(5, 1, 1), (41, 1, 0), (41, 1, 0), (42, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = audit.audit(docs, labels, Workspace(spark, "audit")).collect()
    assert {tuple(r) for r in found} == interactions(rows, {5: 1, 41: 1}, {5: 1, 42: 1})


# --- spot signatures --------------------------------------------------------------


def signatures(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [w for w in words if w not in spotsigs.COMMON]
    found, done, since = set(), 0, 0
    # The beginning, then word by word: common ones, and every sixth of a run without.
    anchors = [("", 0)]
    for w in words:
        if w in spotsigs.COMMON:
            since = 0
            anchors.append((w, done))
        else:
            since += 1
            done += 1
            if since % spotsigs.STRIDE == 0:
                anchors.append((w, done))
    for w, at in anchors:
        if len(chain := content[at : at + spotsigs.CHAIN]) == spotsigs.CHAIN:
            found.add(hashlib.md5(" ".join([w, *chain] if w else chain).encode()).hexdigest()[: spotsigs.DIGITS])
    if not found and words:
        found = {hashlib.md5(" ".join(words).encode()).hexdigest()[: spotsigs.DIGITS]}
    return found


def likeness(a, b):
    if a == b:
        return 1.0
    j = len(a & b) / len(a | b)
    return j if j >= spotsigs.FLOOR and min(len(a), len(b)) >= spotsigs.FLOOR * max(len(a), len(b)) else 0.0


def test_signatures(spark):
    texts = ["", "...", "the of and", "one", "one two", "The quick brown fox jumps over the lazy dog and runs", " ".join(f"x{k}" for k in range(40)), "a b c d e f g h i the j k l", "der Hund und die Katze, die im Haus ist und nicht auf dem Dach"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, found in zip(texts, df.select(spotsigs.signatures(df.t).alias("s")).collect()):
        assert found.s == sorted(signatures(t)), t


def test_op13_odd_rows(spark, odd):
    rows, folder = odd
    # One document for each doc_id and text; those of one doc_id in an order of hashes.
    keys = {(r[0], text_of(r)) for r in rows}
    by_id = sorted(keys, key=lambda x: (x[0] is None, x[0] or 0))
    found = run(spark, "op13", folder)
    assert len(found) == len(rows)
    nexts = {a: b for a, b in zip(by_id, [*by_id[1:], by_id[0]])}
    got = defaultdict(set)
    for r in found:
        got[r["doc_id"], r["fingerprint"]].add(tuple(r.values()))
    for doc_id, text in by_id:
        after = nexts[doc_id, text][1]
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        s, e = signatures(text), signatures(edited)
        wanted = (doc_id, n, sha(edited), "".join(sorted(s)), "".join(sorted(e)), pytest.approx(likeness(s, e)), pytest.approx(likeness(s, signatures(after))))
        assert [x for x in got[doc_id, "".join(sorted(s))] if x[1] == n] == [wanted]


def test_op13_repeated_rows_and_ids(spark):
    rows = [(1, "aa bb cc dd the ee ff gg")] * 150 + [(2, "x")] + [(None, "hh ii jj kk")] * 3 + [(3, f"text {k} of the third one here") for k in range(5)]
    found = spotsigs.compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), Workspace(spark, "spots")).collect()
    assert Counter((r.doc_id, r.n_chars) for r in found) == Counter((k, len(t)) for k, t in rows)
    # The one after the last, whose id is null, is the first.
    (last,) = {(r.edited_sha256, r.near_next) for r in found if r.doc_id is None}
    assert last == (sha("hh ii jj " + "aa"), 0.0)


def test_a_document_alone_is_its_own_next(spark):
    (row,) = spotsigs.compared(spark.createDataFrame([(7, "aa bb cc dd ee")], "doc_id long, text string"), Workspace(spark, "spots")).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == sha("aa bb cc dd" + "aa ")


def test_likeness_is_pruned_by_length(spark):
    sets = [([], []), (["a"], []), (["a"], [f"{k}" for k in range(99)] + ["a"]), (["a", "b"], ["b", "c"]), (["a"], ["a"])]
    df = spark.createDataFrame(sets, "a array<string>, b array<string>")
    for floor in (0.02, 0.4):
        found = [r[0] for r in df.select(spotsigs.likeness(df.a, df.b, floor)).collect()]
        assert found == pytest.approx([1.0, 0.0, 0.0, 1 / 3 if floor < 1 / 3 else 0.0, 1.0])
