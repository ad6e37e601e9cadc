"""The byte network and the centroids against scorers of plain loops and dictionaries."""

import math

import numpy as np
import pytest

from lodestone.llm import bytecnn, centroids


def plain_score(net, data):
    """Byte by byte, filter by filter."""
    n, width = len(data), bytecnn.WIDTH
    padded = list(data) + [0] * 3
    gram = [tuple(padded[i : i + 4]) for i in range(n)]
    symbols = [b + 256 * any(i >= lag and gram[i] == gram[i - lag] for lag in bytecnn.LAGS) for i, b in enumerate(data)] + [0] * width
    best = [0.0] * bytecnn.FILTERS
    for f in range(bytecnn.FILTERS):
        acts = [max(0.0, float(net.bias[f]) + sum(float(net.table[k, symbols[i + k], f]) for k in range(width))) for i in range(n)]
        blocks = [acts[i : i + bytecnn.BLOCK] for i in range(0, n, bytecnn.BLOCK)]
        chunks = [a + b for a, b in zip(blocks, blocks[1:])] or blocks
        best[f] = max((sum(c) / len(c) for c in chunks), default=0.0)
    return 1 / (1 + math.exp(-(sum(b * float(o) for b, o in zip(best, net.out)) * 4 + float(net.base))))


TEXTS = [b"", b"a", b"short text", b"word " * 120, bytes(range(32, 127)) * 9, "Größe überall, ça va? Ñandú. ".encode() * 25, b"abcabcabd" * 60 + b"zz" * 200]


@pytest.mark.parametrize("data", TEXTS)
def test_network_against_plain_convolution(data):
    rng = np.random.default_rng(1)
    net = bytecnn.ByteNet()
    net.out, net.bias, net.base = rng.normal(size=bytecnn.FILTERS).astype(np.float32), rng.normal(size=bytecnn.FILTERS).astype(np.float32) * 0.2, np.float32(0.3)
    assert net.score(np.frombuffer(data, np.uint8)) == pytest.approx(plain_score(net, data), abs=1e-5)


def plain_counts(data):
    b = [0, 0]
    for x in data:
        b.append(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 0)
    b = b[:2] + [x + 32 if 0x80 <= x <= 0x9E and before == 0xC3 else x for before, x in zip(b[1:], b[2:])]
    found = {}

    def add(place):
        found[place] = found.get(place, 0) + 1

    for i in range(2, len(b)):
        if b[i]:
            add(b[i])
        if two := b[i - 1] << 8 | b[i]:
            add(256 + ((two * 2654435761) % 2**32 >> 20))
        if three := b[i - 2] << 16 | b[i - 1] << 8 | b[i]:
            add(256 + centroids.BIGRAMS + ((three * 2246822519) % 2**32 >> 19))
    return found


@pytest.mark.parametrize("data", TEXTS)
def test_counts_against_a_dictionary(data):
    found = centroids.counts(np.frombuffer(data, np.uint8))
    assert {int(k): int(found[k]) for k in np.flatnonzero(found)} == plain_counts(data)


def test_prediction_against_dictionaries():
    words = {"aa": "thing that with sting and the ring", "bb": "größe und straße über müde für", "cc": "niño señor mañana según año"}
    rng = np.random.default_rng(5)
    texts = [(lang, " ".join(rng.choice(w.split(), 30)).encode()) for lang, w in words.items() for _ in range(8)]
    rows = np.stack([np.log1p(centroids.counts(np.frombuffer(t, np.uint8))).astype("f4") for _, t in texts])
    model = centroids.Centroids().fit([lang for lang, _ in texts], rows.copy())
    n, df = len(texts), {}
    for _, t in texts:
        for k in plain_counts(t):
            df[k] = df.get(k, 0) + 1
    idf = lambda k: math.log((1 + n) / (1 + df.get(k, 0))) + 0.1
    for lang, t in [*texts, ("aa", b"with the thing"), ("cc", "señor año niño".encode())]:
        v = {k: math.log1p(c) * idf(k) for k, c in plain_counts(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(row[k]) for k, x in v.items()) / norm for row in model.matrix]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        found, score, rejected = model.predict(t)
        assert found == lang == model.langs[best] and score == pytest.approx(cosines[best], abs=1e-4) and rejected == (cosines[best] < model.bounds[best])
