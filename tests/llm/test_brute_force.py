"""Naive versions of operators that SQL can't express: fingerprints, the additive model and its features, chances of domains."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scrivane.llm import fingerprints, mixing, quality_model, textkernel
from scrivane.llm.textkernel import texts_of

from . import odd

TOP = (1 << 64) - 1


def mix(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & TOP
    return x ^ x >> 32


def word_at(raw, i):
    return int.from_bytes(raw[i : i + 8], "little")


# Fingerprints


def naive_anchors(raw, k=24, s=8):
    """(hash, position) of every closed syncmer, from its definition; of a text without any, the whole text."""
    small = [mix(word_at(raw, i) ^ 0x243F6A8885A308D3) >> 1 for i in range(len(raw) - s + 1)]
    out = []
    for i in range(len(raw) - k + 1):
        inner = small[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            h = 0
            for j in range(0, k, 8):
                h = mix(h * 0x9FB21C651E98DF25 & TOP ^ word_at(raw, i + j))
            out.append((h, i))
    if raw and not out:
        table, base = textkernel._TABLES[3].tolist(), textkernel._MULT[3]
        out = [(mix((sum(table[b] * pow(base, i, 1 << 64) for i, b in enumerate(raw)) + len(raw)) & TOP), 0)]
    return out


def naive_sketch(raw, size=96):
    first = {}
    found = naive_anchors(raw)
    for h, at in found:
        first[h] = min(at, first.get(h, at))
    return len(raw), len(found), sorted(first.items())[:size]


def naive_text(sketch):
    n, total, kept = sketch
    return b"".join([n.to_bytes(8, "little"), total.to_bytes(8, "little"), *(h.to_bytes(8, "little") for h, _ in kept), *(p.to_bytes(4, "little") for _, p in kept)]).hex()


def naive_likeness(a, b, size=96):
    x, y = dict(a[2]), dict(b[2])
    if not x and not y:
        return 1.0
    union = sorted({*x, *y})
    if len(x) == size or len(y) == size:
        union = union[:size]
    pairs = sorted((x[h], y[h]) for h in union if h in x and h in y)
    good = 0
    for i, (p, q) in enumerate(pairs):
        near = len(pairs) <= 4 or any(p - q == r - s for j, (r, s) in enumerate(pairs) if j != i)
        for j in (i - 2, i - 1, i + 1, i + 2):
            if 0 <= j < len(pairs) and not near:
                (p1, q1), (p2, q2) = sorted([pairs[i], pairs[j]])
                near = q2 > q1 and abs((p2 - q2) - (p1 - q1)) <= 8 + 0.125 * (p2 - p1)
        good += near
    j = good / max(len(union), 1)
    return 2 * j / (1 + j)


def edited(t, following):
    half = len(t) // 2
    return t[: len(t) - half] + following[:half]


def test_fingerprint_pairs_equal_a_naive_version(spark):
    """All columns, over ranges of a few documents, with ids that repeat (ties: by text, descending), nulls and short texts."""
    r = random.Random(2)
    base = odd.words(40, 60)
    rows = [(k, odd.words(4000 + k, r.choice([1, 4, 8, 40, 150]))) for k in range(40)]
    rows += [(100 + k, base[: 10 * k] + odd.words(50 + k, 3) + base[10 * k + 5 :]) for k in range(12)]
    rows += [(7, "same id"), (7, None), (7, odd.words(9, 30)), (7, odd.words(9, 30)), (None, base), (None, None), (None, "z" * 70), (300, ""), (301, None), (302, "a b " * 100)]
    out = fingerprints.fingerprint_pairs(odd.frame(spark, rows), block_bytes=1_500).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        a, b, c = (naive_sketch(x.encode()) for x in (t, edited(t, following), following))
        want.append((i, len(t), naive_text(a), naive_text(b), naive_likeness(a, b), naive_likeness(a, c)))
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    got = sorted([(x.doc_id, x.n_chars, x.fingerprint, x.edited_fingerprint, x.near_edited, x.near_next) for x in out], key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1e-12)


def test_ranges_are_dealt_one_to_a_task(spark):
    rows = [(k, odd.words(k, 30)) for k in range(200)]
    out = fingerprints.fingerprint_pairs(odd.frame(spark, rows), block_bytes=1_000)
    sizes = [r.n for r in out.selectExpr("spark_partition_id() AS part").groupBy("part").agg({"part": "count"}).toDF("part", "n").collect()]
    assert len(sizes) > 8 and max(sizes) <= 2 * 200 / len(sizes) + 2


# Quality model


def naive_features(t):
    raw = (t or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, per = len(words), max(len(words), 1)
    count = lambda chars: sum(b in chars for b in raw)
    symbols, letters = set(b"#*$%&|<>~^=+@_\\{}[]"), {*range(65, 91), *range(97, 123), *range(128, 256)}
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    share = lambda f: sum(map(bool, map(f, words))) / per
    return [
        math.log1p(n), sum(map(len, words)) / per, count(symbols) / per, share(lambda w: symbols & set(w)), count(set(range(65, 91))) / max(count(letters), 1), count(b"!") / per,
        count(b"0123456789") / max(len(raw), 1), share(lambda w: w[-1] in b".,"), 1 - len(set(words)) / per, 1 - len(set(grams)) / len(grams) if grams else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(n / (raw.count(b"\n") + 1)), share(lambda w: len(w) <= 2), share(lambda w: len(w) >= 12), count(b"|") / per,
        count(b"\t\x0b\x0c\r") / max(len(raw), 1),
    ]


def test_features_equal_a_naive_version():
    r = random.Random(6)
    texts = [t for _, t in odd.texts()] + ["".join(r.choice("aB9|!.,# \n\t\ré日") for _ in range(r.randint(0, 120))) for _ in range(80)]
    x, _ = quality_model.features(texts_of(pa.array(texts, pa.string())))
    assert np.abs(x - np.array([naive_features(t) for t in texts])).max() < 1e-12


def naive_fit(x, y, rounds, rate, n_pairs):
    """The same boosting, a row and a bin at a time, with dictionaries."""
    n, m = len(x), len(x[0])
    share = min(max(sum(y) / n, 1e-3), 1 - 1e-3)
    base = math.log(share / (1 - share))
    cuts = [quality_model._cuts(np.array([row[f] for row in x])).tolist() for f in range(m)]
    bins = [[sum(v <= row[f] for v in cuts[f]) for f in range(m)] for row in x]
    tables = [[0.0] * (len(c) + 1) for c in cuts]
    z = [base] * n
    chance = lambda v: 1 / (1 + math.exp(-v))

    def sums(keys):
        g, h = {}, {}
        for k, v, label in zip(keys, z, y, strict=True):
            g[k] = g.get(k, 0.0) + label - chance(v)
            h[k] = h.get(k, 0.0) + chance(v) * (1 - chance(v))
        return g, h

    for _ in range(rounds):
        for f in range(m):
            if not cuts[f]:
                continue
            g, h = sums([b[f] for b in bins])
            total = lambda s, a, b: sum(s.get(k, 0.0) for k in range(a, b))  # noqa: E731, B023
            bounds = [0, len(tables[f])]
            for _ in range(2):
                best = (1e-9, -1)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    gains = []
                    for c in range(a + 1, b):
                        gl, hl, gr, hr = total(g, a, c), total(h, a, c), total(g, c, b), total(h, c, b)
                        gains.append((gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1) if hl >= 4 and hr >= 4 else 0.0, -c))
                    if gains:
                        top = max(gains)
                        best = max(best, (top[0], -top[1]))
                if best[1] < 0:
                    break
                bounds = sorted([*bounds, best[1]])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for k in range(a, b):
                    tables[f][k] += rate * total(g, a, b) / (total(h, a, b) + 1)
            leaf = {k: rate * total(g, a, b) / (total(h, a, b) + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for k in range(a, b)}
            z = [v + leaf[b[f]] for v, b in zip(z, bins, strict=True)]
    coarse = [[k * min(8, len(t)) // len(t) for k in range(len(t))] for t in tables]

    def grid(f, g_):
        g, h = sums([(coarse[f][b[f]], coarse[g_][b[g_]]) for b in bins])
        best, step = 0.0, {}
        rows, cols = coarse[f][-1] + 1, coarse[g_][-1] + 1
        for i in range(1, rows):
            for j in range(1, cols):
                cells = [[(a, b) for a in ra for b in rb] for ra in (range(i), range(i, rows)) for rb in (range(j), range(j, cols))]
                parts = [(sum(g.get(c, 0.0) for c in cell), sum(h.get(c, 0.0) for c in cell)) for cell in cells]
                gain = sum(a * a / (b + 1) for a, b in parts if b >= 4)
                if gain > best * (1 + 1e-12):
                    best, step = gain, {c: a / (b + 1) if b >= 4 else 0.0 for cell, (a, b) in zip(cells, parts, strict=True) for c in cell}
        return best, step

    chosen = sorted(((grid(f, g)[0], f, g) for f in range(m) for g in range(f + 1, m) if cuts[f] and cuts[g]), reverse=True)[:n_pairs]
    for _ in range(quality_model.PAIR_ROUNDS):
        for _, f, g in chosen:
            step = grid(f, g)[1]
            z = [v + rate * step.get((coarse[f][b[f]], coarse[g][b[g]]), 0.0) for v, b in zip(z, bins, strict=True)]
    return [chance(v) for v in z]


def test_the_additive_model_equals_a_naive_version():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(160, 3)), 2)
    x[:, 2] = rng.integers(0, 3, 160)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0.5)).astype(float)
    model = quality_model.fit(x, y, rounds=4, rate=0.3, pairs=2)
    assert len(model.pairs) == 2
    assert np.abs(model.score(x) - np.array(naive_fit(x.tolist(), y.tolist(), 4, 0.3, 2))).max() < 1e-9


# Domains


def test_chances_of_domains_equal_a_naive_version():
    class Known:
        low, high = 0.0, 1.0

        def __init__(self, f):
            self.score = lambda x: np.array([f(row) for row in x])

    def one(word):
        t = texts_of(pa.array([word]))
        return int(mixing.word_parts(t.words())[0][0])

    stems = ["vil", "nasty", "großer", "übelkeit"]
    lexicon = np.sort(np.array([one(x) for x in stems], np.uint64))
    texts = [None, "", "Vile, vil (VIL) nasty!", "nastyness großere Übelkeit übelkeit", "vi na ;;; --", "villain village vil", odd.words(5, 200)]

    def entries(t):
        found = set()
        for raw in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()):
            bare = re.sub(rb"^[^A-Za-z\x80-\xff]+|[^A-Za-z\x80-\xff]+$", b"", raw)
            low = bytes(b + 32 if 65 <= b <= 90 else b for b in bare)
            parts = [low, *(low[:k] for k in mixing.PREFIXES if k < len(low) and low[k] & 0xC0 != 0x80)] if low else []
            found |= {p for p in parts if p in {s.encode() for s in stems}}
        return len(found)

    model = mixing.Domains(Known(lambda row: 1 / (1 + row[0])), Known(lambda row: min(1.0, row[0] / 4)), lexicon)
    words, p = model.chances(texts_of(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        q, tox = 1 / (1 + naive_features(t)[0]), min(1.0, entries(t) / 4)
        assert p[k] == pytest.approx([q * (1 - tox), q * tox, (1 - q) * (1 - tox), (1 - q) * tox])
    assert p[:, [1, 3]].sum(1).tolist()[2:4] == [0.5, 0.75] and words.counts.tolist()[:3] == [0, 0, 4]
