"""A quality classifier: a generalised additive model with pairwise interactions, scored by table look-ups.

Every whole text becomes a row of style features (counts and shares of words, lines, symbols, cases, repeats). Features are cut into bins at
31 training quantiles. Boosting goes around the features: each step fits a shallow tree to the gradient
histogram of one feature and adds it, damped, to that feature's table. Pairs of features with the largest remaining gain
then get two-dimensional tables in the same way. A score is the sum of a text's table entries through a sigmoid.

The fit uses a sample of at most `max_rows` labelled rows, chosen by a hash; the sample's keys are broadcast, which that
bound allows, and its features, 16 numbers a row and again at most `max_rows` rows, are fitted on the driver. Scoring is one scan without a shuffle.

Null text: as empty, which has a score like any text. A null doc_id is scored and never held out. Labels without a document, or with a
null label, aren't used. Of several labels or documents of one doc_id each counts, within that bound. Without labelled rows, or with one class only, scores are the share of label 1
(0.5 without rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .textkernel import IS_WORD, Texts, in_text, range_hash, slices, window_hash

MAX_ROWS, BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 20_000, 32, 60, 0.15, 6, 8, 30
FEATURES = (
    "words", "word_length", "symbols", "marked_words", "upper", "exclaims", "digits", "stops", "repeated_words", "repeated_trigrams",
    "repeated_lines", "line_words", "short_words", "long_words", "pipes", "other_bytes",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _class(b"#*$%&|<>~^=+@_\\{}[]"), _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def _distinct(keys: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys per text."""
    keys = np.sort(keys)
    bits = max(1, int(n - 1).bit_length())
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(64 - bits)).astype(np.int64), minlength=n)[:n]


def features(texts: Texts) -> tuple[np.ndarray, object]:
    """n x 16 style features of texts, and their words."""
    d, n = texts.data, texts.n
    words = texts.words()
    size = words.ends - words.starts
    count = words.counts.astype(float)
    per = np.maximum(count, 1.0)
    n_bytes = np.maximum(np.diff(texts.offsets), 1).astype(float)
    text = words.text_of()

    def words_with(flag: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=flag, minlength=n)[:n] if len(text) else np.zeros(n)

    symbol = _SYMBOL[d]
    symbols = texts.per_text(symbol)
    marked = np.zeros(len(d) + 1, np.int32 if len(d) < 1 << 31 else np.int64)
    np.cumsum(symbol, out=marked[1:])
    letters = np.maximum(texts.per_text(_LETTER[d]), 1)
    h = words.hashes(0, keep=True)
    at = words.windows(3)
    grams = np.bincount(text[at], minlength=n)[:n] if len(at) else np.zeros(n, np.int64)
    lines = texts.per_text(d == 10) + 1
    breaks = np.zeros(len(d) + 1, bool)
    breaks[texts.offsets] = True
    if len(d):
        breaks[1:] |= d == 10
        starts = np.flatnonzero(breaks[:-1])
        ends = np.append(starts[1:], len(d))
        live = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        starts, ends = starts[live], ends[live]
        ends = ends - (d[ends - 1] == 10)
        of = np.searchsorted(texts.offsets, starts, "right") - 1
        some = np.bincount(of, minlength=n)[:n]
        once = _distinct(in_text(range_hash(d, starts, ends, 1), of, n), n)
    else:
        some = once = np.zeros(n, np.int64)
    last = d[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    x = np.stack(
        [
            np.log1p(count),
            words_with(size) / per,
            symbols / per,
            words_with(marked[words.ends] > marked[words.starts]) / per,
            texts.per_text(_UPPER[d]) / letters,
            texts.per_text(d == 33) / per,
            texts.per_text(_DIGIT[d]) / n_bytes,
            words_with((last == 46) | (last == 44)) / per,
            1.0 - _distinct(in_text(h, text, n), n) / per,
            np.where(grams > 0, 1.0 - _distinct(in_text(window_hash(h, at, 3, 1), text[at], n), n) / np.maximum(grams, 1), 0.0),
            np.where(some > 0, 1.0 - once / np.maximum(some, 1), 0.0),
            np.log1p(count / np.maximum(lines, 1)),
            words_with(size <= 2) / per,
            words_with(size >= 12) / per,
            texts.per_text(d == 124) / per,
            texts.per_text(~IS_WORD[d] & (d != 32) & (d != 10)) / n_bytes,
        ],
        1,
    )
    return x, words


class Additive:
    """Fitted tables: cuts[f] are bin bounds, tables[f] and pair tables log-odds."""

    def __init__(self, base: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.cuts, self.tables, self.pairs = base, cuts, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[bins[f]]
        for f, g, coarse_f, coarse_g, t in self.pairs:
            z += t[coarse_f[bins[f]], coarse_g[bins[g]]]
        return 1.0 / (1.0 + np.exp(-z))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, least: float = 4.0, ridge: float = 1.0) -> np.ndarray:
    """A tree of a few leaves over the bins of one feature: the step for each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    bounds = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
            whole = (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
            gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole, 0.0)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), int(m[k])))
        if best[1] < 0:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.empty(len(grad))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _grid(grad: np.ndarray, hess: np.ndarray, least: float = 4.0, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """One cut of each axis, four cells: its gain and step. grad, hess: two-dimensional histograms."""
    best, out = 0.0, np.zeros_like(grad)
    cg, ch = np.zeros((grad.shape[0] + 1, grad.shape[1] + 1)), np.zeros((grad.shape[0] + 1, grad.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    for i in range(1, grad.shape[0]):
        for j in range(1, grad.shape[1]):
            g = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]])
            h = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]])
            gain = float((np.where(h >= least, g**2 / (h + ridge), 0.0)).sum())
            if gain > best:
                step = np.where(h >= least, g / (h + ridge), 0.0)
                best = gain
                out = np.empty_like(grad)
                out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = step
    return best, out


def _cuts(values: np.ndarray) -> np.ndarray:
    """Quantiles; a value that fills several of them gets a bin of its own, so that rare values above it don't share its bin."""
    if not len(values):
        return np.zeros(0)
    q, times = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]), return_counts=True)
    return np.unique(np.concatenate([q, np.nextafter(q[times > 1], np.inf)]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> Additive:
    """x: rows of features; y: labels 0 or 1."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = math.log(share / (1 - share))
    cuts = [_cuts(x[:, f]) for f in range(x.shape[1])]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if len(np.unique(y)) < 2:
        return Additive(base, cuts, tables, [])
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    z = np.full(len(y), base)
    for _ in range(rounds):
        for f, t in enumerate(tables):
            if len(t) > 1:
                p = 1.0 / (1.0 + np.exp(-z))
                step = rate * _tree(np.bincount(bins[f], y - p, len(t)), np.bincount(bins[f], p * (1 - p), len(t)))
                t += step
                z += step[bins[f]]
    # Coarser bins for pairs.
    coarse = [np.arange(len(t)) * min(PAIR_BINS, len(t)) // len(t) for t in tables]
    small = [c[b] for c, b in zip(coarse, bins, strict=True)]

    def histograms(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (coarse[f][-1] + 1, coarse[g][-1] + 1)
        p = 1.0 / (1.0 + np.exp(-z))
        at = small[f] * shape[1] + small[g]
        return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_grid(*histograms(f, g))[0], f, g) for f, g in combinations(range(len(tables)), 2) if min(len(tables[f]), len(tables[g])) > 1), reverse=True)
    chosen = [(f, g, np.zeros((coarse[f][-1] + 1, coarse[g][-1] + 1))) for _, f, g in gains[:pairs]]
    for _ in range(PAIR_ROUNDS):
        for f, g, t in chosen:
            step = rate * _grid(*histograms(f, g))[1]
            t += step
            z += step[small[f], small[g]]
    return Additive(base, cuts, tables, [(f, g, coarse[f], coarse[g], t) for f, g, t in chosen])


def bounded(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """At most `most` rows, those of the least hashes of the columns `by`: alike in every run. Only hashes are put in order, and only that many
    reach the driver; rows stay where they are. Of equal rows at the bound none stays."""
    key = F.xxhash64(F.lit(1), *by)
    every = max(1, rows.count() // max(1, 4 * most))
    thin = rows.where(F.pmod(F.xxhash64(*by), F.lit(every)) == 0)
    least = [r["k"] for r in thin.select(key.alias("k")).orderBy("k").limit(most + 1).collect()]
    return thin if len(least) <= most else thin.where(key < least[most])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of labelled documents that aren't held out: at most max_rows labels, and all documents that have these ids."""
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    sample = bounded(kept.where(~held_out(F.col("doc_id"))), max_rows, "doc_id", "label")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(sample), "doc_id")  # bounded by max_rows


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_features(sample: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most max_rows rows: documents may repeat an id, so this bounds what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                x, _ = features(texts)
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    # In a fixed order, so that sums of floats are the same in any run.
    measured = sample.select("doc_id", "text", "label").mapInArrow(run, "label int, x array<double>")
    rows = sorted((tuple(r["x"]), r["label"]) for r in bounded(store(measured, "quality-sample"), max_rows, "x", "label").collect())
    if not rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Additive:
    return fit(*sample_features(labelled_sample(docs, labels, label, max_rows), max_rows))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (the chance of quality 1) and predicted."""
    model = fit_quality(docs, labels, "quality", max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                p = model.score(features(texts)[0])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
