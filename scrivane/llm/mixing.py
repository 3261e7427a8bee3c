"""Mixing to target weights with soft domain membership.

Domains are the four cells of quality (good, poor) and toxicity of the table of labels. A classifier learned there gives every
document the chances p[d, k] that it belongs to domain k; nothing is assigned for good. With t[d] tokens in document d, rates
w[d] >= 0 are fitted by least squares so that the expected totals sum_d t[d] p[d, k] w[d] match the targets:

    minimise  1/2 sum_k (sum_d t p_k w / N - target_k)^2  +  ridge/2 sum_d t (w - 1)^2 / N,   w >= 0

by projected gradient. A document's gradient is p[d] . g with one number g_k a domain, the residual of its total and ridge's share, so all
rates move together: w[d] <- max(0, z[d] - p[d] . (S g)), where z is the rate before the projection. A plain step has S = s I and creeps along
rare domains; here S is the inverse of the domains' Gram matrix over documents with w > 0, which every pass sums beside the totals, and
steps that don't lower the objective enough are halved. As z = 1 - p . dual with dual the sum of all steps, that is also Newton's method on the problem's
dual of four variables, so a handful of passes ends at the optimum, however rare a domain is. The ridge is small against the rarest
domain's share, or it would hold that domain's rates at 1. A pass needs only sums over all documents; it writes no state and a lost executor costs its own tasks
only. The passes read a small table of (doc_id, tokens, chances), not the texts.

Tokens are counted by the token counter of a byte-level vocabulary, word by word; without a tokenizer, words stand in.

The classifier: quality by the additive model of style features; toxicity by an additive model of how many words of a lexicon a text
has. The lexicon holds the words and beginnings of words over-represented in toxic rows of one half of the sample, counted once per group of near copies (one MinHash
register names the group); the model is fitted on the other half. Chances are corrected for wrong labels. The sample has at most max_rows labelled rows, which also
bounds the lexicon; everything else covers all documents.

Null text: as empty, of no tokens: it weighs nothing in the totals and has a rate from its chances. A null doc_id keeps its row; its
copies are its rate rounded. Repeated rows count each. Without labels all chances are equal and rates follow from these.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .quality_model import _LETTER, FEATURES, Additive, bounded, features, fit
from .near_dedup import distinct
from .textkernel import Texts, Words, classes, mix, powers, slices
from .token_counts import WordCounter, counter

DOMAINS = ("good", "good_toxic", "poor", "poor_toxic")
#: Target totals as multiples of the expected totals of the corpus as it is.
TARGETS = (1.0, 0.0, 0.25, 0.0)
MAX_ROWS, LEAST_ROWS, LEAST_ODDS, STEPS, RIDGE, CLOSE = 20_000, 8, 3.0, 60, 1e-4, 1e-6
#: Path, rank table and pattern of a tokenizer, as counter() takes them.
Tokenizer = tuple[str, str | None, str | None]
#: A domain whose total is off its target by more than this share of its natural total is reported.
MISSED = 0.01
#: A drawn document whose rate is at least 1 - NEAR stays at least once.
NEAR = 0.05
#: Texts that are measured at once, in bytes: eight bytes for each are then less than what the system maps anew for every array.
SLICE = 1 << 18
_U = np.uint64
#: Prefixes of words, in bytes, that may stand in the lexicon: compounds are built on stems.
PREFIXES = (3, 4, 5, 6, 7, 8)
_BYTES = np.random.Generator(np.random.PCG64(0xB17E5)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bare_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of words without the marks at either end."""
    d = words.texts.data
    a, b = words.starts.copy(), words.ends.copy()
    at = np.arange(len(a))
    while len(at := at[~_LETTER[d[a[at]]]]):
        a[at] += 1
        at = at[a[at] < b[at]]
    at = np.flatnonzero(a < b)
    while len(at := at[~_LETTER[d[b[at] - 1]]]):
        b[at] -= 1
    return a, b


def word_parts(words: Words, lengths: tuple[int, ...] = PREFIXES) -> list[np.ndarray]:
    """Hashes of lower-cased bare words and of their prefixes of some lengths in bytes; 0 where there is none."""
    d = words.texts.data
    a, b = bare_words(words)
    up, down = powers(len(d) + 1)
    total = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[d]] * up[: len(d)], out=total[1:])
    out = []
    for k in (0, *lengths):
        e = b if k == 0 else np.minimum(a + k, b)
        h = mix((total[e] - total[a]) * down[a])
        # A prefix is shorter than its word and ends with a code point.
        none = a >= b if k == 0 else (e >= b) | ((d[np.minimum(e, max(len(d) - 1, 0))] & 0xC0) == 0x80) if len(d) else np.zeros(0, bool)
        h[none] = 0
        out.append(h)
    return out


def lexicon_hits(parts: list[np.ndarray], text: np.ndarray, n: int, lexicon: np.ndarray) -> np.ndarray:
    """How many different entries of the lexicon each text has."""
    row, entry = lexicon_entries(parts, lexicon)
    pairs = np.unique(text[row] * len(lexicon) + entry)
    return np.bincount(pairs // max(1, len(lexicon)), minlength=n)[:n]


def lexicon_entries(parts: list[np.ndarray], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of parts and the entries of the lexicon that are found there."""
    if not len(lexicon):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[lexicon >> _U(48)] = True
    found = []
    for h in parts:
        few = np.flatnonzero(maybe[h >> _U(48)])
        at = np.minimum(np.searchsorted(lexicon, h[few]), len(lexicon) - 1)
        hit = lexicon[at] == h[few]
        found.append((few[hit], at[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_hits(words: Words, lexicon: np.ndarray) -> np.ndarray:
    """As lexicon_hits over all words and their parts; equal words are looked up once."""
    first, of = classes(words.hashes(0))
    some = np.sort(first)
    once = Words(words.texts, words.starts[some], words.ends[some], np.array([0, len(some)]))
    row, entry = lexicon_entries(word_parts(once), lexicon)
    # Words of the classes that have entries, each with all of them.
    kind = of[some[row]]
    order = np.argsort(kind, kind="stable")
    kind, entry = kind[order], entry[order]
    n_entries = np.bincount(kind, minlength=len(first))
    at = np.flatnonzero(n_entries[of] > 0)
    times = n_entries[of[at]]
    begin = np.repeat(np.searchsorted(kind, of[at]) - np.cumsum(times) + times, times)
    text = np.repeat(words.text_of()[at], times)
    pairs = np.unique(text * len(lexicon) + entry[begin + np.arange(len(begin))])
    return np.bincount(pairs // max(1, len(lexicon)), minlength=words.texts.n)[: words.texts.n]


def toxic_features(hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.stack([hits, hits / np.sqrt(np.maximum(n_words, 1.0))], 1).astype(float)


class Cleaned:
    """A fitted model whose chances are corrected for wrong labels.

    The least and greatest chances that it gives in the sample, at the 1st and 99th percentile, are taken for those of rows that surely
    are of one class: what they lack to 0 and 1 is the share of wrong labels (anchor points), and chances are stretched by it. The closer
    the two are, the less the features say and the less chances are stretched: by a share that falls from 1, where they are half apart, to 0.
    """

    def __init__(self, model: Additive, x: np.ndarray):
        self.model = model
        seen = model.score(x)
        self.low, self.high = (float(v) for v in np.quantile(seen, [0.01, 0.99])) if len(seen) else (0.0, 1.0)
        sure = min(1.0, 2 * (self.high - self.low))
        self.low, self.high = sure * self.low, 1 - sure * (1 - self.high)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.model.score(x) - self.low) / (self.high - self.low), 0.0, 1.0)


class Domains:
    """Chances of the four domains for texts."""

    def __init__(self, quality: Cleaned, toxic: Cleaned, lexicon: np.ndarray):
        self.quality, self.toxic, self.lexicon = quality, toxic, lexicon

    def chances(self, texts: Texts) -> tuple[Words, np.ndarray]:
        """Words, and n x 4 chances."""
        x, words = features(texts)
        hits = word_hits(words, self.lexicon)
        q, t = self.quality.score(x), self.toxic.score(toxic_features(hits, words.counts))
        return words, np.stack([q * (1 - t), q * t, (1 - q) * (1 - t), (1 - q) * t], 1)


def fit_domains(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Domains:
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    good = good.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)")
    sample = bounded(good, max_rows, "doc_id", "quality", "toxic")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, limit=SLICE):
                x, words = features(texts)
                parts = word_parts(words)
                h, bounds = distinct(np.concatenate(parts), np.tile(words.text_of(), len(parts)), texts.n)
                raw = h.tobytes()
                group = [int(h[a : a + 2].max() >> _U(1)) if b > a else 0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in (0, 2, 3)), pa.array(group, pa.int64()), pa.array(words.counts.astype(np.int64)), pa.array(list(x), pa.list_(pa.float64())), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                    ["doc_id", "quality", "toxic", "group", "n_words", "x", "words"],
                )

    measured = (text.join(F.broadcast(sample), "doc_id").mapInArrow(measure, "doc_id long, quality int, toxic int, group long, n_words long, x array<double>, words binary"))
    # Documents may repeat an id, so the bound holds again for what was measured.
    known = bounded(store(measured, "mixing-sample"), max_rows, "doc_id", "quality", "toxic", "words")
    half = F.pmod(F.xxhash64("group"), F.lit(2))
    once = known.where(half == 0).groupBy("group", "toxic").agg(F.first("words").alias("words"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(b, np.int64) for b in batch.column(1).to_pylist()]
            toxic = np.repeat(batch.column(0).to_numpy(), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*words, np.zeros(0, np.int64)])), pa.array(toxic.astype(np.int64))], ["h", "toxic"])

    both = once.groupBy().agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    n_toxic, n_clean = both["toxic"] or 0, (both["n"] or 0) - (both["toxic"] or 0)
    counts = once.select("toxic", "words").mapInArrow(spread, "h long, toxic long").where("h <> 0").groupBy("h").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("n") - F.col("a") + 0.5) / (n_clean + 1.0))
    chosen = counts.where(F.col("a") >= max(LEAST_ROWS, n_toxic // 100)).where(odds >= LEAST_ODDS).select("h").collect()
    lexicon = np.sort(np.array([r["h"] for r in chosen], np.int64).view(np.uint64))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(b, np.uint64) for b in batch.column(0).to_pylist()]
            text = np.repeat(np.arange(len(words)), [len(w) for w in words])
            n = lexicon_hits([np.concatenate([*words, np.zeros(0, np.uint64)])], text, len(words), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(n), *(batch.column(k) for k in range(1, 6))], ["hits", "quality", "toxic", "half", "n_words", "x"])

    rows = known.select("words", "quality", "toxic", half.cast("int").alias("half"), "n_words", "x").mapInArrow(hits, "hits long, quality int, toxic int, half int, n_words long, x array<double>").collect()
    rows = sorted((r["x"], r["quality"], r["toxic"], r["half"], r["n_words"], r["hits"]) for r in rows)
    x = np.array([r[0] for r in rows]).reshape(len(rows), len(FEATURES))
    quality, toxic, side, n_words, n_hits = (np.array([r[k] for r in rows], float) for k in range(1, 6))
    other = side == 1
    found = toxic_features(n_hits, n_words)[other]
    return Domains(Cleaned(fit(x, quality), x), Cleaned(fit(found, toxic[other]), found), lexicon)


def domain_chances(docs: DataFrame, model: Domains, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(doc_id, n_tokens, p): one scan. Without a tokenizer n_tokens counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordCounter(counter(*tokenizer)) if tokenizer else None
        for batch in batches:
            for part, texts in slices(batch, limit=SLICE):
                words, p = model.chances(texts)
                n = tokens.of(texts, words) if tokens else words.counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(DOMAINS)).cast(pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(batch.num_rows, -1)


class Rates:
    """What fit_rates finds: enough to compute any document's rate from its chances. reached: the totals of the fitted rates."""

    def __init__(self, dual: np.ndarray, passes: int, natural: np.ndarray, target: np.ndarray, reached: np.ndarray):
        self.dual, self.passes = dual, passes
        self.natural, self.target, self.reached = natural, target, reached

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1.0 - p @ self.dual)


def fit_rates(chances: DataFrame, targets: tuple[float, ...] = TARGETS, steps: int = STEPS, ridge: float | None = None, close: float = CLOSE) -> Rates:
    """Targets are multiples of the natural totals; ridge is by default RIDGE times the least domain's share of all tokens.

    Stops when what the optimum's condition lacks is within `close` of its own natural total in every domain; raises if that isn't
    so after `steps` passes. Warns if the optimum itself misses a target by more than MISSED of the natural total.
    """
    k = len(targets)

    def totals(dual: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums of t p w, of t p p' over documents with w > 0, and of t w w."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                p, t = _matrix(batch, "p"), batch.column(0).to_numpy().astype(float)
                w = np.maximum(0.0, 1.0 - p @ dual)
                out = np.concatenate([(t * w) @ p, ((p * (t * (w > 0))[:, None]).T @ p).ravel(), [(t * w) @ w]])
                yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

        parts = chances.select("n_tokens", "p").mapInArrow(run, "s array<double>")
        # One array of sums a batch; added on executors first, in the order of their values, so that the result doesn't depend on timing.
        got = parts.groupBy().agg(*[F.sum(F.col("s")[i].cast("decimal(38,9)")).alias(f"s{i}") for i in range(k * k + k + 1)]).first()
        sums = np.array([float(v or 0) for v in got])
        return sums[:k], sums[k:-1].reshape(k, k), float(sums[-1])

    dual, passes = np.zeros(k), 1
    natural, gram, square = totals(dual)
    whole = max(float(natural.sum()), 1.0)
    share = natural / whole
    target = np.array(targets) * share
    if ridge is None:
        ridge = RIDGE * float(np.min(share[share > 0], initial=1.0))
    enough = np.maximum(close * share, 1e-12 + 1e-8 / whole)  # sums are rounded
    value = lambda dual, square: square / whole / 2 + ridge / 2 * dual @ dual + target @ dual
    reached = natural
    while (np.abs(lack := ridge * dual - reached / whole + target) > enough).any():
        slope = gram / whole + ridge * np.eye(k)
        scale = 1 / np.sqrt(np.diag(slope))
        move = -scale * np.linalg.solve(slope * np.outer(scale, scale), scale * lack)  # the gradient, scaled by the domains' Gram matrix
        now, length = value(dual, square), 1.0
        while True:
            if passes >= steps:
                raise RuntimeError(f"mixing rates aren't settled after {steps} passes: {np.abs(lack).tolist()} of all tokens, at most {enough.tolist()} asked")
            reached, gram, square = totals(dual + length * move)
            passes += 1
            if value(dual + length * move, square) <= now + 1e-4 * length * (lack @ move) + 1e-13 * abs(now):
                break
            length /= 2
        dual = dual + length * move
    missed = np.abs(reached / whole - target) > MISSED * share
    if missed.any():
        warnings.warn(f"mixing targets {(target * whole)[missed].tolist()} are out of reach: {reached[missed].tolist()} of {natural[missed].tolist()} tokens", stacklevel=2)
    return Rates(dual, passes, natural, target * whole, reached)


def drawn_copies(ids: pa.Array, w: np.ndarray) -> np.ndarray:
    """Rates rounded up or down by a hash of doc_id, so that the expected copies are the rate; without doc_id, rounded."""
    u = (mix(ids.fill_null(0).to_numpy().astype(np.uint64) + _U(0x3C6EF372FE94F82B)) >> _U(11)).astype(float) * 2.0**-53
    u[np.asarray(ids.is_null())] = 0.5
    return np.floor(w + u).astype(np.int32)


def document_rates(chances: DataFrame, rates: Rates) -> DataFrame:
    """Per document: doc_id, n_tokens, the four chances, its rate, and copies: the rate rounded up or down by a hash of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _matrix(batch, "p")
            w = rates.of(p)
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), *(pa.array(p[:, j]) for j in range(4)), pa.array(w), pa.array(drawn_copies(ids, w))], ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"])

    return chances.select("doc_id", "n_tokens", "p").mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double, copies int")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, max_rows: int = MAX_ROWS, tokenizer: Tokenizer | None = None) -> DataFrame:
    chances = store(domain_chances(docs, fit_domains(docs, labels, max_rows), tokenizer), "domain-chances")
    return document_rates(chances, fit_rates(chances, targets))


def keep_mixed(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, max_rows: int = MAX_ROWS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Rows of docs, all columns, each as many times as document_rates has copies of it, so that the expected totals of what is kept
    match the targets; rows of rates from 1 - NEAR on stay at least once, so that no clean document goes by
    chance. The texts are scanned again with the fitted model; nothing is joined."""
    model = fit_domains(docs, labels, max_rows)
    rates = fit_rates(store(domain_chances(docs, model, tokenizer), "domain-chances"), targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, limit=SLICE):
                w = rates.of(model.chances(texts)[1])
                n = np.maximum(drawn_copies(part.column(at).cast(pa.int64()), w), w >= 1 - NEAR)
                for k in range(int(n.max(initial=0))):
                    yield part.filter(pa.array(n > k))

    at = docs.columns.index("doc_id")
    return docs.mapInArrow(run, docs.schema)
