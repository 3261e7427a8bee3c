"""Training and validation: a conditional random field by L-BFGS over a table or by gradient steps in one process, k-fold runs, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crf
from . import evaluate, gbdt

Sequence = tuple[list[str], list[str]]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(emissions: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-partition, label chances of each token, and summed chances of label pairs."""
    n, k = emissions.shape
    a, b = np.empty((n, k)), np.zeros((n, k))
    a[0] = emissions[0]
    for t in range(1, n):
        a[t] = emissions[t] + _log_sum(a[t - 1][:, None] + trans, 0)
    for t in range(n - 2, -1, -1):
        b[t] = _log_sum(trans + (emissions[t + 1] + b[t + 1])[None, :], 1)
    z = float(_log_sum(a[-1], 0))
    pairs = sum((np.exp(a[t - 1][:, None] + trans + (emissions[t] + b[t])[None, :] - z) for t in range(1, n)), np.zeros((k, k)))
    return z, np.exp(a + b - z), pairs


def train_crf(sequences: list[Sequence], rounds: int = 60, l1: float = 1.0, l2: float = 1.0, step: float = 0.5) -> crf.Model:
    """Penalised likelihood by adaptive proximal gradient steps over a bounded set of sequences; every pair of labels has a transition weight."""
    labels = sorted({x for _, y in sequences for x in y})
    at = {x: k for k, x in enumerate(labels)}
    data = [([crf.token_features(t, i) for i in range(len(t))], np.array([at[x] for x in y])) for t, y in sequences if t]
    names = sorted({f for feats, _ in data for row in feats for f in row})
    index = {f: k for k, f in enumerate(names)}
    rows = [([np.array([index[f] for f in row]) for row in feats], y) for feats, y in data]
    w, trans = np.zeros((len(names), len(labels))), np.zeros((len(labels), len(labels)))
    gw, gt = np.full_like(w, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(rounds):
        dw, dt = -l2 * w, -l2 * trans
        for feats, y in rows:
            _, p, pairs = marginals(np.array([w[f].sum(0) for f in feats]), trans)
            p[np.arange(len(y)), y] -= 1
            for f, row in zip(feats, p, strict=True):
                dw[f] -= row
            dt -= pairs
            np.add.at(dt, (y[:-1], y[1:]), 1)
        gw += dw * dw
        gt += dt * dt
        for x, d, g in ((w, dw, gw), (trans, dt, gt)):
            rate = step / np.sqrt(g)
            x += rate * d
            x[:] = np.sign(x) * np.maximum(np.abs(x) - rate * l1, 0)
    return crf.Model(labels, {f: w[k].astype(np.float32) for f, k in index.items() if w[k].any()}, trans.astype(np.float32))


def batch_marginals(emissions: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """marginals() of some sequences end to end, summed; all take a step together, the longest first in the arrays."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], bounds[:-1][order]
    k = emissions.shape[1]
    a, b, z, pairs = np.zeros_like(emissions), np.zeros_like(emissions), np.zeros(len(emissions)), np.zeros((k, k))
    going = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) if len(size) else 0)]
    for t, n in enumerate(going):
        at = begin[:n] + t
        a[at] = emissions[at] + (_log_sum(a[at - 1][:, :, None] + trans, 1) if t else 0)
    for t in range(len(going) - 2, -1, -1):
        at = begin[: going[t + 1]] + t
        b[at] = _log_sum(trans + (emissions[at + 1] + b[at + 1])[:, None, :], 2)
    some = size > 0
    whole = _log_sum(a[(begin + size - 1)[some]], 1)
    z = np.repeat(whole, size[some])
    flat = np.concatenate([np.arange(x, x + n) for x, n in zip(begin[some], size[some], strict=True)]) if some.any() else np.zeros(0, int)
    of = np.zeros(len(emissions))
    of[flat] = z
    for t in range(1, len(going)):
        at = begin[: going[t]] + t
        pairs += np.exp(a[at - 1][:, :, None] + trans + (emissions[at] + b[at])[:, None, :] - of[at][:, None, None]).sum(0)
    return float(whole.sum()), np.exp(a + b - of[:, None]), pairs


def owl_qn(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, c1: float, steps: int = 100, history: int = 6, close: float = 1e-5) -> np.ndarray:
    """Minimises loss(w) + c1 |w|: limited-memory BFGS, orthant by orthant. loss gives its value and gradient."""

    def steepest(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.where(w > 0, g + c1, np.where(w < 0, g - c1, np.sign(g) * np.maximum(np.abs(g) - c1, 0)))

    value, g = loss(w)
    value += c1 * np.abs(w).sum()
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        slope = steepest(w, g)
        if np.abs(slope).max(initial=0.0) <= close * max(1.0, np.abs(w).max(initial=0.0)):
            break
        d, used = slope.copy(), []
        for x, y in reversed(past):
            r = (x @ d) / (x @ y)
            used.append(r)
            d -= r * y
        if past:
            x, y = past[-1]
            d *= (x @ y) / (y @ y)
        for (x, y), r in zip(past, reversed(used), strict=True):
            d += x * (r - (y @ d) / (x @ y))
        d = -np.where(d * slope > 0, d, 0.0)
        orthant = np.where(w != 0, np.sign(w), -np.sign(slope))
        length = 1.0 if past else 1.0 / max(np.linalg.norm(d), 1e-12)
        for _ in range(30):
            new = w + length * d
            new = np.where(new * orthant > 0, new, 0.0) if c1 else new
            after, h = loss(new)
            after += c1 * np.abs(new).sum()
            if after <= value + 1e-4 * slope @ (new - w):
                break
            length /= 2
        else:
            break
        if (new - w) @ (h - g) > 1e-12:
            past = [*past, (new - w, h - g)][-history:]
        done = value - after <= close * max(1.0, abs(after))
        w, value, g = new, after, h
        if done:
            break
    return w


def fit_crf(df: DataFrame, c1: float = 0.1, c2: float = 0.1, steps: int = 100, least: int = 1, max_features: int = 1_000_000, work: str | None = None) -> crf.Model:
    """A tagger from sequences (tokens, labels), arrays of one length, of any number: L-BFGS on the penalised likelihood
    -log p + c1 |w| + c2 w^2, with a weight for every pair of labels.

    Features are counted and encoded once, into `work` (by default a fresh path in the shared folder). A step is one pass: each
    task sums the gradient of its sequences, and the sums are added by weight. The driver holds the model, of at most max_features features
    (the commonest, of at least `least` tokens), never the data. Rows with nulls or unequal lengths are left out.
    """
    from ..sources.files import shared_folder

    spark = df.sparkSession
    df = df.select("tokens", "labels").where("size(tokens) > 0 AND size(tokens) = size(labels)").where(~F.exists("tokens", F.isnull) & ~F.exists("labels", F.isnull))
    labels = sorted(r[0] for r in df.select(F.explode("labels")).distinct().collect())
    if not labels:
        return crf.Model([], {}, np.zeros((0, 0), np.float32))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([f for i in range(len(tokens)) for f in crf.token_features(tokens, i)], pa.string())], ["feature"])

    counts = df.select("tokens").mapInArrow(named, "feature string").groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    names = [r["feature"] for r in counts.orderBy(F.col("n").desc(), "feature").limit(max_features).select("feature").collect()]
    index, place, k = {f: i for i, f in enumerate(sorted(names))}, {x: i for i, x in enumerate(labels)}, len(labels)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tokens, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = [[index[f] for f in crf.token_features(tokens, i) if f in index] for i in range(len(tokens))]
                rows.append(([x for row in ids for x in row], [len(row) for row in ids], [place[x] for x in said]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.list_(pa.int32())) for c in range(3)], ["ids", "sizes", "y"])

    path = work or shared_folder(spark, "sequences")
    df.mapInArrow(encoded, "ids array<int>, sizes array<int>, y array<int>").write.mode("overwrite").parquet(path)
    data = spark.read.schema("ids array<int>, sizes array<int>, y array<int>").parquet(path)
    n = len(index) * k

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        table, trans = w[:n].reshape(-1, k), w[n:].reshape(k, k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, grad, moves = 0.0, np.zeros((len(table), k)), np.zeros((k, k))
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, sizes, y = (batch.column(c).flatten().to_numpy() for c in range(3))
                bounds = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
                token = np.repeat(np.arange(len(y)), sizes)
                e = np.stack([np.bincount(token, table[ids, c], len(y)) for c in range(k)], 1)
                z, p, pairs = batch_marginals(e, bounds, trans)
                inner = np.ones(len(y), bool)
                inner[bounds[:-1]] = False
                at = np.flatnonzero(inner)
                total += z - e[np.arange(len(y)), y].sum() - trans[y[at - 1], y[at]].sum()
                p[np.arange(len(y)), y] -= 1
                for c in range(k):
                    grad[:, c] += np.bincount(ids, p[token, c], len(table))
                np.subtract.at(pairs, (y[at - 1], y[at]), 1)
                moves += pairs
            out = np.concatenate([grad.ravel(), moves.ravel()])
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(out[some], total))], ["i", "v"])

        sums = data.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        g, value = np.zeros(len(w)), 0.0
        for r in sums:
            if r["i"] < 0:
                value = r["v"]
            else:
                g[r["i"]] = r["v"]
        return value + c2 * float(w @ w), g + 2 * c2 * w

    w = owl_qn(loss, np.zeros(n + k * k), c1, steps)
    table = w[:n].reshape(-1, k)
    return crf.Model(labels, {f: table[i].astype(np.float32) for f, i in index.items() if table[i].any()}, w[n:].reshape(k, k).astype(np.float32))


def token_scores(model: crf.Model, sequences: list[Sequence]) -> pd.DataFrame:
    """Precision, recall and F1 of each label over tokens."""
    pairs = [(a, model.labels[k]) for t, y in sequences for a, k in zip(y, crf.viterbi(model.emissions(t), model.transitions), strict=True)]
    out = []
    for x in sorted({p for pair in pairs for p in pair}):
        tp, fp, fn = (sum(c(a, b) for a, b in pairs) for c in (lambda a, b: a == b == x, lambda a, b: b == x != a, lambda a, b: a == x != b))
        p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        out.append((x, tp, fp, fn, p, r, 2 * p * r / (p + r) if p + r else 0.0))
    return pd.DataFrame(out, columns=["label", "tp", "fp", "fn", "precision", "recall", "f1"])


def crf_folds(df: DataFrame, k: int = 5, max_sequences: int = 20_000, **settings) -> DataFrame:
    """(fold, label, tp, fp, fn, precision, recall, f1): a model a fold, trained in parallel tasks. df: (tokens, labels, fold).

    A task holds all sequences, so at most max_sequences are used, the first by a hash.
    """
    df = df.orderBy(F.xxhash64("tokens", "labels"), "fold").limit(max_sequences)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            fold = int(pdf["target"].iloc[0])
            seqs = [(list(t), list(y), int(f)) for t, y, f in zip(pdf["tokens"], pdf["labels"], pdf["fold"], strict=True)]
            model = train_crf([s[:2] for s in seqs if s[2] != fold], **settings)
            yield token_scores(model, [s[:2] for s in seqs if s[2] == fold]).assign(fold=fold)[["fold", "label", "tp", "fp", "fn", "precision", "recall", "f1"]]

    each = df.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.groupBy("target").applyInPandas(lambda pdf: next(run(iter([pdf]))), "fold int, label string, tp long, fp long, fn long, precision double, recall double, f1 double")


def evaluate_gbdt(model: gbdt.Model, df: DataFrame, columns: list[str]) -> DataFrame:
    """AUC, precision, recall and F1 of each label at one half."""
    labels = list(model.trees)
    s = gbdt.score(df.select(*columns, *[F.col(x).alias(f"y_{x}") for x in labels]), model, columns)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"y_{x}").cast("int").alias("actual"), F.col(x).alias("score")) for x in labels]))
    rows = s.select(rows.alias("r")).select("r.*").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return evaluate.scores(evaluate.confusion(rows, "label")).join(evaluate.auc(rows, "actual", "score", "label"), "label")


def gbdt_folds(df: DataFrame, label: str, columns: list[str], order: str, k: int = 5, fit: Callable | None = None, **settings) -> DataFrame:
    """(fold, part, auc, precision, recall, f1) on the training and validation part of each fold."""
    fit = fit or (lambda d: gbdt.from_spark(gbdt.train(d, label, columns, **settings), label))
    folds = evaluate.fold_ids(df, [label], order, k)
    out = None
    for f in range(k):
        model = fit(folds.where(F.col("fold") != f))
        for part, rows in (("train", folds.where(F.col("fold") != f)), ("valid", folds.where(F.col("fold") == f))):
            one = evaluate_gbdt(model, rows, columns).select(F.lit(f).alias("fold"), F.lit(part).alias("part"), "auc", "precision", "recall", "f1")
            out = one if out is None else out.unionByName(one)
    return out
