"""Near-duplicate detection: SetSketch registers, banding, joint likelihood estimates, and exact confirmation.

A document's set holds its distinct 3-word shingles (A-Z lower-cased). A register holds the exponentially spaced, truncated
minimum of one exponential hash over the set: K = clip(floor(1 - log_b(min)), 0, q + 1). Registers of parts merge by maximum,
and two sets' registers agree with about the probability of their Jaccard similarity, so bands of a few registers
bring similar sets into one bucket. 20 bands of 4 registers miss a pair of similarity 0.85 with probability below 3e-6.

1. Equal sets fold into one (partial aggregation by a 128-bit digest of the set; the least doc_id stands for it).
2. Distinct sets meet in buckets. Pairs within a bucket are never all listed: in each round some leaders of a bucket are compared with its
   members that aren't known to be connected with them, so that a round's pairs are at most its leaders times its members. At first the
   least member leads, later members from outside the bucket's largest component, twice as many each round, until the bucket is one component. A leader that has
   been compared leaves the bucket, and a bucket whose members are all connected is closed. The rounds end when no bucket is
   open: every pair that shares a bucket has been compared or is connected.
3. A pair goes to confirmation unless the likelihood of its registers, given both set sizes, all but excludes the
   threshold: 256 registers then make it e**16 times likelier that the similarity is their estimate, a chance of less than 1e-8
   for a pair at the threshold and far less above it. Confirmation intersects the full sets.
4. Links are contracted into components; all documents then take their set's component.

Of texts and of sets only those that a join asks for are shuffled: a bitmap of their ids goes ahead of it.
Frequent keys (a set, a leader, a bucket or a component that a large share of rows has) are salted. Work tables are deleted when their round is over.

Null or empty text, or one without words: an empty set, linked with nothing, a component of its own. A null doc_id: linked with nothing,
component null, kept. Rows with one doc_id are one node. Fewer than 3 words: the whole sequence is one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, possible, salted_join, store
from .textkernel import Texts, in_text, mix, range_hash, slices

BANDS, ROWS, ESTIMATORS, BASE, RATE, LIMIT = 20, 4, 256, 1.001, 20.0, (1 << 16) - 2
THRESHOLD = (85, 100)
#: A pair is dropped unconfirmed if its registers are exp(DOUBT) times likelier at the best estimate than at the threshold.
DOUBT = 16.0
#: Keys of more rows than this are salted.
CHUNK = 50_000
_U = np.uint64
_seeds = np.random.Generator(np.random.PCG64(0x5E7)).integers(1, 1 << 32, size=(2, 4096), dtype=np.uint32) | np.uint32(1)


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 3-word shingles (or of a shorter whole sequence), with their texts' numbers, in text order."""
    words = texts.words()
    h = words.hashes(0, lower=True)
    at = words.windows(3)
    text = np.searchsorted(words.bounds, at, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < 3))
    starts = np.concatenate([at, words.bounds[short]])
    ends = np.concatenate([at + 3, words.bounds[short + 1]])
    text = np.concatenate([text, short])
    order = np.argsort(starts, kind="stable")
    return range_hash(h, starts[order], ends[order], 1), text[order]


def distinct(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ascending within it, and n + 1 offsets."""
    order = np.lexsort((h, text)) if n > 1 << 16 else np.argsort(in_text(h, text, n), kind="stable")
    h, text = h[order], text[order]
    if n <= 1 << 16 and len(h):  # the key leaves out the lowest bits
        wrong = np.flatnonzero((h[1:] < h[:-1]) & (text[1:] == text[:-1]))
        if len(wrong):
            again = np.lexsort((h, text))
            h, text = h[again], text[again]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(n + 1))


def registers(h: np.ndarray, text: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m SetSketch registers."""
    out = np.zeros((n, m), np.uint16)
    full, head = np.unique(text, return_index=True)
    if not len(full):
        return out
    low = (h >> _U(32)).astype(np.uint32) ^ h.astype(np.uint32)
    least = np.empty((m, len(full)), np.uint32)
    for i in range(m):
        x = (low ^ _seeds[0, i]) * _seeds[1, i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        least[i] = np.minimum.reduceat(x, head)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-32) / RATE
    out[full] = np.clip(np.floor(1.0 - np.log(value) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16).T
    return out


def _set_digest(sets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ _U(seed)), dtype=np.uint64)])
        out.append(c[offsets[1:]] - c[offsets[:-1]])
    both = np.stack(out, 1).tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                h, text = shingles(texts)
                sets, offsets = distinct(h, text, texts.n)
                regs = registers(h, text, texts.n, bands * rows)
                size = regs.shape[1] * 2
                raw = regs.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(_set_digest(sets, offsets), pa.binary()), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())],
                    ["doc_id", "n", "digest", "regs"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, regs binary")


def band_keys(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, bands, rows).astype(np.uint64)
            key = np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
            key = np.broadcast_to(key, regs.shape[:2]).copy()
            for r in range(rows):
                key = mix(key ^ (regs[:, :, r] + _U(r << 32)))
            k = np.repeat(np.arange(batch.num_rows), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), batch.column(0).take(pa.array(k)), batch.column(1).take(pa.array(k))], ["bucket", "rep", "n"])

    return reps.select("rep", "n", "regs").mapInArrow(run, "bucket long, rep long, n long")


def log_likelihood(j: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of similarity j, given how many registers of the first set are above, below and equal to the second's. u + v = 1: shares of sizes."""

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1) / BASE) / math.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    return above * np.log(a) + below * np.log(b) + equal * np.log(np.clip(1 - a - b, 1e-12, 1.0))


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair, and by how much its log-likelihood exceeds the threshold's."""
    above, below = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    equal = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    most = hi.copy()
    for _ in range(40):  # the log-likelihood is concave
        x, y = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        up = log_likelihood(x, above, below, equal, u, v) < log_likelihood(y, above, below, equal, u, v)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    best = (lo + hi) / 2
    at = np.minimum(threshold, most)
    return best, log_likelihood(best, above, below, equal, u, v) - log_likelihood(at, above, below, equal, u, v)


def plausible(pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b, n_a, n_b, regs_a, regs_b) whose registers don't all but exclude the threshold."""
    level = threshold[0] / threshold[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            n_a, n_b = (c[x].to_numpy(zero_copy_only=False).astype(float) for x in ("n_a", "n_b"))
            ra, rb = (np.frombuffer(b"".join(c[x].to_pylist()), np.uint16).reshape(batch.num_rows, -1) for x in ("regs_a", "regs_b"))
            best, over = joint_estimate(ra, rb, n_a, n_b, level)
            yield batch.filter(pa.array((best >= level) | (over <= DOUBT))).select(["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b, set_a, set_b) that reach the threshold on the full sets."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = int((x[place] == y).sum())
                keep[k] = den * same >= num * (len(x) + len(y) - same)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, estimators: int) -> DataFrame:
    """(rep, n, regs, set): size, registers for estimates, and the sorted shingle hashes of each row, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                h, text = shingles(texts)
                sets, offsets = distinct(h, text, texts.n)
                raw, regs = sets.tobytes(), registers(h, text, texts.n, estimators).tobytes()
                o = (offsets * 8).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array([regs[i : i + 2 * estimators] for i in range(0, len(regs), 2 * estimators)], pa.binary()), pa.array([raw[x:y] for x, y in zip(o[:-1], o[1:], strict=True)], pa.binary())],
                    ["rep", "n", "regs", "set"],
                )

    return docs.mapInArrow(run, "rep long, n long, regs binary, set binary")


def contract(links: DataFrame, chunk: int = CHUNK) -> DataFrame | None:
    """Connected components of links (a, b): rows (node, comp), comp the least node of its component; None without links.

    Each round maps every node to its least neighbour, follows that map a few steps, and contracts the links along it. Nodes that
    very many others map to, or are linked with, are salted.
    """
    edges = store(links.where("a <> b").distinct(), "links")
    comp = None
    while n_edges := edges.count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        nearest = parent = store(nearest, "parents")
        n_nodes = nearest.count()
        for _ in range(2):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = salted_join(parent, up, "p", None, n_nodes, "node", chunk).select("node", F.col("pp").alias("p"))
        parent = store(parent, "parents")
        a = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        b = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        # Each node's link to its parent is contracted to nothing; links between one pair of parents fold into one.
        moved = salted_join(salted_join(edges, a, "a", None, n_edges, "b", chunk), b, "b", None, n_edges, "a", chunk)
        moved = store(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "links")
        discard(nearest, edges)
        edges = moved
        if comp is None:
            comp = parent.select("node", F.col("p").alias("comp"))
            held = parent
        else:
            up = parent.select(F.col("node").alias("comp"), "p")
            comp = store(salted_join(comp, up, "comp", None, comp.count(), "node", chunk, "left").select("node", F.coalesce("p", "comp").alias("comp")), "components")
            discard(held, parent)
            held = comp
    discard(edges)
    if comp is not None:
        comp._stored_at = held._stored_at
    return comp


def near_dedup(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: tuple[int, int] = THRESHOLD, estimators: int = ESTIMATORS, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = store(signatures(docs, bands, rows), "signatures")
    known = sig.where("doc_id IS NOT NULL AND n > 0")
    folded = known.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("regs").alias("regs"))
    reps = store(folded, "distinct-sets")

    keys = band_keys(reps, bands, rows)
    shared = store(keys.groupBy("bucket").agg(F.count("*").alias("n_members"), F.min(F.struct("rep", "n")).alias("lead")).where("n_members > 1"), "buckets")
    entries = shared.agg(F.sum("n_members")).first()[0] or 0
    comp = None
    if entries:
        counts = shared.select("bucket", F.col("n_members").alias("n"))
        members = store(salted_join(keys.select("bucket", "rep", F.col("n").alias("size")), shared.select("bucket", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_size")), "bucket", counts, entries, "rep", chunk), "members")
        involved = store(members.select("rep").distinct(), "involved")
        text = possible(docs, "doc_id", involved, involved.count())
        text = text.join(involved, text["doc_id"] == involved["rep"], "left_semi")
        sets = store(shingle_sets(text.select("doc_id", "text"), estimators).distinct(), "sets")
        discard(involved)

        def joined(pairs: DataFrame, *columns: str) -> DataFrame:
            """Pairs with the columns of both sides; a document of very many pairs is salted."""
            total = pairs.count()
            for side, other in (("b", "a"), ("a", "b")):
                one = sets.select(F.col("rep").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
                counts = pairs.groupBy(side).agg(F.count("*").alias("n"))
                one = possible(one, side, counts.select(side), total)
                out = salted_join(pairs if side == "b" else out, one, side, counts, total, other, chunk)
            return out

        def linked(links: DataFrame | None, pairs: DataFrame) -> DataFrame:
            """The links so far and those among new pairs."""
            pairs = store(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
            likely = store(plausible(joined(pairs, "n", "regs"), threshold), "plausible")
            new = confirmed(joined(likely, "set"), threshold)
            out = store(new if links is None else links.union(new), "links")
            discard(pairs, likely, *([] if links is None else [links]))
            return out

        num, den = threshold
        near_sizes = F.expr(f"{den} * least(size, lead_size) >= {num} * greatest(size, lead_size)")
        links = linked(None, members.where("rep <> lead").where(near_sizes).select(F.col("lead").alias("a"), F.col("rep").alias("b")))
        # The leader has been compared with all others of its bucket.
        left = members.where("rep <> lead").select("bucket", "rep", "size")
        leaders, old, n_left = 16, [members], entries
        while True:
            if comp is not None:
                discard(comp)
            comp = contract(links, chunk)
            left = left.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left") if comp is not None else left.withColumn("comp", F.lit(None).cast("long"))
            left = left.withColumn("comp", F.coalesce("comp", "rep"))
            sizes = left.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
            largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.sum("k").alias("n"), F.count("*").alias("comps")).where("comps > 1")
            largest = store(largest, "largest")
            left = store(salted_join(left, largest.select("bucket", "main"), "bucket", largest.select("bucket", "n"), n_left, "rep", chunk), "open-buckets")
            # Sampling the leaders by hash keeps this free of a sort within a bucket; all of few are taken.
            n_left = left.count()
            beside = left.where("comp <> main")
            outside = beside.groupBy("bucket").agg(F.count("*").alias("outside"))
            lead = salted_join(beside, outside, "bucket", outside.withColumnRenamed("outside", "n"), n_left, "rep", chunk)
            lead = lead.where(F.pmod(F.xxhash64("rep", F.lit(leaders)), F.greatest(F.ceil(F.col("outside") / leaders), F.lit(1))) == 0)
            lead = store(lead.select("bucket", F.col("rep").alias("a"), F.col("size").alias("lead_size"), F.col("comp").alias("lead_comp")), "leaders")
            discard(*old)
            old = [largest, left, lead]
            if not n_left:
                break
            pairs = salted_join(left, lead, "bucket", largest.select("bucket", "n"), n_left, "rep", chunk)
            links = linked(links, pairs.where("comp <> lead_comp").where(near_sizes).select("a", F.col("rep").alias("b")))
            left = left.join(lead.select("bucket", F.col("a").alias("rep")), ["bucket", "rep"], "left_anti").select("bucket", "rep", "size")
            leaders *= 2
        discard(sets, links, shared, *old)

    named = reps.select("digest", "n", "rep")
    if comp is not None:
        named = named.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("digest", "n", F.coalesce("comp", "rep").alias("comp"))
    else:
        named = named.select("digest", "n", F.col("rep").alias("comp"))
    key = F.concat(F.col("digest"), F.encode(F.col("n").cast("string"), "utf-8")).alias("key")
    of_set = salted_join(known.select("doc_id", "n", key), named.select(key, "comp"), "key", reps.select(key, F.col("copies").alias("n")), known.count(), "doc_id", chunk)
    rest = sig.where("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("comp"))
    out = of_set.select("doc_id", "n", "comp").unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns, that near_dedup keeps: one document of each component."""
    gone = near_dedup(docs, **settings).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
