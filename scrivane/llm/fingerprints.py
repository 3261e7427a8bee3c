"""Document fingerprints from closed syncmers.

A k-mer of UTF-8 bytes is an anchor if the least of its s-mers (by hash) stands at either end of
it. Whether a k-mer is an anchor depends on its own bytes alone, so an edit moves or changes only the anchors that it
touches. A fingerprint holds, as hexadecimal text, the length in bytes, how many anchors there are, and a bottom-k sketch of
them with their first positions: the `size` least hashes (64 bits each) and positions (32 bits each).

Two fingerprints are compared by position: of the least hashes of the union, those in both are matched; a match counts if
its shift (the difference of positions) is that of another match, or about that of a neighbour: the further apart the two, the more
edits may lie between them. So chance repeats at unrelated places don't count. With
the matched share j as an estimate of the Jaccard similarity, the likeness is 2j / (1 + j), the share of anchors that one
text has in common with the other.

`fingerprint_pairs` needs the next document, descending by doc_id. Documents go once, by ranges of doc_id that hold about
`block_bytes`, to a task each; the first document of a range is also sent to the range before it. Only range bounds,
a few numbers a range, pass through the driver, for at most RANGES ranges; a task sorts outside memory and streams its
range, so ranges may be larger than that.

Null text: as empty; its fingerprint has no anchors. Texts without a syncmer, as all shorter than k bytes and some shorter than
2k - s - 1: one anchor, the whole text, so they are like equal texts only. Equal texts have equal fingerprints; two empty ones have
likeness 1, an empty and another 0. A null doc_id comes after all others. Rows with one
doc_id are ordered by text, descending; if all rows are one document, it is its own next document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, text_bytes
from .textkernel import Texts, mix, range_hash, slices, texts_of

K, S, SIZE, BLOCK_BYTES, RANGES = 24, 8, 96, 16 << 20, 20_000
#: Two matches go together if their shifts differ by at most DRIFT bytes and SLOPE of their distance; a match is compared with NEXT on either side.
DRIFT, SLOPE, NEXT = 8, 0.125, 2
_U = np.uint64


def _grams(data: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash of every run of `width` (a multiple of 8) bytes."""
    n = len(data) - width + 1
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(eight).view(np.uint64).ravel()
    h = words[:n] ^ _U(salt)
    for k in range(8, width, 8):
        h = h * _U(0x9FB21C651E98DF25)
        h ^= h >> _U(35)
        h ^= words[k : k + n]
    return mix(h)


def anchors(texts: Texts, k: int = K, s: int = S) -> tuple[np.ndarray, ...]:
    """Hashes, texts' numbers and byte positions within the text of all closed syncmers, in order of position;
    of a text without any, the whole text."""
    d, o = texts.data, texts.offsets
    size = np.diff(o)
    out = []
    if len(d) >= k:
        small = _grams(d, s, 0x243F6A8885A308D3) >> _U(1)
        n, w = len(d) - k + 1, k - s + 1
        # Least of w s-mers by doubling: windows of 1, 2, 4, ... and a last overlapping step.
        least, span = small, 1
        while span * 2 <= w:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[w - span : w - span + n])
        at = np.flatnonzero((small[:n] == least) | (small[w - 1 : w - 1 + n] == least))
        text = np.searchsorted(o, at, "right") - 1
        inside = at + k <= o[text + 1]
        at, text = at[inside], text[inside]
        out.append((_kmer_hash(d, at, k), text, at - o[text]))
    none = size > 0
    if out:
        none[out[0][1]] = False
    short = np.flatnonzero(none)
    if len(short):
        out.append((range_hash(d, o[short], o[short + 1], 3), short, np.zeros(len(short), np.int64)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, text, at = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, text, at


def _kmer_hash(d: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(0, k, 8):
        word = np.zeros(len(at), np.uint64)
        for b in range(min(8, k - j)):
            word |= d[at + j + b].astype(np.uint64) << _U(8 * b)
        h = mix(h * _U(0x9FB21C651E98DF25) ^ word)
    return h


class Sketches:
    """Bottom-k sketches of n texts: hashes and positions in rows of `size`, ascending, with used counts; totals and lengths."""

    def __init__(self, texts: Texts, k: int, s: int, size: int):
        h, text, at = anchors(texts, k, s)
        n = texts.n
        self.size, self.lengths = size, np.diff(texts.offsets)
        # Hashes above a bound that surely exceeds the size-th least aren't sorted.
        count = np.bincount(text, minlength=n)
        bound = np.minimum(1.0, (2.0 * size + 40.0) / np.maximum(count, 1))
        low = (h >> _U(11)).astype(np.float64) * 2.0**-53 <= bound[text]
        total = np.zeros(n, np.int64)
        order = np.lexsort((at[low], h[low], text[low]))
        hs, ts, ps = h[low][order], text[low][order], at[low][order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
        hs, ts, ps = hs[new], ts[new], ps[new]
        first = np.searchsorted(ts, np.arange(n + 1))
        short = np.flatnonzero((first[1:] - first[:-1] < size) & (bound < 1.0))
        if len(short):  # a text with very many repeats of few anchors: all of its anchors
            again = np.isin(text, short)
            order = np.lexsort((at[again], h[again], text[again]))
            h2, t2, p2 = h[again][order], text[again][order], at[again][order]
            new = np.ones(len(h2), bool)
            new[1:] = (h2[1:] != h2[:-1]) | (t2[1:] != t2[:-1])
            rest = ~np.isin(ts, short)
            hs, ts, ps = (np.concatenate([x[rest], y[new]]) for x, y in ((hs, h2), (ts, t2), (ps, p2)))
            order = np.argsort(ts, kind="stable")
            hs, ts, ps = hs[order], ts[order], ps[order]
            first = np.searchsorted(ts, np.arange(n + 1))
        rank = np.arange(len(hs)) - first[ts]
        take = rank < size
        self.used = np.minimum(np.diff(first), size)
        self.hash = np.full((n, size), np.iinfo(np.uint64).max, np.uint64)
        self.at = np.zeros((n, size), np.uint32)
        self.hash[ts[take], rank[take]] = hs[take]
        self.at[ts[take], rank[take]] = np.minimum(ps[take], 0xFFFFFFFF)
        total[:] = count
        self.total = total

    def encoded(self) -> list[str]:
        out = []
        for k, n in enumerate(self.used.tolist()):
            head = np.array([self.lengths[k], self.total[k]], np.uint64).tobytes()
            out.append((head + self.hash[k, :n].tobytes() + self.at[k, :n].tobytes()).hex())
        return out

    def likeness(self, other: Sketches) -> np.ndarray:
        """Of each text here to the same row of other, from 0 to 1."""
        n, size = self.hash.shape
        out = np.zeros(n)
        top = np.iinfo(np.uint64).max
        h = np.concatenate([self.hash, other.hash], 1)
        p = np.concatenate([self.at, other.at], 1).astype(np.int64)
        order = np.argsort(h, 1, kind="stable")
        h, p = np.take_along_axis(h, order, 1), np.take_along_axis(p, order, 1)
        same = np.zeros((n, 2 * size), bool)
        same[:, :-1] = (h[:, 1:] == h[:, :-1]) & (h[:, :-1] != top)
        second = np.zeros_like(same)
        second[:, 1:] = same[:, :-1]
        unique = ~second & (h != top)
        # The union's least hashes: as many as the smaller sketch surely covers.
        among = np.cumsum(unique, 1)
        full = np.where((self.used == size) | (other.used == size), size, np.maximum(among[:, -1], 1))
        inside = unique & (among <= full[:, None])
        hit = same & inside
        r, c = np.nonzero(hit)
        key = np.lexsort((p[r, c], r))
        r, one, two = r[key], p[r, c][key], p[r, c + 1][key]
        shift = one - two
        few = np.bincount(r, minlength=n)[r] <= 4
        good = few
        # Edits move a shift little by little: a match counts if one of the NEXT matches on either side has about its shift,
        for k in range(1, NEXT + 1):
            ok = (r[k:] == r[:-k]) & (two[k:] > two[:-k]) & (np.abs(shift[k:] - shift[:-k]) <= DRIFT + SLOPE * (one[k:] - one[:-k]))
            good[k:] |= ok
            good[:-k] |= ok
        # or if any other has exactly its shift.
        key = np.lexsort((shift, r))
        equal = (r[key][1:] == r[key][:-1]) & (shift[key][1:] == shift[key][:-1])
        good[key[1:][equal]] = True
        good[key[:-1][equal]] = True
        matched = np.bincount(r[good], minlength=n)
        seen = np.maximum(inside.sum(1), 1)
        j = matched / seen
        out = 2 * j / (1 + j)
        both = (self.used == 0) & (other.used == 0)
        out[both] = 1.0
        return out


def half_starts(texts: Texts) -> tuple[np.ndarray, ...]:
    """Code points of each text, and the byte and code point offset of all leads: n_chars, lead positions, lead bounds."""
    leads = np.flatnonzero((texts.data & 0xC0) != 0x80)
    bounds = np.searchsorted(leads, texts.offsets)
    return np.diff(bounds), np.append(leads, len(texts.data)), bounds


def edited(texts: Texts, following: Texts) -> tuple[Texts, np.ndarray]:
    """Texts whose last floor(n/2) code points are replaced by the first as many of the following text; and n."""
    n, leads, bounds = half_starts(texts)
    m, leads2, bounds2 = half_starts(following)
    half = n // 2
    cut = leads[bounds[1:] - half]
    cut[half == 0] = texts.offsets[1:][half == 0]
    take = leads2[bounds2[:-1] + np.minimum(half, m)]
    take[half >= m] = following.offsets[1:][half >= m]
    a, b = texts.offsets[:-1], following.offsets[:-1]
    parts, size = [], (cut - a) + (take - b)
    one, two = texts.data, following.data
    for x, y, z, w in zip(a.tolist(), cut.tolist(), b.tolist(), take.tolist(), strict=True):
        parts += [one[x:y], two[z:w]]
    offsets = np.concatenate([[0], np.cumsum(size)])
    return Texts(np.concatenate(parts) if parts else np.zeros(0, np.uint8), offsets), n


def fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint) of every document: one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(Sketches(texts, k, s, size).encoded())], ["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _ranges(docs: DataFrame, n: int) -> list[tuple[int, int]]:
    """Least and greatest doc_id of at most n ranges of about equal counts, descending."""
    cuts = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] if n > 1 else []
    return sorted(set(cuts or []))


def fingerprint_pairs(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_ranges = min(blocks_for(spark, text_bytes(docs), block_bytes), RANGES)
    cuts = _ranges(docs.select("doc_id"), n_ranges)
    # Range r holds the ids between the cuts; descending order runs from the last range to range 0, then to the nulls (range -1).
    edges = [-math.inf, *map(float, cuts), math.inf]
    from pyspark.ml.feature import Bucketizer

    def ranged(df: DataFrame) -> DataFrame:
        df = df.withColumn("_id", F.col("doc_id").cast("double"))
        if len(edges) > 2:
            df = Bucketizer(splits=edges, inputCol="_id", outputCol="_range", handleInvalid="keep").transform(df)
            df = df.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_range").cast("int")))
        else:
            df = df.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
        return df.drop("_id", "_range")

    present = sorted(((r["range"], r["most"]) for r in ranged(docs.select("doc_id")).groupBy("range").agg(F.max("doc_id").alias("most")).collect()), reverse=True)
    order = [r for r, _ in present]
    before = {order[i]: order[i - 1] for i in range(len(order))}  # the first range's documents follow the last range's
    heads = {r: most for r, most in present}
    # A range's first documents, those with its greatest id, also go to the range before it.
    guest = F.lit(False)
    ids = sorted({m for m in heads.values() if m is not None})
    if ids:
        guest = F.col("doc_id").isin(ids)
    if -1 in heads:
        guest = guest | F.col("doc_id").isNull()
    where = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("range")] if before else F.col("range")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    visit = F.struct(where.alias("range"), F.lit(True).alias("guest"))
    placed = ranged(docs).withColumn("_to", F.explode(F.when(guest, F.array(own, visit)).otherwise(F.array(own)))).select("doc_id", "text", F.col("_to.range").alias("range"), F.col("_to.guest").alias("guest"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by range, guests last, then descending: a row's next document is the next row of its range.
        held: pa.RecordBatch | None = None
        for batch in batches:
            for part, _ in slices(batch):
                whole = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0] if held is not None else part
                yield from pairs(whole)
                held = whole.slice(whole.num_rows - 1)

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = np.asarray(rows.column(3).to_numpy(zero_copy_only=False), bool)
        group = rows.column(2).to_numpy()
        at = np.flatnonzero(~own[:-1] & (group[1:] == group[:-1]))
        if not len(at):
            return
        mine = texts_of(rows.column(1).take(pa.array(at)))
        following = texts_of(rows.column(1).take(pa.array(at + 1)))
        new, n_chars = edited(mine, following)
        a, b, c = (Sketches(t, k, s, size) for t in (mine, following, new))
        raw, o = new.data.tobytes(), new.offsets.tolist()
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0).take(pa.array(at)), pa.array(n_chars.astype(np.int64)),
                pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(o[:-1], o[1:], strict=True)]),
                pa.array(a.encoded()), pa.array(c.encoded()), pa.array(a.likeness(c)), pa.array(a.likeness(b)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    # Ranges go to tasks by their numbers: hashed, several could meet in one.
    low = order[-1] if order else 0
    sorted_ = placed.repartitionById((order[0] - low if order else 0) + 1, (F.col("range") - low).cast("int")).sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return sorted_.mapInArrow(run, schema)
