"""Quality rules from repetition: suffix arrays over words and their longest-common-prefix intervals.

For every text, all suffixes of its word sequence are sorted by prefix doubling. The longest common prefix that a suffix
has with a neighbour is the length of the longest repeat that begins there; the intervals of that array are the maximal
repeated substrings. Their spans of at least `min_repeat` words are united. A text is rejected if the united spans cover
more than `max_covered` of its words, or if its longest repeat is of more than `max_longest` words. Occurrences of a repeat may
overlap. Everything is computed inside one scan; nothing is shuffled.

Null text: as empty, no words. Fewer than 50 words fail the base rule, so empty texts are not kept. Repeated rows give
repeated results, and a null doc_id is passed through. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import Texts, Words, cover, in_text, range_hash, slices

MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.3, 150
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, n_covered long, longest_over boolean, longest_repeat long"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def longest_repeats(hashes: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeat within its text that begins there (0: none).

    Level k ranks the runs of 2**k words. Only runs that are still tied go to the next level, so the work after the first
    levels is that of the repeated part.
    """
    n = len(hashes)
    end = bounds[1:][text]
    keys = in_text(hashes, text, len(bounds) - 1)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    # A group's rank is the place at which it begins, so ranks stay comparable when only some groups are split further.
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    levels = [rank.copy()]
    width = 1
    while True:
        sizes = np.diff(np.append(head, n))
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any():
            break
        slot = np.flatnonzero(tied)
        at = order[slot]
        nxt = at + width
        second = np.where(nxt < end[at], rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[at]))
        at, second = at[by], second[by]
        first = rank[at]
        order[slot] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        start = slot[new]
        rank[at] = np.repeat(start, np.diff(np.append(np.flatnonzero(new), len(at))))
        heads = np.zeros(n, bool)
        heads[head] = True
        heads[start] = True
        head = np.flatnonzero(heads)
        width *= 2
        levels.append(rank.copy())
        if width > n:
            break
    lcp = np.zeros(n + 1, np.int64)  # of neighbours in suffix order
    if n:
        a, b = order[:-1], order[1:]
        live = np.flatnonzero(levels[0][a] == levels[0][b])
        a, b = a[live], b[live]
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + length, b + length
            ok = (x < end[a]) & (y < end[b])
            r = levels[k]
            same = ok & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)]) & (x + (1 << k) <= end[a]) & (y + (1 << k) <= end[b])
            length[same] += 1 << k
        lcp[live + 1] = length
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(lcp[:-1], lcp[1:]) if n else 0
    return out


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values)])
    return c[bounds[1:]] - c[bounds[:-1]]


def dup_lines(texts: Texts, words: Words) -> np.ndarray:
    d, o = texts.data, texts.offsets
    if not len(d):
        return np.zeros(texts.n, np.int64)
    cut = np.zeros(len(d) + 1, bool)
    cut[o] = True
    cut[1:] |= d == 10
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], len(d))
    ends = ends - (d[ends - 1] == 10)
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has], ends[has]
    text = np.searchsorted(o, starts, "right") - 1
    keys = np.sort(in_text(range_hash(d, starts, ends, 1), text, texts.n))
    again = np.flatnonzero(keys[1:] == keys[:-1])
    bits = max(1, int(texts.n - 1).bit_length())
    return np.bincount((keys[again] >> np.uint64(64 - bits)).astype(np.int64), minlength=texts.n)


def measure(texts: Texts, min_repeat: int, max_covered: float, max_longest: int) -> dict[str, np.ndarray]:
    words = texts.words()
    n = words.counts.astype(np.int64)
    repeat = longest_repeats(words.hashes(), words.text_of(), words.bounds)

    def covered(least: int) -> np.ndarray:
        at = np.flatnonzero(repeat >= least)
        return _sum_by(cover(len(repeat), at, repeat[at]), words.bounds)

    longest = np.zeros(texts.n, np.int64)
    np.maximum.at(longest, words.text_of(), repeat)
    tri, spans = covered(3), covered(min_repeat)
    base_failed = (n < 50) | (100 * tri > 50 * n)
    in_words = np.ones(len(texts.data), bool)
    in_words &= (texts.data & 0xC0) != 0x80
    in_words &= ~np.isin(texts.data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    return {
        "n_words": n,
        "word_chars": texts.per_text(in_words),
        "n_symbols": texts.per_text(_SYMBOL[texts.data]),
        "n_dup_lines": dup_lines(texts, words),
        "n_repeat_words": tri,
        "base_failed": base_failed,
        "kept": ~base_failed & (spans <= max_covered * n) & (longest <= max_longest),
        "n_covered": spans,
        "longest_over": longest > max_longest,
        "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document with its counts, the base verdict, the repetition measures and `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), **{k: pa.array(v) for k, v in measure(texts, min_repeat, max_covered, max_longest).items()}})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The rows of docs, all columns, whose text passes the rules: the verdict is a column computed along the scan."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                kept = measure(texts, rules.get("min_repeat", MIN_REPEAT), rules.get("max_covered", MAX_COVERED), rules.get("max_longest", MAX_LONGEST))["kept"]
                yield part.filter(pa.array(kept))

    return docs.select(*names).mapInArrow(run, docs.schema)
