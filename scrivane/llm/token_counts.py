"""Token counts through a digest cache.

The cache is a Parquet table (version, digest, n_tokens), a folder a version: version is the SHA-256 of the tokenizer file, digest the SHA-256
of the normalised text. Each distinct text whose digest is not in the cache is encoded once and appended; every document
then takes its count from the cache. It lies in the shared folder and outlives a run. Files are appended by Spark's commit, so a
run that dies adds nothing; two runs at once may both add a digest, with one count.

Normalisation must not change counts, so it is the tokenizer's own: a byte-level model has none, and a text is then
normalised by being itself. Copies are folded on the map side before the texts are shuffled by digest, so a text that a
third of all rows share reaches its reducer once a task.

Counting: the byte-level model's pre-tokens are found by its published pattern and merged by a rank table of the same
vocabulary, which is about four times as fast as the tokenizers library; texts with characters outside a range over which
the tests compare the two libraries code point by code point go to the tokenizers library itself. Special strings inside a text are one token
each, the library's default.

Null text: as empty (0 bytes, 0 tokens). Repeated rows and null doc_ids are counted row by row. Very long texts are encoded
whole. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, shared_dir, store, table_exists
from .textkernel import IS_WORD, Texts, Words, classes, range_hash

#: Characters over which both libraries split alike: up to Latin Extended-B, general punctuation and currency signs.
_PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞₠-₿]*")
#: The first byte of characters from U+0240 on: texts without any such byte are plain.
_WIDE = 0xC9
CACHE, _CACHED = "token-cache", "digest binary, n_tokens long"
_counters: dict[tuple[str, str | None], Callable[[list[str]], list[int]]] = {}


def tokenizer_version(*paths: str) -> str:
    """The digest of a tokenizer's file; counts of another file never match."""
    h = hashlib.sha256()
    for p in paths:
        h.update(Path(p).read_bytes())
    return h.hexdigest()


def counter(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[list[str]], list[int]]:
    """Counts as the library for the file gives them; ranks_path names the same vocabulary as a rank table, if there is one."""
    if (path, ranks_path) in _counters:
        return _counters[path, ranks_path]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        def slow(texts: list[str]) -> list[int]:
            return [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

        count = slow
        if ranks_path and pattern:
            import tiktoken

            lines = Path(ranks_path).read_bytes().splitlines()
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            specials = [x["content"] for x in json.loads(Path(path).read_text())["added_tokens"]]

            def count(texts: list[str]) -> list[int]:
                out, hard = [0] * len(texts), []
                for k, t in enumerate(texts):
                    if _PLAIN.fullmatch(t) and not any(s in t for s in specials):
                        out[k] = len(fast.encode_ordinary(t))
                    else:
                        hard.append(k)
                for k, n in zip(hard, slow([texts[k] for k in hard]), strict=True):
                    out[k] = n
                return out

            sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            sizes[list(ranks.values())] = [len(b) for b in ranks]

            def joined(pieces: list[bytes]) -> np.ndarray | None:
                """Counts of pieces by one call over all of them: no pre-token goes on from one into the next. None if that doesn't hold."""
                text = b"".join(pieces).decode()
                if any(s in text for s in specials):
                    return None
                ends = np.cumsum(sizes[fast.encode_to_numpy(text, disallowed_special=())])
                to = np.cumsum([len(b) for b in pieces])
                n = np.searchsorted(ends, to, "right")
                return np.diff(n, prepend=0) if len(to) and np.array_equal(ends[n - 1], to) else None

            count.joined = joined

    _counters[path, ranks_path] = count
    return count


def _blank_inside(texts: Texts) -> np.ndarray:
    """Which texts have white space beyond ASCII."""
    d = texts.data
    at = np.flatnonzero(np.isin(d, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)))
    far = np.concatenate([d, np.zeros(2, np.uint8)])
    a, b, c = d[at], far[at + 1], far[at + 2]
    wide = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    wide |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    out = np.zeros(texts.n, bool)
    out[np.searchsorted(texts.offsets, at[wide], "right") - 1] = True
    return out


class WordCounter:
    """Counts of a byte-level model word by word: much faster where words repeat, and used where counts are weights.

    Pre-tokens never go on from a word into the white space after it, so a text's count is the sum over its words, each with the
    white space before it, and the white space at its end. Each distinct one is encoded once a slice, and kept by its hash (64 bits) for later
    slices, up to `most`. Those that begin with white space and have no characters but Latin ones are encoded by one call, where a token's length says
    whose it is. Texts with other white space than ASCII's are counted as wholes.
    """

    def __init__(self, count: Callable[[list[str]], list[int]], most: int = 1 << 20):
        self.count, self.most = count, most
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _encoded(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw, d = texts.data.tobytes(), texts.data
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = np.zeros(len(pieces), np.int64)
        one = np.ones(len(pieces), bool)
        if len(pieces) and (joined := getattr(self.count, "joined", None)):
            wide = np.zeros(len(d) + 1, np.int32)
            np.cumsum(d >= _WIDE, out=wide[1:])
            one = IS_WORD[d[starts]] | ~IS_WORD[d[ends - 1]] | (wide[ends] > wide[starts])
            at = np.flatnonzero(~one)
            if (found := joined([pieces[k] for k in at.tolist()])) is None:
                one[:] = True
            else:
                n[at] = found
        at = np.flatnonzero(one)
        n[at] = self.count([pieces[k].decode("utf-8", "replace") for k in at.tolist()])
        return n

    def of(self, texts: Texts, words: Words) -> np.ndarray:
        d, o = texts.data, texts.offsets
        whole = _blank_inside(texts)
        # Words with the white space before them, and what is left at the end of each text.
        ends = np.sort(np.concatenate([words.ends, o[1:]]), kind="stable")
        starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]]) if len(ends) else ends
        some = ends > starts
        starts, ends = starts[some], ends[some]
        text = np.searchsorted(o, starts, "right") - 1
        if whole.any():
            some = ~whole[text]
            starts, ends, text = starts[some], ends[some], text[some]
        h = range_hash(d, starts, ends, 2)
        first, of = classes(h)
        distinct = h[first]
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        n = np.zeros(len(distinct), np.int64)
        if known.any():
            n[known] = self.n[at[known]]
        new = np.flatnonzero(~known)
        n[new] = self._encoded(texts, starts[first[new]], ends[first[new]])
        if len(self.keys) + len(new) > self.most:
            self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        elif len(new):
            new = new[np.argsort(distinct[new], kind="stable")]
            to = np.searchsorted(self.keys, distinct[new])
            self.keys, self.n = np.insert(self.keys, to, distinct[new]), np.insert(self.n, to, n[new])
        out = np.bincount(text, weights=n[of], minlength=texts.n)[: texts.n].astype(np.int64)
        for k in np.flatnonzero(whole).tolist():
            out[k] = self.count([d[o[k] : o[k + 1]].tobytes().decode()])[0]
        return out


def count_texts(distinct: DataFrame, path: str, ranks_path: str | None, pattern: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return distinct.mapInArrow(run, _CACHED)


def token_counts(docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, limit: int = 512, cache: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and whether these exceed `limit`.

    cache: path of the cache table to read from and append to, by default CACHE in the shared folder.
    """
    spark = docs.sparkSession
    folder = f"{cache or shared_dir(spark) + '/' + CACHE}/version={tokenizer_version(path)}"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # first() keeps one text a digest and is merged on the map side.
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    if table_exists(spark, folder):
        distinct = distinct.join(spark.read.schema(_CACHED).parquet(folder).select("digest"), "digest", "left_anti")
    count_texts(distinct.select("digest", "text"), path, ranks_path, pattern).write.mode("append").parquet(folder)
    # Of the cache only this run's digests are kept; copies that raced into it from two runs have equal counts.
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    copies = store(rows.groupBy("digest").agg(F.count("*").alias("n")), "digests")
    counted = spark.read.schema(_CACHED).parquet(folder).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    joined = salted_join(rows, counted, "digest", copies, docs.count(), "doc_id")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
