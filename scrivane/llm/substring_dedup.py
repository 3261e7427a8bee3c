"""Substring deduplication: windows of 13 words that also start in a document with a smaller doc_id are removed.

Documents are shuffled once, into blocks. Blocks and hash shards then exchange messages of a few bytes a window:

1. Each block sends its distinct windows as cells of a count-min sketch, cut into shards by hash so that no task and no
   broadcast ever holds all of it. A shard merges the blocks' sketches and answers, one bit a cell, which cells another
   block fills too. A window's estimate is the least over its rows: never below the truth, so no repeat is lost.
2. Windows estimated as repeated, and those that a block itself has in two documents, go to the shards again, now as
   96-bit hashes with the least doc_id in the block. A shard groups them exactly and answers with the windows whose least
   doc_id lies in another block.
3. Each block marks the words to go and writes its documents' results.

A block sends each distinct window once, however often it occurs, so a window that a third of all rows hold costs one
entry a block. All three steps read the same exchange of documents; its blocks are sized in bytes.

Null text: no words. A null doc_id is neither smaller nor larger than another: such rows lose nothing and take nothing from
others, and aren't shuffled. Rows with one doc_id take nothing from each other. Repeated rows stay. Texts under 13 words have no window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import blocks_for, shuffle_parts, text_bytes
from .textkernel import Words, cover, release, slices, texts_of, window_hash

WIDTH, BLOCK_BYTES, DEPTH, CELLS_PER_WINDOW = 13, 4 << 20, 2, 4
#: Windows a shard of the sketch has; a shard's task decodes them at 8 bytes each.
SHARD_WINDOWS = 4 << 20
_U = np.uint64
_SALT = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
_MESSAGE = "shard int, block long, data binary"
_REPLY = "shard int, block long, data binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64).tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    return zstandard.compress(head + kinds + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 + 8 * n + 4 * n, []
    for k in range(n):
        kind = np.dtype(raw[8 + 8 * n + 4 * k : 12 + 8 * n + 4 * k].decode().strip())
        out.append(np.frombuffer(raw, kind, int(sizes[k]), at))
        at += int(sizes[k]) * kind.itemsize
    return out


class Block:
    """The windows of a block's documents. distinct: sorted hashes; of: for each window its place among them.

    What is kept is 32 bits a word or window wherever a block's size allows, and hashes go as soon as they are sorted.
    """

    def __init__(self, rows: pa.Table, width: int):
        release()
        self.ids = rows.column("doc_id").combine_chunks()
        self.words: Words = texts_of(rows.column("text")).words()
        self.width = width
        narrow = np.int32 if len(self.words.texts.data) < 1 << 31 else np.int64
        self.words.starts, self.words.ends = self.words.starts.astype(narrow), self.words.ends.astype(narrow)
        known = np.repeat(np.asarray(self.ids.is_valid()), self.words.counts)
        at = self.words.windows(width).astype(narrow)
        self.at = at[known[at]] if len(at) else at
        del at, known
        h = window_hash(self.words.hashes(0), self.at, width)
        self.order = np.argsort(h, kind="stable").astype(narrow)
        h = h[self.order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.head = np.flatnonzero(new).astype(narrow)
        self.distinct = h[self.head]
        del h
        self.of = np.empty(len(new), narrow)
        self.of[self.order] = np.cumsum(new, dtype=narrow) - 1
        if len(new):
            o = self.owner()[self.order]
            self.least = np.minimum.reduceat(o, self.head)
            self.many = np.maximum.reduceat(o, self.head) > self.least
        else:
            self.least, self.many = np.zeros(0, np.int64), np.zeros(0, bool)

    def owner(self) -> np.ndarray:
        """The doc_id of each window."""
        return np.repeat(np.asarray(self.ids.fill_null(0)).astype(np.int64), self.words.counts)[self.at]

    def second(self, chosen: np.ndarray) -> np.ndarray:
        """A second hash of the chosen distinct windows, from another hash of their words."""
        at = self.at[self.order[self.head[chosen]]]
        by = np.argsort(at, kind="stable")
        out = np.empty(len(at), np.uint32)
        out[by] = window_hash(self.words.hashes(2), at[by], self.width, 1) >> _U(32)
        return out


class Sketch:
    """The layout of a sharded count-min sketch: the shard and, in each row, the cell of a hash."""

    def __init__(self, n_windows: int, shards: int, depth: int, per_window: int):
        self.shards, self.depth = shards, depth
        self.cells = 1 << max(10, int(per_window * max(1, n_windows) // shards).bit_length())

    def shard(self, h: np.ndarray) -> np.ndarray:
        return ((h >> _U(40)) % _U(self.shards)).astype(np.int64)

    def cell(self, h: np.ndarray, row: int) -> np.ndarray:
        return (((h * _U(_SALT[row])) >> _U(24)) % _U(self.cells)).astype(np.int64)

    def split(self, h: np.ndarray) -> list[np.ndarray]:
        """For each shard, the places of its hashes, in order."""
        s = self.shard(h).astype(np.uint16 if self.shards < 65536 else np.int64)
        order = np.argsort(s, kind="stable")
        return np.split(order, np.searchsorted(s[order], np.arange(1, self.shards)))


def _sketches(sketch: Sketch, width: int):
    def run(key, rows):
        block, out = Block(rows, width), []
        for shard, at in enumerate(sketch.split(block.distinct)):
            if len(at):
                h = block.distinct[at]
                out.append((shard, _pack(*(np.diff(np.sort(sketch.cell(h, r)), prepend=0).astype(np.uint32) for r in range(sketch.depth)))))
        return pa.table({"shard": pa.array([s for s, _ in out], pa.int32()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})

    return run


def _merge(sketch: Sketch):
    def run(key, rows):
        data = rows.column("data").to_pylist()
        answers: list[list[np.ndarray]] = [[] for _ in data]
        for r in range(sketch.depth):
            counts, decoded = np.zeros(sketch.cells, np.uint8), []
            for d in data:
                cells = np.cumsum(_unpack(d)[r].astype(np.int64))
                own = cells[np.concatenate([[True], cells[1:] != cells[:-1]])]
                counts[own] = np.minimum(counts[own], 253) + 1  # blocks that fill the cell; 2 is all that matters
                twice = cells[1:][cells[1:] == cells[:-1]]
                counts[twice] = np.maximum(counts[twice], 2)  # two windows of one block: the sketch can't tell them apart
                decoded.append(cells)
            for k, cells in enumerate(decoded):
                answers[k].append(np.packbits(counts[cells] > 1))
        return pa.table({"shard": rows.column("shard"), "block": rows.column("block"), "data": pa.array([_pack(*a) for a in answers], pa.binary())})

    return run


def _candidates(sketch: Sketch, width: int):
    def run(key, rows, replies):
        out: list[tuple[int, bytes]] = []
        if rows.num_rows:
            block = Block(rows, width)
            said = dict(zip(replies.column("shard").to_pylist(), replies.column("data").to_pylist(), strict=True))
            chosen = block.many.copy()
            parts = sketch.split(block.distinct)
            for shard, at in enumerate(parts):
                if len(at):
                    estimate = np.ones(len(at), bool)
                    for r, bits in enumerate(_unpack(said[shard])):
                        cells = sketch.cell(block.distinct[at], r)
                        order = np.argsort(cells, kind="stable")
                        flags = np.empty(len(at), bool)
                        flags[order] = np.unpackbits(bits, count=len(at)).astype(bool)
                        estimate &= flags
                    chosen[at] |= estimate
            picked = np.flatnonzero(chosen)
            second = block.second(picked)
            for shard, at in enumerate(sketch.split(block.distinct[picked])):
                if len(at):
                    least = block.least[picked[at]]
                    low = least.min()
                    out.append((shard, _pack(block.distinct[picked[at]], second[at], np.array([low]), (least - low).astype(np.uint64))))
        return pa.table({"shard": pa.array([s for s, _ in out], pa.int32()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})

    return run


def _group(key, rows):
    parts = [_unpack(d) for d in rows.column("data").to_pylist()]
    h = np.concatenate([p[0] for p in parts])
    g = np.concatenate([p[1] for p in parts])
    least = np.concatenate([p[3].astype(np.int64) + p[2][0] for p in parts])
    sender = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((g, h))
    hs, gs = h[order], g[order]
    head = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])]))
    lowest = np.repeat(np.minimum.reduceat(least[order], head), np.diff(np.append(head, len(hs))))
    gone = order[least[order] > lowest]
    gone = gone[np.argsort(sender[gone], kind="stable")]
    cuts = np.split(gone, np.searchsorted(sender[gone], np.arange(1, len(parts))))
    return pa.table({"shard": rows.column("shard"), "block": rows.column("block"), "data": pa.array([_pack(np.sort(h[c])) for c in cuts], pa.binary())})


def _remove(width: int, texts: bool):
    def run(key, rows, replies):
        block = Block(rows, width)
        lists = [_unpack(d)[0] for d in replies.column("data").to_pylist()]
        always = np.zeros(len(block.distinct), bool)
        if lists and len(always):
            want = np.concatenate(lists)
            found = np.minimum(np.searchsorted(block.distinct, want), len(always) - 1)
            always[found[block.distinct[found] == want]] = True
        gone = always[block.of] | (block.owner() > block.least[block.of]) if len(block.at) else np.zeros(0, bool)
        words, at = block.words, block.at[gone]
        del block
        removed = cover(len(words.starts), at, width)
        cuts = np.concatenate([[0], np.cumsum(removed)])
        n_removed = (cuts[words.bounds[1:]] - cuts[words.bounds[:-1]]).astype(np.int64)
        data, offsets = words.join(~removed)
        raw = memoryview(data)
        base = {"n_words": pa.array(words.counts.astype(np.int64)), "n_removed": pa.array(n_removed)}
        if texts:
            new = pa.LargeStringArray.from_buffers(len(n_removed), pa.py_buffer(offsets), pa.py_buffer(data))
            old = rows.column("text").combine_chunks().cast(pa.large_string())
            return pa.table({"row": rows.column("row"), "n_removed": base["n_removed"], "kept_text": pc.if_else(pa.array(n_removed > 0), new, old).cast(pa.string())})
        digests = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.table({"doc_id": rows.column("doc_id")} | base | {"kept_sha256": pa.array(digests, pa.string())})

    return run


def _rounds(docs: DataFrame, n_bytes: int, width: int, depth: int, per_window: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Documents by block, and for each block the lists of windows that it must drop. docs: doc_id (not null), text and others."""
    spark = docs.sparkSession
    n_blocks, n_windows = blocks_for(spark, n_bytes, block_bytes), n_bytes // 6
    parts = shuffle_parts(spark) if n_blocks <= 4 * shuffle_parts(spark) else n_blocks // 2
    sketch = Sketch(n_windows, max(shuffle_parts(spark), math.ceil(n_windows / SHARD_WINDOWS)), depth, per_window)
    # Rows with one doc_id may lie in several blocks; only the same row repeated lies in one.
    by_block = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("long")).repartition(parts, "block")
    cells = by_block.groupBy("block").applyInArrow(_sketches(sketch, width), _MESSAGE)
    replies = cells.groupBy("shard").applyInArrow(_merge(sketch), _REPLY)
    candidates = by_block.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_candidates(sketch, width), _MESSAGE)
    return by_block, candidates.groupBy("shard").applyInArrow(_group, _REPLY)


def _untouched(docs: DataFrame) -> DataFrame:
    """Results for rows with a null doc_id, which lose nothing: one scan, wherever the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                words = texts.words()
                data, o = words.join(np.ones(len(words.starts), bool))
                raw = memoryview(data)
                digests = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                n = pa.array(words.counts.astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(np.zeros(len(n), np.int64)), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.mapInArrow(run, _RESULT)


def substring_dedup(docs: DataFrame, width: int = WIDTH, depth: int = DEPTH, per_window: int = CELLS_PER_WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_block, gone = _rounds(docs.where("doc_id IS NOT NULL"), text_bytes(docs), width, depth, per_window, block_bytes)
    out = by_block.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_remove(width, False), _RESULT)
    return out.unionByName(_untouched(docs.where("doc_id IS NULL")))


def drop_repeats(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with its own columns, without the repeated words: a text that loses words becomes its kept words joined by one
    space; others stay as they are, white space included. A text that loses all its words becomes empty. n_chars, where
    there is such a column, follows the new text."""
    names = docs.columns
    rest = [c for c in names if c != "text"]
    full = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("row"))
    by_block, gone = _rounds(full, text_bytes(docs), width, DEPTH, CELLS_PER_WINDOW, block_bytes)
    schema = StructType([StructField("row", full.schema["row"].dataType), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    out = by_block.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_remove(width, True), schema)
    new = {"text": F.col("kept_text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    out = out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in names])
    return out.unionByName(docs.where("doc_id IS NULL").withColumn("text", F.col("text").cast("string")))
