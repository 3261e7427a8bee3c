"""Sampled segmentation into SentencePiece pieces, and lossless decoding.

A text, with a space put before it, is cut into chunks: a run of spaces and the run of other characters after it. No piece
of the vocabulary has a space after another character, so the piece lattice of a text is the product of its chunks'
lattices. Forward filtering sums over all segmentations that reach a node; backward sampling then draws, from the end of
a chunk, each piece in proportion to the filtered mass at its start times its own probability. The draws are hashes of the row
key, the chunk's place and the step, so a row is segmented alike in any run, batch or partition.

The vocabulary is of the BPE kind: its scores are merge ranks, not log-probabilities. A piece of rank r has the weight
(r + 8) ** -alpha; a larger alpha prefers frequent, hence often longer pieces. Characters without a piece are
spelled in byte pieces, as is a literal U+2581, so decoding gives the text back byte for byte.

Chunks that occur several times in a slice of text share one lattice; all passes are vectorised over chunks, and
nothing is shuffled.

Null text: as empty, which has no pieces. A null doc_id takes the hash of the text as its key. Equal rows get equal
segmentations. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import Texts, mix, range_hash, slices

ALPHA, SLICE_BYTES = 2.0, 1 << 20
_U = np.uint64
_lattices: dict[tuple[str, float], Lattice] = {}


class Lattice:
    """A vocabulary as a byte trie with weights."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.surface: list[bytes] = [b""] * n
        self.byte_piece = np.full(256, -1, np.int32)
        weight = np.full(n, -np.inf)
        nodes: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k in range(n):
            if model.is_byte(k):
                b = int(model.id_to_piece(k)[3:5], 16)
                self.byte_piece[b], self.surface[k] = k, bytes([b])
                weight[k] = -alpha * np.log(n + 8.0)
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.surface[k] = model.id_to_piece(k).replace("▁", " ").encode()
                weight[k] = -alpha * np.log(8.0 - model.get_score(k))
                at = 0
                for b in self.surface[k]:
                    to = nodes[at].get(b)
                    if to is None:
                        to = nodes[at][b] = len(nodes)
                        nodes.append({})
                        ends.append(-1)
                    at = to
                ends[at] = k
        # Nodes with children come first, and all others share one empty row: a row is 256 node numbers, half as wide where these are few.
        order = sorted(range(len(nodes)), key=lambda i: not nodes[i])
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        self.inner = sum(map(bool, nodes))
        self.next = np.zeros((self.inner + 1, 256), np.uint16 if len(nodes) <= 1 << 16 else np.int32)
        for i, m in enumerate(nodes):
            for b, to in m.items():
                self.next[place[i], b] = place[to]
        self.ends = np.array(ends, np.int32)[order]
        self.weight = weight
        self.lengths = np.array([len(s) for s in self.surface], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces in the chunks: first byte, end and piece. ends: for each byte, where its chunk ends."""
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        found, single = [], np.zeros(len(data), bool)
        lead = np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 1)))
        k = 0
        while len(at):
            node = self.next[np.minimum(node, self.inner), data[at + k]]
            live = node > 0
            at, node = at[live], node[live]
            k += 1
            piece = self.ends[node]
            hit = piece >= 0
            found.append((at[hit], at[hit] + k, piece[hit]))
            one = at[hit]
            single[one[lead[one] == k]] = True
            more = at + k < ends[at]
            at, node = at[more], node[more]
        # Bytes of a character that is no piece by itself: the character's first byte decides for all of them.
        is_lead = (data & 0xC0) != 0x80
        head = np.maximum.accumulate(np.where(is_lead, np.arange(len(data)), 0))
        spelled = np.flatnonzero(~single[head])
        found.append((spelled, spelled + 1, self.byte_piece[data[spelled]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def filtered(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the chunks that make up data: pointers into the edges by end node, their starts, pieces and cumulative draws.

        Node p + 1 + c is the end of byte p of chunk c; node starts[c] + c is the chunk's begin.
        """
        chunk = np.repeat(np.arange(len(starts)), ends - starts)
        src, dst, piece = self.edges(data, ends[chunk])
        c = chunk[src]
        depth = dst - starts[c]
        order = np.lexsort((src, c, depth))
        src, dst, piece, c, depth = src[order] + c[order], dst[order] + c[order], piece[order], c[order], depth[order]
        w = self.weight[piece]
        alpha = np.full(len(data) + len(starts) + 1, -np.inf)
        alpha[starts + np.arange(len(starts))] = 0.0
        share = np.empty(len(src))
        head = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(dst)))
        level = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]])) if len(dst) else np.zeros(1, np.int64)
        group = np.searchsorted(head, level)
        for k in range(len(level) - 1):
            a, b, ga, gb = level[k], level[k + 1], group[k], group[k + 1]
            mass = alpha[src[a:b]] + w[a:b]
            h, s = head[ga:gb] - a, size[ga:gb]
            top = np.maximum.reduceat(mass, h)
            top[top == -np.inf] = 0.0
            part = np.exp(mass - np.repeat(top, s))
            total = np.add.reduceat(part, h)
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha[dst[head[ga:gb]]] = top + np.log(total)
                share[a:b] = part / np.repeat(total, s)
        # Cumulated within each node, one place at a time: sums don't depend on what else is in the slice.
        for j in range(1, int(size.max(initial=1))):
            at = head[size > j] + j
            share[at] += share[at - 1]
        share[head + size - 1] = 2.0
        first = np.zeros(len(alpha) + 1, np.int64)
        first[dst[head]] = head
        return first, src, piece, share

    def sample(self, texts: Texts, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, and n + 1 offsets."""
        o = texts.offsets
        full = o[1:] > o[:-1]
        # A space before every text that isn't empty.
        shift = np.concatenate([[0], np.cumsum(full)])
        data = np.full(len(texts.data) + int(shift[-1]), 32, np.uint8)
        offsets = o + shift
        data[np.arange(len(texts.data)) + np.repeat(shift[1:], np.diff(o))] = texts.data
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(texts.n + 1, np.int64)
        cut = np.zeros(len(data), bool)
        cut[offsets[:-1][full]] = True
        space = data == 32
        cut[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        owner = np.searchsorted(offsets, starts, "right") - 1
        place = np.arange(len(starts)) - np.searchsorted(starts, offsets[owner])
        _, kind_at, kind = np.unique(range_hash(data, starts, ends, 3), return_index=True, return_inverse=True)
        size = (ends - starts)[kind_at]
        kind_ends = np.cumsum(size)
        kind_starts = kind_ends - size
        own = np.repeat(starts[kind_at] - kind_starts, size) + np.arange(int(kind_ends[-1]))
        first, src, piece, share = self.filtered(data[own], kind_starts, kind_ends)
        node = (kind_ends + np.arange(len(kind_ends)))[kind]
        begin = (kind_starts + np.arange(len(kind_ends)))[kind]
        seed = mix(keys[owner] + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        active = np.arange(len(starts))
        drawn, step = [], 0
        counts = np.zeros(len(starts), np.int64)
        while len(active):
            u = (mix(seed + _U(step * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> _U(11)).astype(np.float64) * 2.0**-53
            e = first[node]
            todo = np.flatnonzero(u >= share[e])
            while len(todo):
                e[todo] += 1
                todo = todo[u[todo] >= share[e[todo]]]
            drawn.append((active, piece[e]))
            counts[active] += 1
            node = src[e]
            more = node > begin
            active, node, begin, seed = active[more], node[more], begin[more], seed[more]
            step += 1
        to = np.cumsum(counts)
        ids = np.empty(int(to[-1]), np.int32)
        for k, (a, p) in enumerate(drawn):
            ids[to[a] - 1 - k] = p
        ids_at = np.concatenate([[0], to])
        return ids, ids_at[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> Texts:
        """The texts that piece ids spell, without the space put before each."""
        size = self.lengths[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.repeat(self.offsets[ids] - end[:-1], size) + np.arange(int(end[-1]))]
        bounds = end[offsets]
        full = bounds[1:] > bounds[:-1]
        keep = np.ones(len(data), bool)
        keep[bounds[:-1][full]] = False
        return Texts(data[keep], bounds - np.concatenate([[0], np.cumsum(full)]))


def lattice(path: str, alpha: float = ALPHA) -> Lattice:
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattice(path, alpha)
    return _lattices[path, alpha]


def row_keys(ids: pa.Array, texts: Texts) -> np.ndarray:
    """The seed of each row: from its doc_id, or from its text where that is null."""
    key = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64) + _U(0x632BE59BD9B4E019))
    missing = np.asarray(ids.is_null())
    if missing.any():
        key[missing] = range_hash(texts.data, texts.offsets[:-1], texts.offsets[1:], 2)[missing]
    return key


def same_texts(a: Texts, b: Texts) -> np.ndarray:
    if np.array_equal(a.offsets, b.offsets) and np.array_equal(a.data, b.data):
        return np.ones(a.n, bool)
    return np.array([a.data[a.offsets[k] : a.offsets[k + 1]].tobytes() == b.data[b.offsets[k] : b.offsets[k + 1]].tobytes() for k in range(a.n)], bool)


def sampled_pieces(docs: DataFrame, path: str, alpha: float = ALPHA) -> DataFrame:
    """Per document: doc_id, n_pieces, the sampled piece ids, and whether decoding them gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, alpha)
        for batch in batches:
            for part, texts in slices(batch, limit=SLICE_BYTES):
                ids, offsets = model.sample(texts, row_keys(part.column(0), texts))
                lossless = same_texts(texts, model.decode(ids, offsets))
                pieces = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pieces, pa.array(lossless)], ["doc_id", "n_pieces", "pieces", "lossless"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pieces long, pieces array<int>, lossless boolean")
