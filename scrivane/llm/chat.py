"""Chat formatting with minimum-cost role repair.

A legal conversation is a path of an automaton: system or user at first, user after system, assistant after user, user
after assistant, and an end after user or assistant. Each turn keeps its role or is relabelled, and then starts a new turn, with
empty turns inserted before it as the automaton needs, or is merged into the turn before it if that has its role. Dynamic
programming over the four states finds a repair of least total cost; among equal ones, read from the last turn back, the lower state (start, system, user, assistant)
wins at each step. Every turn is then rendered: the pieces of a conversation, concatenated in order, are its text.

One step of the programme is a min-plus product with one of four 4 x 4 matrices, so a conversation can be cut anywhere. Turns are
range-partitioned by (conv_id, turn), which also cuts a conversation that holds a third of all rows. Pieces that touch a partition's edge, at most
two a partition, are put together in a tree of tasks: the products of up to ARITY pieces of a conversation in one task, those of its
groups in the next, and back down the costs with which each piece begins; then in the same way
their trace-backs, as maps of states, and the state in which each ends. Nothing passes through the driver.

Null role or one that isn't system, user or assistant (case and outer spaces aside): must be relabelled. Null text: empty. Turns without conv_id
form one conversation. A null turn comes first; ties in turn are ordered by role, then text, then the order of equal rows doesn't
matter. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, store

ROLES = ("", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, INSERT, PART_BYTES, ARITY = 1.0, 2.0, 3.0, 16 << 20, 4096
OPEN, CLOSE, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n"


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The roles to insert on the shortest way from a state to a new turn of a role."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for s in range(4):
        front: list[tuple[int, ...]] = [(e,) for e in NEXT[s]]
        while front:
            new = []
            for path in front:
                if (s, path[-1]) not in out:
                    out[s, path[-1]] = path[:-1]
                    new += [(*path, e) for e in NEXT[path[-1]]]
            front = new
    return out


class Repair:
    """The matrices of a cost setting. step[r, s, e]: least cost of a turn of role r (0: none) from state s to state e."""

    def __init__(self, merge: float = MERGE, relabel: float = RELABEL, insert: float = INSERT):
        self.paths = _paths()
        self.merged = np.zeros((4, 4), bool)
        self.step = np.full((4, 4, 4), np.inf)
        for s in range(4):
            for e in range(1, 4):
                new = insert * len(self.paths[s, e]) if (s, e) in self.paths else np.inf
                joined = merge if s == e else np.inf
                self.merged[s, e] = joined <= new and joined < np.inf
                for r in range(4):
                    self.step[r, s, e] = min(joined, new) + (0.0 if r == e else relabel)
        self.end = np.array([0.0, insert, 0.0, 0.0])  # a system turn needs an empty user turn after it

    def forward(self, role: np.ndarray, start: np.ndarray, size: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs after each piece and, for each turn and state, the state before. v: costs before each piece."""
        v, back = v.copy(), np.zeros((len(role), 4), np.uint8)
        live = np.flatnonzero(size > 0)
        j = 0
        while len(live):
            at = start[live] + j
            ways = v[live][:, :, None] + self.step[role[at]]
            back[at] = ways.argmin(1)
            v[live] = ways.min(1)
            j += 1
            live = live[size[live] > j]
        return v, back

    def backward(self, back: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """States before and after each turn, and before each piece. state: after each piece."""
        before, after = np.zeros(len(back), np.uint8), np.zeros(len(back), np.uint8)
        state = state.astype(np.uint8).copy()
        live = np.flatnonzero(size > 0)
        j = 1
        while len(live):
            at = start[live] + size[live] - j
            after[at] = state[live]
            before[at] = state[live] = back[at, state[live]]
            j += 1
            live = live[size[live] >= j]
        return before, after, state


def _pieces(conv: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list]:
    """Begins and sizes of the runs of equal conv_id, and their ids."""
    null = np.asarray(conv.is_null())
    value = conv.fill_null(0).to_numpy()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(value))), [None if null[i] else int(value[i]) for i in start]


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.argsort(rows.column("pos").to_numpy(), kind="stable")))


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    """A table of Python rows, by a schema of simple types."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    names = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(names)})


def _ordered(rows: pa.Table, by: str) -> list[dict]:
    return sorted(rows.to_pylist(), key=lambda r: r[by])


def _then(v: np.ndarray, m: list[float]) -> np.ndarray:
    """Costs v, or a matrix of them, after a piece with matrix m."""
    return (v[..., :, None] + np.array(m).reshape(4, 4)).min(-2)


_START = (0.0, np.inf, np.inf, np.inf)
_CONV = "none boolean, conv long"
_PIECE = f"part int, piece int, {_CONV}, block int"


def _begins(edges: DataFrame, deep: bool) -> DataFrame:
    """Of pieces (part, piece, none, conv, block, m) those that are continued or continue: with v, the costs before them, and which they are.
    deep: a conversation may have pieces in several blocks."""
    product, prefix, out = f"{_CONV}, block int, m array<double>", f"{_CONV}, block int, v array<double>, before boolean, after boolean", f"{_PIECE}, v array<double>, goes_on boolean"

    def products(key, rows):
        m = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
        for r in _ordered(rows, "part"):
            m = _then(m, r["m"])
        return _rows(product, [(*(k.as_py() for k in key), m.ravel().tolist())])

    def prefixes(key, rows):
        v, found = np.array(_START), _ordered(rows, "block")
        done = []
        for k, r in enumerate(found):
            done.append((r["none"], r["conv"], r["block"], v.tolist(), k > 0, k + 1 < len(found)))
            v = _then(v, r["m"])
        return _rows(prefix, done)

    def begins(key, pieces, above):
        top, found = above.to_pylist()[0], _ordered(pieces, "part")
        v, done = np.array(top["v"]), []
        for k, r in enumerate(found):
            before, after = top["before"] or k > 0, top["after"] or k + 1 < len(found)
            if before or after:
                done.append((r["part"], r["piece"], r["none"], r["conv"], r["block"], v.tolist(), after))
            v = _then(v, r["m"])
        return _rows(out, done)

    by = ["none", "conv", "block"]
    if not deep:
        alone = pa.table({"v": [list(_START)], "before": [False], "after": [False]})
        return edges.groupBy(*by).applyInArrow(lambda key, pieces: begins(key, pieces, alone), out)
    above = edges.groupBy(*by).applyInArrow(products, product).groupBy("none", "conv").applyInArrow(prefixes, prefix)
    return edges.groupBy(*by).cogroup(above.groupBy(*by)).applyInArrow(begins, out)


def _finishes(pieces: DataFrame, deep: bool) -> DataFrame:
    """Of traced pieces (part, piece, none, conv, block, v, goes_on, best, ways) the states in which they end: (part, piece, v, goes_on, state)."""
    whole, suffix, out = f"{_CONV}, block int, best int, ways array<int>", f"{_CONV}, block int, state int", "part int, piece int, v array<double>, goes_on boolean, state int"

    def composed(key, rows):
        found = _ordered(rows, "part")[::-1]
        state = [0, 1, 2, 3]
        for r in found:
            state = [r["ways"][e] for e in state]
        return _rows(whole, [(*(k.as_py() for k in key), found[0]["best"], state)])

    def suffixes(key, rows):
        found, done = _ordered(rows, "block")[::-1], []
        state = found[0]["best"]
        for r in found:
            done.append((r["none"], r["conv"], r["block"], state))
            state = r["ways"][state]
        return _rows(suffix, done)

    def finishes(key, rows, above):
        found, done = _ordered(rows, "part")[::-1], []
        state = above.to_pylist()[0]["state"] if above is not None else found[0]["best"]
        for r in found:
            done.append((r["part"], r["piece"], r["v"], r["goes_on"], state))
            state = r["ways"][state]
        return _rows(out, done)

    by = ["none", "conv", "block"]
    if not deep:
        return pieces.groupBy(*by).applyInArrow(lambda key, rows: finishes(key, rows, None), out)
    above = pieces.groupBy(*by).applyInArrow(composed, whole).groupBy("none", "conv").applyInArrow(suffixes, suffix)
    return pieces.groupBy(*by).cogroup(above.groupBy(*by)).applyInArrow(finishes, out)


def repair_chats(turns: DataFrame, merge: float = MERGE, relabel: float = RELABEL, insert: float = INSERT, part_bytes: int = PART_BYTES, arity: int = ARITY) -> DataFrame:
    """Per turn, in the order of (conv_id, turn): conv_id, turn, role, new_role, action, n_inserted (empty turns before it, and
    for the last turn of a conversation also one that may be needed after it), rendered."""
    spark, plan = turns.sparkSession, Repair(merge, relabel, insert)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = F.lower(F.trim("role"))
    code = F.when(name == "system", 1).when(name == "user", 2).when(name == "assistant", 3).otherwise(0).cast("int")
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long") + 32)).first()[0] or 0
    key = ["conv_id", "turn", "role", "text"]
    tie = F.xxhash64("role", "text")
    n_parts = blocks_for(spark, n_bytes, part_bytes)
    in_order = rows.withColumn("tie", tie).repartitionByRange(n_parts, "conv_id", "turn", "tie").sortWithinPartitions(*key[:2], "tie", *key[2:])
    placed = in_order.withColumn("code", code).withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()).drop("tie")
    placed = store(placed, "turns")
    small = placed.select("part", "pos", "conv_id", "code").groupBy("part")

    edge = f"{_PIECE}, m array<double>"

    def edges(key, table):
        table = _sorted(table)
        part = key[0].as_py()
        start, size, ids = _pieces(table.column("conv_id"))
        role = table.column("code").to_numpy()
        out = []
        for i in sorted({0, len(start) - 1}):
            one = role[start[i] : start[i] + size[i]]
            v = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
            m, _ = plan.forward(np.tile(one, 4), np.arange(4) * len(one), np.full(4, len(one)), v)
            out.append((part, i, ids[i] is None, ids[i] or 0, part // arity, m.ravel().tolist()))
        return _rows(edge, out)

    # Up to ARITY partitions need one level of the tree; then each table of pieces is read once and isn't stored.
    deep = n_parts > arity
    kept = (lambda df, tag: store(df, tag)) if deep else (lambda df, tag: df)
    cut = _begins(kept(small.applyInArrow(edges, edge), "chat-edges"), deep)
    traced_ = f"{_PIECE}, v array<double>, goes_on boolean, best int, ways array<int>"

    def traced(key, table, known):
        out = []
        if table.num_rows and known.num_rows:
            table = _sorted(table)
            start, size, _ = _pieces(table.column("conv_id"))
            role = table.column("code").to_numpy()
            for r in known.to_pylist():
                i = r["piece"]
                one = role[start[i] : start[i] + size[i]]
                v, back = plan.forward(one, np.zeros(1, int), size[i : i + 1], np.array([r["v"]]))
                ways = [int(plan.backward(back, np.zeros(1, int), size[i : i + 1], np.array([e]))[2][0]) for e in range(4)]
                out.append((r["part"], i, r["none"], r["conv"], r["block"], r["v"], r["goes_on"], int((v[0] + plan.end).argmin()), ways))
        return _rows(traced_, out)

    ends_at = _finishes(kept(small.cogroup(cut.groupBy("part")).applyInArrow(traced, traced_), "chat-traces"), deep)

    def render(key, table, known):
        if not table.num_rows:
            return _rendered([], [], [], table, np.zeros(0, np.uint8))
        table = _sorted(table)
        start, size, _ = _pieces(table.column("conv_id"))
        role = table.column("code").to_numpy()
        known = known.to_pylist()
        v0 = np.tile(_START, (len(start), 1))
        for r in known:
            v0[r["piece"]] = r["v"]
        v, back = plan.forward(role, start, size, v0)
        state = (v + plan.end).argmin(1)
        for r in known:
            state[r["piece"]] = r["state"]
        before, after, _ = plan.backward(back, start, size, state)
        ends = np.zeros(len(role), bool)
        ends[start + size - 1] = True
        if any(r["goes_on"] and r["piece"] == len(start) - 1 for r in known):
            ends[-1] = False
        actions, inserted, rendered = [], [], []
        for s, e, r, last, text in zip(before.tolist(), after.tolist(), role.tolist(), ends.tolist(), table.column("text").to_pylist(), strict=True):
            merged = plan.merged[s, e]
            made = () if merged else plan.paths[s, e]
            out = JOINT if merged else (CLOSE if s else "") + "".join(OPEN.format(ROLES[x]) + CLOSE for x in made) + OPEN.format(ROLES[e])
            out += text
            n = len(made)
            if last:
                out += CLOSE
                if e == 1:
                    out += OPEN.format(ROLES[2]) + CLOSE
                    n += 1
            actions.append(("relabel" if r != e else "keep") + ("+merge" if merged else ""))
            inserted.append(n)
            rendered.append(out)
        return _rendered(actions, inserted, rendered, table, after)

    schema = "conv_id long, turn long, role string, new_role string, action string, n_inserted int, rendered string"
    rows = placed.select("part", "pos", "conv_id", "turn", "role", "code", "text")
    return rows.groupBy("part").cogroup(ends_at.groupBy("part")).applyInArrow(render, schema)


def _rendered(actions: list[str], inserted: list[int], rendered: list[str], table: pa.Table, after: np.ndarray) -> pa.Table:
    names = np.array(ROLES, object)[after]
    return pa.table({"conv_id": table.column("conv_id"), "turn": table.column("turn"), "role": table.column("role"), "new_role": pa.array(names.tolist(), pa.string()), "action": pa.array(actions, pa.string()), "n_inserted": pa.array(inserted, pa.int32()), "rendered": pa.array(rendered, pa.string())})
