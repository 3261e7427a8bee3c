import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from scrivane.llm import common, fingerprints, near_dedup, piece_lattice, quality_rules, substring_dedup, token_counts
from scrivane.llm.textkernel import mix, texts_of

from . import odd

public = pytest.importorskip("public_tokenizers")
W = re.compile(r"[^\x20\x09-\x0D]+")


def split(t):
    return W.findall(t or "")


def same(rows, want):
    assert Counter(tuple(r) for r in rows) == Counter(want)


# Token counts


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    path, ranks = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
    library = Tokenizer.from_file(path)
    rows = [*odd.texts(), (30, "end <|endoftext|> of"), (31, "x" * 600 + " y" * 600)]
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    df = odd.frame(spark, rows)
    same(token_counts.token_counts(df, path, ranks, public.PATTERN).collect(), want)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second call finds all counts in the cache
        same(token_counts.token_counts(df, path, cache=cache).collect(), want)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    more = [*rows, (32, "a text that is new")]
    folder = cache + "/version=" + token_counts.tokenizer_version(path)
    spark.createDataFrame([(bytearray(hashlib.sha256(b"one").digest()), 77)], token_counts._CACHED).write.parquet(str(tmp_path / "known") + "/version=" + token_counts.tokenizer_version(path))
    files = len(list(Path(folder).glob("*.parquet")))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd.frame(spark, more), path, cache=cache).collect()}
    assert got[32] == 5 and spark.read.parquet(cache).count() == len({t or "" for _, t in more}) and len(list(Path(folder).glob("*.parquet"))) > files
    # A stored count is taken as it is, so the join is what gives it; another tokenizer's isn't.
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path, cache=str(tmp_path / "known")).collect()}
    assert got[11] == 77 and got[12] == 2
    other = public.path("word_bpe_49k.json")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, other, cache=str(tmp_path / "known")).collect()}[11] == 1
    assert token_counts.token_counts(odd.frame(spark, []), path).count() == 0


def test_both_tokenizers_agree_on_every_plain_character():
    path = public.path("byte_bpe_50k.json")
    fast = token_counts.counter(path, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    slow = token_counts.counter(path)
    plain = [chr(c) for c in range(0x3000) if token_counts._PLAIN.fullmatch(chr(c))]
    assert len(plain) > 600
    texts = [f"a{c}1 {c}{c} b{c} {c}a  {c} '{c}s {c}\n{c}" for c in plain]
    assert fast(texts) == slow(texts)


# Sampled pieces


def brute_sample(model, text, key):
    """One text at a time, by dictionaries."""
    if not text:
        return []
    pieces = {s: k for k, s in enumerate(model.surface) if s and not (len(s) == 1 and model.byte_piece[s[0]] == k)}
    raw = b" " + text.encode()
    out = []
    u64 = np.uint64
    for place, m in enumerate(re.finditer(rb" *[^ ]+| +$", raw)):
        chunk = m.group()
        edges = [[] for _ in range(len(chunk) + 1)]
        ends = [k for k in range(1, len(chunk) + 1) if k == len(chunk) or chunk[k] & 0xC0 != 0x80]
        for a in [0, *ends[:-1]]:
            nxt = min(e for e in ends if e > a)
            for b in ends:
                if b > a and chunk[a:b] in pieces:
                    edges[b].append((a, pieces[chunk[a:b]]))
            if chunk[a:nxt] not in pieces:
                for k in range(a, nxt):
                    edges[k + 1].append((k, int(model.byte_piece[chunk[k]])))
        alpha = np.full(len(chunk) + 1, -np.inf)
        alpha[0] = 0
        for b in range(1, len(chunk) + 1):
            if edges[b]:
                alpha[b] = np.logaddexp.reduce([alpha[a] + model.weight[p] for a, p in edges[b]])
        seed = mix(np.array([key], u64) + u64(place * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        got, at, step = [], len(chunk), 0
        while at:
            u = float((mix(seed + u64(step * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> u64(11))[0]) * 2.0**-53
            total = 0.0
            choice = sorted(edges[at])
            for a, p in choice:
                total += np.exp(alpha[a] + model.weight[p] - alpha[at])
                if u < total or (a, p) == choice[-1]:
                    got.append(p)
                    at = a
                    break
            step += 1
        out += got[::-1]
    return out


def test_sampling_equals_brute_force():
    model = piece_lattice.lattice(public.path("piece_bpe_32k.model"))
    texts = ["", " ", "a  b ", "there is a café", "x▁y", "日本語\n\t😀 ok", odd.words(3, 50), "Zürich über alles zz"]
    keys = mix(np.arange(len(texts)).astype(np.uint64))
    ids, offsets = model.sample(texts_of(pa.array(texts)), keys)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == brute_sample(model, t, keys[k]), t


def test_sampled_pieces_are_lossless_and_reproducible(spark):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    df = odd.frame(spark)
    rows = piece_lattice.sampled_pieces(df, path).collect()
    assert len(rows) == len(odd.texts()) and all(r.lossless and r.n_pieces == len(r.pieces) for r in rows)
    text = {i: t for i, t in odd.texts() if i is not None and i != 13}
    for r in rows:
        if r.doc_id in text and len(text[r.doc_id] or "") < 10_000:
            assert library.decode(list(r.pieces)) == (text[r.doc_id] or "")
    again = piece_lattice.sampled_pieces(df.repartition(3), path).collect()
    same([(r.doc_id, tuple(r.pieces)) for r in again], [(r.doc_id, tuple(r.pieces)) for r in rows])
    assert piece_lattice.sampled_pieces(odd.frame(spark, []), path).count() == 0


def test_sampling_follows_the_lattice():
    model = piece_lattice.lattice(public.path("piece_bpe_32k.model"))
    n = 4000
    ids, o = model.sample(texts_of(pa.array(["there"] * n)), mix(np.arange(n).astype(np.uint64)))
    share = Counter(tuple(ids[o[k] : o[k + 1]]) for k in range(n)).most_common(1)[0][1] / n
    assert 0.62 < share < 0.71  # 0.665 by enumeration


# Quality rules


def brute_quality(t, least=10, covered=0.3, longest=150):
    w = split(t)
    n = len(w)

    def union(k):
        c = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return len({p for i in range(n - k + 1) if c[tuple(w[i : i + k])] > 1 for p in range(i, i + k)})

    lines = [x for x in (t or "").split("\n") if W.search(x)]
    tri, ten = union(3), union(least)
    best = next((k - 1 for k in range(1, n + 1) if len({tuple(w[i : i + k]) for i in range(n - k + 1)}) == n - k + 1), 0)
    failed = n < 50 or 100 * tri > 50 * n
    return (n, sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), tri, failed, not failed and ten <= covered * n and best <= longest, ten, best > longest, best)


def test_quality_rules(spark):
    rows = [*odd.texts(), (40, "a | b # c\n" * 3 + odd.words(9, 60)), (41, odd.words(10, 200) + " " + odd.words(10, 200)), (42, odd.words(11, 100) + " " + " ".join(odd.words(11, 100).split()[:12]))]
    rows = [r for r in rows if len(r[1] or "") < 50_000 or r[0] == 16]
    same(quality_rules.quality_rules(odd.frame(spark, rows)).collect(), [(i, *brute_quality(t)) for i, t in rows])
    kept = quality_rules.keep_good(odd.frame(spark, rows))
    assert kept.columns == odd.frame(spark, []).columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for i, t in rows if brute_quality(t)[6]])
    assert quality_rules.quality_rules(odd.frame(spark, [])).count() == 0


def test_longest_repeats_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes = rng.integers(0, 25, 4)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        tokens = rng.integers(0, 3, bounds[-1])
        got = quality_rules.longest_repeats(mix(tokens.astype(np.uint64) + np.uint64(1)), np.repeat(np.arange(4), sizes), bounds)
        for t in range(4):
            w = tokens[bounds[t] : bounds[t + 1]].tolist()
            for i in range(len(w)):
                want = max((k for j in range(len(w)) if j != i for k in range(len(w) - max(i, j), 0, -1) if w[i : i + k] == w[j : j + k]), default=0)
                assert got[bounds[t] + i] == want


# Fingerprints


def test_fingerprints(spark):
    rows = [r for r in odd.texts() if r[0] != 13]
    out = fingerprints.fingerprint_pairs(odd.frame(spark, rows), block_bytes=20_000).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    same([(r.doc_id, r.n_chars, r.edited_sha256) for r in out], want)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[5].fingerprint == by[9].fingerprint and all(0 <= x <= 1 for r in out for x in (r.near_edited, r.near_next))
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(odd.frame(spark, rows)).collect() if r.doc_id is not None}
    assert all(plain[i] == by[i].fingerprint for i in by)
    assert fingerprints.fingerprint_pairs(odd.frame(spark, [])).count() == 0
    one = fingerprints.fingerprint_pairs(odd.frame(spark, [(1, "abcdef")])).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abcabc").hexdigest()]


def test_closed_syncmers_are_context_free():
    a, b = odd.words(20, 60), odd.words(21, 60)
    h1, _, at1 = fingerprints.anchors(texts_of(pa.array([a])))
    h2, _, at2 = fingerprints.anchors(texts_of(pa.array([b + a])))
    size = len(b.encode())
    later = [(h, p - size) for h, p in zip(h2.tolist(), at2.tolist(), strict=True) if p >= size]
    assert later == list(zip(h1.tolist(), at1.tolist(), strict=True))


def test_texts_without_a_syncmer_have_an_anchor():
    rows = [odd.words(3000 + k, 30)[: 20 + k % 25] for k in range(400)] + ["x" * 30]
    assert len(set(rows)) == len(rows)
    fresh = lambda x: fingerprints.Sketches(texts_of(pa.array(x)), 24, 8, 96)
    s = fresh(rows)
    assert (s.used > 0).all() and len(set(s.encoded())) == len(rows)
    assert (s.likeness(s) == 1).all() and (s.likeness(fresh([""] * len(rows))) == 0).all()
    same_length = {}
    for t in (t for t, n in zip(rows, s.used, strict=True) if n == 1 and len(t.encode()) >= 24):
        same_length.setdefault(len(t.encode()), []).append(t)
    pairs = [(g[0], t) for g in same_length.values() for t in g[1:]]
    assert len(pairs) > 20 and (fresh([a for a, _ in pairs]).likeness(fresh([b for _, b in pairs])) < 1).all()
    assert (fresh(["", ""]).likeness(fresh(["", "a"])) == [1, 0]).all()


def test_likeness_follows_the_shared_part():
    base = odd.words(22, 800)
    cut = len(base) // 2
    other = odd.words(23, 800)
    s = fingerprints.Sketches(texts_of(pa.array([base] * 3)), 24, 8, 96)
    t = fingerprints.Sketches(texts_of(pa.array([base, base[:cut] + other[:cut], other])), 24, 8, 96)
    same_, half, none = s.likeness(t)
    assert same_ == 1 and 0.35 < half < 0.65 and none < 0.1


def test_likeness_of_long_texts_with_scattered_edits():
    r = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz "
    fresh = lambda n: "".join(r.choices(letters, k=n))
    texts, new, kept = [], [], []
    for n, edits in ((60_000, 150), (100_000, 250), (1_000_000, 2500)) * 3:
        t, cuts = fresh(n), sorted(r.sample(range(n), edits))
        parts = [t[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        out = parts[0]
        for k, part in enumerate(parts[1:]):
            out += fresh(r.randint(1, 9)) + part if k % 4 else part[r.randint(1, 9) :]
        texts.append(t)
        new.append(out)
        a, b = (set(fingerprints.anchors(texts_of(pa.array([x])))[0].tolist()) for x in (t, out))
        kept.append(2 * len(a & b) / (len(a) + len(b)))
    s, t = (fingerprints.Sketches(texts_of(pa.array(x)), 24, 8, 96) for x in (texts, new))
    got = s.likeness(t)
    assert np.abs(got - kept).max() < 0.1 and abs(np.mean(got - kept)) < 0.03
    # Sentences that both texts have, in another order, are chance repeats; two halves that change places aren't.
    some = [fresh(40) for _ in range(60)]
    one, two = ("".join(fresh(900) + x for x in r.sample(some, 60)) for _ in range(2))
    swapped = texts[0][30_000:] + texts[0][:30_000]
    s, t = (fingerprints.Sketches(texts_of(pa.array(x)), 24, 8, 96) for x in ([one, texts[0]], [two, swapped]))
    chance, halves = s.likeness(t)
    assert chance < 0.05 and halves > 0.95


# Substring dedup


def brute_removed(rows, width=13):
    least = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = {p for k in range(len(w) - width + 1) if i is not None and least[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        out.append((i, len(w), len(gone), [x for p, x in enumerate(w) if p not in gone]))
    return out


@pytest.mark.parametrize("block", [3_000, 8 << 20])
def test_substring_dedup(spark, block):
    rows = odd.texts()
    want = [(i, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, g, k in brute_removed(rows)]
    same(substring_dedup.substring_dedup(odd.frame(spark, rows), block_bytes=block).collect(), want)


def test_substring_dedup_keeps_columns_and_whole_texts(spark):
    rows = odd.texts()
    df = odd.frame(spark, rows)
    out = substring_dedup.drop_repeats(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    want = [(i, " ".join(k) if g else t) for (i, t), (_, _, g, k) in zip(rows, brute_removed(rows), strict=True)]
    same([(r.doc_id, r.text) for r in out.collect()], want)
    assert substring_dedup.drop_repeats(odd.frame(spark, [])).count() == 0


def test_the_sketch_never_underestimates():
    """Cells of blocks' windows: a window that two blocks have is answered as repeated whatever its cells."""
    sketch = substring_dedup.Sketch(200, 1, 2, 1)
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    blocks = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(3)]
    data = [substring_dedup._pack(*(np.diff(np.sort(sketch.cell(b, r)), prepend=0).astype(np.uint32) for r in range(2))) for b in blocks]
    table = pa.table({"shard": pa.array([0] * 3, pa.int32()), "block": pa.array([0, 1, 2], pa.int64()), "data": pa.array(data)})
    for b, answer in zip(blocks, substring_dedup._merge(sketch)(None, table).column("data").to_pylist(), strict=True):
        estimate = np.ones(len(b), bool)
        for r, bits in enumerate(substring_dedup._unpack(answer)):
            order = np.argsort(sketch.cell(b, r), kind="stable")
            flags = np.empty(len(b), bool)
            flags[order] = np.unpackbits(bits, count=len(b)).astype(bool)
            estimate &= flags
        assert estimate[np.isin(b, shared)].all()


# Near duplicates


def brute_near(rows):
    sets = []
    for i, t in rows:
        w = split(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and 100 * len(x & y) >= 85 * len(x | y):
                p, q = root(rows[a][0]), root(rows[b][0])
                parent[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else root(i) if s else i, i is None or (root(i) if s else i) == i) for (i, _), s in zip(rows, sets, strict=True)]


def test_near_dedup(spark):
    rows = odd.texts()
    same(near_dedup.near_dedup(odd.frame(spark, rows)).collect(), brute_near(rows))
    kept = near_dedup.keep_one(odd.frame(spark, rows))
    assert kept.columns == odd.frame(spark, []).columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for (i, t), b in zip(rows, brute_near(rows), strict=True) if b[3]])


def test_near_dedup_shuffles_few_texts(spark, monkeypatch):
    """Of 2,000 texts, 100 have a copy but for one word: no more than these, and one in 16 of the others or so, go to the join by id."""
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(k, text(40)) for k in range(1900)]
    rows += [(10_000 + k, t + " end") for k, t in rows[:100]]
    seen = []
    whole = near_dedup.possible

    def spy(docs, column, ids, n_ids):
        out = whole(docs, column, ids, n_ids)
        seen.append((column, docs.count(), ids.count(), out.count()))
        return out

    monkeypatch.setattr(near_dedup, "possible", spy)
    got = near_dedup.near_dedup(odd.frame(spark, rows)).collect()
    assert sum(not x["kept"] for x in got) == 100 and len(got) == 2000
    (column, n, some, out), *later = seen
    assert column == "doc_id" and n == 2000 and 200 <= some <= 300 and some <= out <= some + 300
    # Each round asks for the registers of both sides, then for the sets.
    assert {c for c, *_ in later} == {"a", "b"} and all(k <= out <= k + n // 4 for _, n, k, out in later)


def test_possible_rows_hold_all_that_are_asked(spark):
    rows = odd.frame(spark, [(None, "x"), *[(k * 7919 - 5_000, f"t{k}") for k in range(3000)], (-5_000, "again")])
    for asked in ([], [-5_000], [k * 7919 - 5_000 for k in range(0, 3000, 10)], [5]):
        ids = spark.createDataFrame([(k,) for k in asked], "rep long")
        want = Counter(r for r in rows.collect() if r["doc_id"] in set(asked))
        for bits in (64, 1 << 26):
            out = common.possible(rows, "doc_id", ids, len(asked), bits)
            assert out.columns == rows.columns and want <= (got := Counter(out.collect())), (len(asked), bits)
            assert bits == 64 or sum(got.values()) <= sum(want.values()) + 600


@pytest.mark.parametrize("chunk", [50_000, 6])
def test_near_dedup_chains_and_false_friends(spark, chunk):
    """Chains of small edits, members just under the threshold, and a group whose members aren't all alike; with chunk 6 components,
    buckets and leaders are salted."""
    rows, n = [], 100
    for g in range(3):
        w = odd.words(100 + g, 150).split()
        for k in range(25):
            rows.append((n, " ".join(w)))
            n += 1
            w = list(w)
            for _ in range(1 + (k % 3) * 2):
                w[(k * 37 + len(w[0])) % 150] = f"e{k}{g}"
                w[(k * 53) % 150] = f"f{k}{g}"
    rows = rows[::-1]
    same(near_dedup.near_dedup(odd.frame(spark, rows), chunk=chunk).collect(), brute_near(rows))
    assert near_dedup.near_dedup(odd.frame(spark, [])).count() == 0
    assert near_dedup.near_dedup(odd.frame(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_contraction_of_a_hot_component(spark):
    """A star, a path and a ring, with and without salts."""
    links = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 315)] + [(k, 400 + (k - 399) % 12) for k in range(400, 412)] + [(5, 5), (0, 1)]
    want = {k: 0 for k in range(200)} | {k: 300 for k in range(300, 316)} | {k: 400 for k in range(400, 412)}
    for chunk in (50_000, 20):
        got = near_dedup.contract(spark.createDataFrame(links, "a long, b long"), chunk)
        assert {r.node: r.comp for r in got.collect()} == want
    assert near_dedup.contract(spark.createDataFrame([(1, 1)], "a long, b long")) is None


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 1 << 63, 850, dtype=np.uint64)
    a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 75, dtype=np.uint64)]) for _ in range(2))
    ra, rb = (near_dedup.registers(x, np.zeros(len(x), int), 1, 1024) for x in (a, b))
    both = near_dedup.registers(np.concatenate([a, b]), np.zeros(len(a) + len(b), int), 1, 1024)
    assert (np.maximum(ra, rb) == both).all()
    best, over = near_dedup.joint_estimate(ra, rb, np.array([925.0]), np.array([925.0]), 0.85)
    assert abs(best[0] - 0.85) < 0.05 and over[0] < near_dedup.DOUBT


def test_links_at_the_threshold_are_hardly_ever_dropped():
    """Twice the log likelihood ratio is about chi-square with one degree; only estimates below the threshold are dropped."""
    assert math.erfc(math.sqrt(near_dedup.DOUBT)) / 2 < 1e-8
