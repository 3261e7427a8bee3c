import hashlib
import itertools
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from scrivane.llm import chat, common, mixing, quality_model, textkernel, token_counts, warc
from scrivane.llm.queries import counting_tokenizer
from scrivane.llm.textkernel import texts_of

from . import odd

# Chat


def brute_repair(roles, plan):
    """The cheapest states of one conversation, turn by turn, with the same rule for ties."""
    v = [0.0, np.inf, np.inf, np.inf]
    back = []
    for r in roles:
        ways = [[v[s] + plan.step[r, s, e] for s in range(4)] for e in range(4)]
        back.append([min(range(4), key=lambda s, w=w: (w[s], s)) for w in ways])
        v = [min(w) for w in ways]
    state = min(range(4), key=lambda e: (v[e] + plan.end[e], e))
    cost, out = v[state] + plan.end[state], []
    for b in reversed(back):
        out.append((b[state], state))
        state = b[state]
    return cost, out[::-1]


def cheapest(roles, plan):
    """By trying all label sequences."""
    best = np.inf
    for states in itertools.product(range(1, 4), repeat=len(roles)):
        cost, s = 0.0, 0
        for r, e in zip(roles, states, strict=True):
            cost += plan.step[r, s, e]
            s = e
        best = min(best, cost + plan.end[s])
    return best


CODE = {"system": 1, "user": 2, "assistant": 3}


def conversations(seed=0):
    r = random.Random(seed)
    rows = []
    for c in range(30):
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["system", "user", "assistant", "User ", "tool", None]), r.choice(["hi", "", None, "é" * 5]), "x"))
    rows += [(None, t, r.choice(["user", "assistant"]), "n", "x") for t in range(5)] + [(99, None, "user", "null turn", "x"), (99, 1, "assistant", "b", "x"), (98, 1, "user", "same", "x"), (98, 1, "user", "same", "x")]
    rows += [(1000, t, r.choice(["system", "user", "assistant", "odd"]), odd.words(t, 5), "x") for t in range(400)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, part string"


@pytest.mark.parametrize(("part", "arity"), [(1_000, 4096), (1_000, 2), (16 << 20, 4096)])
def test_role_repair(spark, part, arity):
    """Conversations over many partitions, whose pieces are put together in one group or in groups of two."""
    plan = chat.Repair()
    rows = conversations()
    out = chat.repair_chats(spark.createDataFrame(rows, SCHEMA), part_bytes=part, arity=arity).collect()
    assert len(out) == len(rows)
    spoken = {}
    for r in out:
        spoken.setdefault(r.conv_id, []).append(r)
    for c, turns in spoken.items():
        if c != 98:  # its equal rows are alike; the others have an order
            turns = sorted(turns, key=lambda r: (r.turn is not None, r.turn or 0))
            roles = [CODE.get((r.role or "").strip().lower(), 0) for r in turns]
            _, want = brute_repair(roles, plan)
            assert [CODE[r.new_role] for r in turns] == [e for _, e in want], c
            assert [r.action.endswith("+merge") for r in turns] == [bool(plan.merged[s, e]) for s, e in want]
            said = "".join(r.rendered for r in turns)
            order = [x.split("\n")[0] for x in said.split("<|im_start|>")[1:]]
            assert said.count("<|im_end|>\n") == len(order) and order[-1] in ("user", "assistant")
            assert all(b in {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[a] for a, b in zip(["", *order], order, strict=False))
    assert chat.repair_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repair_costs_are_minimal():
    plan = chat.Repair()
    r = random.Random(1)
    for _ in range(40):
        roles = [r.randint(0, 3) for _ in range(r.randint(1, 6))]
        assert brute_repair(roles, plan)[0] == cheapest(roles, plan)


# WARC


def pages():
    return [(3, "http://www.Example.com:80/a b?q=1#f", "<p>one</p>", 1), (1, "https://example.com/a", "<p>one</p>", 1), (2, None, None, 1), (4, "x", "", 1), (5, "http://a.b.c.org:8080", "é" * 9000, 1), (None, "http://10.0.0.1/z", "<p>one</p>", 1), (6, "ü r l", "z", 1), (6, "ü r l", "z", 1), (7, "http://[bad", "z", 1)]


PAGES = "page_id long, url string, html string, sha1 int"


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = pages()
    out = warc.archive_round_trip(spark.createDataFrame(rows, PAGES), least).collect()
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        first = min((j for j, _, g, _ in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = i is not None and len(raw) >= least and first != i
        want.append((i, len(raw), warc.payload_digest(raw), "revisit" if revisit else "response", first if revisit else None))
    assert Counter(map(tuple, out)) == Counter(want)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_index_look_up(spark):
    rows = [*pages(), *[(100 + k, f"http://h{k % 7}.example.net/p{k % 50}", f"body {k % 90}", 1) for k in range(500)]]
    folder = common.work_dir(spark, "warc-test")
    records = warc.write_archives(spark.createDataFrame(rows, PAGES), folder, file_bytes=4_000)
    directory = warc.write_index(records, f"{folder}-index", block_lines=10)
    index = warc.Index(f"{folder}-index", warc.Index.parts_of(directory), held=1)
    assert directory.agg({"lines": "sum"}).first()[0] == len(rows) and directory.count() > 40 and len(index.files) > 1
    for r in directory.collect():
        first, places = index.directory(r["file"])
        assert (r["first"], r["place"], r["length"]) in {(a, *b) for a, b in zip(first, places, strict=True)}
    for url in {u for _, u, _, _ in rows} | {"http://nowhere.org/"}:
        found = index.captures(url)
        assert Counter(c["page_id"] for c in found) == Counter(i for i, u, _, _ in rows if warc.surt(u) == warc.surt(url))
        for c in found:
            fields, payload = warc.read_capture(folder, c)
            assert fields.get("X-Page-Id") == (None if c["page_id"] is None else str(c["page_id"]))
            if c["type"] == "response":
                assert warc.payload_digest(payload) == c["digest"]
    names = {r["file"] for r in records.collect()}
    assert len(names) > 1
    # Some URLs only: their captures and no others.
    some = spark.createDataFrame([("http://h3.example.net/p10",), ("https://h3.example.net:443/p10",), ("http://nowhere.org/",), (None,)], "url string")
    got = warc.read_archives(some, folder, f"{folder}-index", directory).collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, u, _, _ in rows if warc.surt(u) in ("net,example,h3)/p10", "-"))


def test_long_keys_and_a_key_of_a_third_of_all_rows(spark):
    """Keys alike over more characters than a look-up holds, and one key over many blocks: every record is read back once, by several tasks."""
    stem = "http://host.example.org/" + "x" * 200
    rows = [(k, "http://hot.example.org/" if k % 3 == 0 else f"{stem}{k % 71}\u2028\r{k % 5}", f"body {k}", 1) for k in range(900)]
    pages = spark.createDataFrame(rows, PAGES)
    folder = common.work_dir(spark, "warc-test")
    directory = warc.write_index(warc.write_archives(pages, folder), f"{folder}-index", block_lines=7)
    out = warc.read_archives(pages.select("url"), folder, f"{folder}-index", directory)
    assert sorted(r.page_id for r in out.collect()) == list(range(900))
    tasks = Counter(r.part for r in out.selectExpr("spark_partition_id() AS part").collect())
    assert len(tasks) > 1 and max(tasks.values()) < 600


def test_reading_an_archive_takes_linear_time(spark):
    def seconds(n):
        folder = common.work_dir(spark, "warc-test")
        records = warc.write_archives(spark.createDataFrame([(k, f"http://a.org/{k}", random.Random(k).randbytes(600).hex(), 1) for k in range(n)], PAGES).coalesce(1), folder)
        captures = [r.asDict() for r in records.collect()]
        fs, base = warc._filesystem(folder)
        began = time.process_time()
        assert sum(1 for _ in warc.read_records(fs, base, captures)) == n
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.02)


def test_surt():
    assert warc.surt("http://www.Example.com:80/a?b=1#c") == "com,example)/a?b=1"
    assert warc.surt("https://x.org:8443") == "org,x:8443)/" and warc.surt(None) == "-"


# Quality model


def test_quality_scores(spark):
    rows, labels = [*odd.texts()], []
    for k in range(300):
        bad = k % 4 == 0
        rows.append((1000 + k, " | ".join(odd.words(k, 80).split()) if bad else odd.words(k, 80)))
        labels.append((1000 + k, 0 if bad else 1, 0, "x"))
    labels += [(None, 1, 0, "x"), (5, None, 0, "x"), (77777, 1, 0, "x")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    out = quality_model.quality_scores(odd.frame(spark, rows), lab).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    truth = {i: q for i, q, _, _ in labels}
    held = [r for r in out if r.held_out and (r.doc_id or 0) >= 1000]
    assert len(held) > 30 and all(r.predicted == truth[r.doc_id] for r in held)
    assert quality_model.quality_scores(odd.frame(spark, []), lab).count() == 0
    none = quality_model.quality_scores(odd.frame(spark), lab.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_model.fit(x, y)
    p = model.score(rng.uniform(-1, 1, (10, 3)))
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.8 and ((p >= 0) & (p <= 1)).all()


def test_features_count_what_they_say():
    import pyarrow as pa

    from scrivane.llm.textkernel import texts_of

    x, _ = quality_model.features(texts_of(pa.array(["a a b\na a b\nC! 12 |", "", None])))
    row = dict(zip(quality_model.FEATURES, x[0], strict=True))
    assert row["words"] == pytest.approx(np.log1p(9)) and row["repeated_lines"] == pytest.approx(1 / 3) and row["pipes"] == pytest.approx(1 / 9) and row["exclaims"] == pytest.approx(1 / 9)
    assert row["repeated_words"] == pytest.approx(1 - 5 / 9) and not np.isnan(x).any() and (x[1] == x[2]).all()


# Mixing


def test_rates_meet_targets_and_equal_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3] * 4, 200)
    t = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(k, int(t[k]), p[k].tolist()) for k in range(200)] + [(None, 0, [0.25] * 4)], "doc_id long, n_tokens long, p array<double>")
    targets = (1.0, 0.5, 0.25, 1.2)
    ridge = 1e-2
    got = mixing.fit_rates(df, targets, steps=400, ridge=ridge, close=0.0)
    w = got.of(p)
    whole = t.sum()
    goal = np.array(targets) * (t @ p) / whole
    z = np.ones(200)
    for _ in range(60_000):  # plain projected gradient to convergence
        z = np.maximum(0, z - 0.5 * (p @ ((t * z) @ p / whole - goal) + ridge * (z - 1)))
    assert np.abs(w - z).max() < 1e-3 and (w >= 0).all()
    near = mixing.fit_rates(df, targets)
    assert np.abs((t * near.of(p)) @ p / whole - goal).max() < 1e-3
    rows = mixing.document_rates(df, near).collect()
    assert len(rows) == 201 and all(abs(r.copies - r.rate) <= 1 for r in rows)


@pytest.mark.parametrize("shares", [(0.69, 0.0001, 0.3099, 0.0), (0.9897, 0.0003, 0.01, 0.0)])
def test_rare_domains_meet_their_targets(spark, shares):
    rows = [(k, round(shares[k] * 1e6), np.eye(4)[k].tolist()) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    rates = mixing.fit_rates(df)
    some = np.array(shares) > 0
    assert np.abs(rates.of(np.eye(4)) - mixing.TARGETS)[some].max() < 1e-3
    with pytest.raises(RuntimeError, match="settled"):
        mixing.fit_rates(df, steps=1)
    alike = spark.createDataFrame([(k, 10, [0.25] * 4) for k in range(9)], "doc_id long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.fit_rates(alike)


def test_tokens_counted_by_word_equal_the_library():
    import pyarrow as pa

    count = token_counts.counter(*counting_tokenizer())
    texts = [t or "" for _, t in odd.texts()] + ["a  b\n\n c\t\td  ", "it's  'round\r\nx", "nbsp\u00a0 x\u2003y\u3000", "\u2019\u201cq\u201d \u2026", "12 34\n5", "<|endoftext|> a<|endoftext|>b", "\x0b\x0c \x1c a", "\u00e9\u00a1"]
    r = random.Random(8)
    texts += ["".join(r.choice("aZ9'. \n\té\u2009—ß\u0085") for _ in range(r.randint(0, 40))) for _ in range(500)]
    by_word = token_counts.WordCounter(count, most=2_000)
    for k in range(0, len(texts), 40):
        part = texts_of(pa.array(texts[k : k + 40]))
        assert by_word.of(part, part.words()).tolist() == count(texts[k : k + 40]), k
    assert len(by_word.of(texts_of(pa.array([], pa.string())), texts_of(pa.array([], pa.string())).words())) == 0


def test_new_words_are_encoded_by_one_call():
    """What is encoded one by one is a text's first word and what isn't Latin, whatever the number of new words."""
    import pyarrow as pa

    count = token_counts.counter(*counting_tokenizer())
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdeé'9.,_~\x1c") for _ in range(r.randint(1, 12))) for _ in range(200)) + r.choice(["", " ", "\n\n"]) for _ in range(30)]
    asked = []

    def spy(some):
        asked.extend(some)
        return count(some)

    spy.joined = getattr(count, "joined", None)
    part = texts_of(pa.array(texts))
    assert token_counts.WordCounter(spy).of(part, part.words()).tolist() == count(texts)
    assert len(asked) <= 3 * len(texts)
    # A special string is one token wherever it stands, also among words that are encoded together.
    for more in (["a b<|endoftext|>c d", "x <|endoftext|> y"], ["日本 語 x y", "ж a ɐ b"], ["a\u00a0 b c", "a b c"], ["", " ", "\n"]):
        part = texts_of(pa.array(texts[:3] + more))
        assert token_counts.WordCounter(count).of(part, part.words()).tolist() == count(texts[:3] + more), more


def test_lexicon_is_looked_up_once_a_distinct_word():
    import pyarrow as pa

    r = random.Random(6)
    some = ["".join(r.choice("abAB.é") for _ in range(r.randint(1, 9))) for _ in range(60)]
    for n in (0, 1, 40):
        texts = texts_of(pa.array([" ".join(r.choices(some, k=r.randint(0, 50))) for _ in range(n)], pa.string()))
        words = texts.words()
        parts = mixing.word_parts(words)
        every = np.unique(np.concatenate(parts))
        every = every[every > 0]
        for lexicon in (every[::3], every, every[:0]):
            want = [len(set(np.concatenate([p[a:b] for p in parts]).tolist()) & set(lexicon.tolist())) for a, b in itertools.pairwise(words.bounds)]
            assert mixing.word_hits(words, lexicon).tolist() == want == mixing.lexicon_hits(parts, words.text_of(), texts.n, lexicon).tolist()


def test_classes_of_hashes():
    r = np.random.Generator(np.random.PCG64(4))
    for h in (np.zeros(0, np.uint64), r.integers(0, 1 << 63, 300, np.uint64)[r.integers(0, 300, 5_000)], np.arange(9, dtype=np.uint64) // np.uint64(2)):
        first, of = textkernel.classes(h)
        assert (h[first][of] == h).all() and all(of[first] == np.arange(len(first)))
        assert len(h) < 100 or len(first) == len(np.unique(h))


def test_flags_per_text_are_counted_alike_for_few_and_many_texts():
    r = np.random.Generator(np.random.PCG64(9))
    for n, size in ((0, 0), (1, 1), (3, 5_000), (2_000, 5_000), (1, 5_000)):
        offsets = np.concatenate([np.zeros(min(n, 1), np.int64), np.sort(r.integers(0, size + 1, max(0, n - 1))), [size]])
        flags = r.random(size) < 0.3
        assert textkernel.Texts(np.zeros(size, np.uint8), offsets).per_text(flags).tolist() == [int(flags[a:b].sum()) for a, b in itertools.pairwise(offsets)]


def test_a_repeated_id_does_not_outgrow_the_sample(spark):
    """One id with most labels and documents: the bound holds for rows, not ids."""
    docs = spark.createDataFrame([(1, f"text {k} here") for k in range(300)] + [(k, f"more {k}") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, k % 2, 0) for k in range(300)] + [(k, 1, k % 2) for k in range(2, 60)], "doc_id long, quality int, toxic int")
    sample = quality_model.bounded(labels, 50, "doc_id", "quality", "toxic")
    assert 0 < sample.count() <= 50 and Counter(sample.collect()) == Counter(quality_model.bounded(labels.repartition(5), 50, "doc_id", "quality", "toxic").collect())
    assert quality_model.bounded(labels.where("doc_id > 1"), 50, "doc_id", "quality", "toxic").count() == 50
    x, y = quality_model.sample_features(quality_model.labelled_sample(docs, labels, "quality", 50), 50)
    assert len(x) == len(y) <= 50
    assert mixing.mixing_rates(docs, labels, max_rows=50).count() == 358


def test_corrected_chances_have_no_jump():
    class Known:
        def __init__(self, low, high):
            self.seen = np.linspace(low, high, 1001)

        def score(self, x):
            return self.seen if x is None else x

    at = np.array([0.3, 0.5, 0.7])
    gap = np.linspace(0.0, 0.9, 181)
    out = []
    for g in gap:
        model = Known(0.5 - g / 2, 0.5 + g / 2)
        c = mixing.Cleaned(model, None)
        out.append(np.clip((at - c.low) / (c.high - c.low), 0, 1))
    assert np.abs(np.diff(np.array(out), axis=0)).max() < 0.05 and np.abs(out[0] - at).max() < 1e-9


def test_mixing_rates(spark):
    r = random.Random(5)
    rows, labels = [*odd.texts()], []
    for k in range(600):
        toxic, poor = k % 5 == 0, k % 7 == 0
        w = odd.words(k + 50, 80).split()
        if toxic:
            for _ in range(3):
                w[r.randrange(80)] = r.choice(["vilelot,", "Vileness", "vilely"])
        rows.append((1000 + k, (" | " if poor else " ").join(w)))
        labels.append((1000 + k, int(not poor), int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = odd.frame(spark, rows)
    out = {x.doc_id: x for x in mixing.mixing_rates(df, lab).collect() if x.doc_id is not None}
    good = [out[i].rate for i, q, t in labels if q and not t]
    bad = [out[i].rate for i, q, t in labels if t or not q]
    assert np.mean(np.array(good) > 0.8) > 0.97 and np.mean(np.array(bad) < 0.5) > 0.97
    kept = mixing.keep_mixed(df, lab)
    assert kept.schema == df.schema
    copies = Counter(x.doc_id for x in kept.collect())
    assert all(copies[i] == max(out[i].copies, out[i].rate >= 1 - mixing.NEAR) for i in out if i >= 1000)
    assert mixing.mixing_rates(odd.frame(spark, []), lab).count() == 0
    assert mixing.mixing_rates(df, lab.where("false")).count() == len(rows)


def test_drawn_documents_match_the_targets(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    rows, labels = [], []
    for k in range(2400):
        toxic, poor = k % 5 == 0, k % 3 == 0
        w = odd.words(k + 5000, 60).split()
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["vilelot,", "Vileness", "vilely"])
        rows.append((k, (" | " if poor else " ").join(w)))
        labels.append((k, int(not poor), int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    df = odd.frame(spark, rows)
    rates = {x.doc_id: x for x in mixing.mixing_rates(df, lab, tokenizer=counting_tokenizer()).collect()}
    kept = corpus_pipeline.mixing(spark, df, str(tmp_path))
    assert kept.schema == df.schema
    copies = Counter(x.doc_id for x in kept.select("doc_id").collect())
    p = {i: x.n_tokens * np.array([x.p_good, x.p_good_toxic, x.p_poor, x.p_poor_toxic]) for i, x in rates.items()}
    natural, got = sum(p.values()), sum(p[i] * n for i, n in copies.items())
    assert np.abs(got / natural - mixing.TARGETS).max() < 0.06
    assert {i for i, x in rates.items() if x.rate >= 0.95} <= set(copies)
    assert copies == Counter(x.doc_id for x in corpus_pipeline.mixing(spark, df, str(tmp_path)).select("doc_id").collect())


# Joins and the whole pipeline


def test_salted_join_splits_a_frequent_key(spark):
    many = spark.createDataFrame([(k, 1 if k % 3 else k) for k in range(3000)], "i long, k long")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(3000)], "k long, v string")
    counts = many.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.salted_join(many, one, "k", counts, 3000, "i", chunk=100)
    assert sorted((r.i, r.v) for r in got.collect()) == sorted((k, f"v{1 if k % 3 else k}") for k in range(3000))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [*odd.texts(), *[(200 + k, odd.words(2000 + k % 150, 90)) for k in range(200)]]
    passage = odd.words(999, 60)
    rows += [(500 + k, odd.words(700 + k, 60) + " " + passage) for k in range(5)]
    rows = [(i, t) for i, t in rows if i is not None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(200 + k, 1, int(k % 9 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = docs
        assert k == 4 or docs.columns == names
    assert seen["quality rules"].count() < len(rows)
    alive = {r.doc_id for r in seen["near duplicates"].collect()}
    assert {200 + k for k in range(150)} <= alive and not {200 + k for k in range(150, 200)} & alive
    cut = {r.doc_id: r for r in seen["substring dedup"].collect()}
    assert passage in cut[500].text and all(passage not in cut[500 + k].text and cut[500 + k].n_chars == len(cut[500 + k].text) for k in range(1, 5))
    last = seen["sampled pieces"]
    assert last.where("NOT lossless").count() == 0 and last.count() == seen["mixing"].count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    digest = lambda df: sorted((r.doc_id, hashlib.sha256(str(list(r.pieces)).encode()).hexdigest()) for r in df.collect())
    assert digest(whole) == digest(last)
