import re
import pytest
from pyspark.sql import functions as F

from scrivane.functions import crf, pii
from scrivane.operators import text


def kinds(t, kind=None):
    return [(k, s) for k, s, _, _ in pii.scan(t) if kind in (None, k)]


@pytest.mark.parametrize(
    ("said", "kind", "found"),
    [
        ("Contact: john@example.com for help", "EMAIL", ["john@example.com"]), ("mail user+tag@domain.org please", "EMAIL", ["user+tag@domain.org"]), ("just a regular sentence", "EMAIL", []),
        ("write to a@b.com.", "EMAIL", []), ("ab@cd.e", "EMAIL", []),
        ("Call 212-555-0123 today", "PHONE", ["212-555-0123"]), ("(212) 555-0123", "PHONE", ["(212) 555-0123"]), ("2125550123", "PHONE", ["2125550123"]), ("12125550123", "PHONE", ["12125550123"]),
        ("1125550123", "PHONE", []), ("012-555-0123", "PHONE", []), ("212-055-0123", "PHONE", []), ("ring +44 20 7946 0018 now", "PHONE", ["+44 20 7946 0018 "]), ("+12345678", "PHONE", []),
        ("SSN: 123-45-6789", "SSN", ["123-45-6789"]), ("SSN: 123456789", "SSN", ["123456789"]), ("000-12-3456 666-12-3456 123-00-4567 900-11-1111", "SSN", []), ("Call 1234567890 for help", "SSN", []),
        ("Product: 3921837456218390", "PAN", []), ("Card: 4111111111111111 expires 12/25", "PAN", ["4111111111111111"]), ("Card: 4111111111111111 expires 12/25", "EXPIRY", []),
        ("Card 4111111111111111 exp 12/25 cvv 123.", "EXPIRY", ["12/25"]), ("Card 4111111111111111 exp 12/25 cvv 123.", "CVV", ["123"]), ("4111111111111111 on 03/2027, ok", "EXPIRY", ["03/2027"]),
        ("Austin, TX 78701", "ZIP", ["78701"]), ("GSTIN T2ABCDEI24322E4", "ZIP", []), ("Address: 123 Main St, Austin, TX 78701", "ADDRESS", ["Address: 123 Main St, Austin, TX 78701"]), ("addr: 5 Road", "ADDRESS", []),
        ("Buyer: John Smith, 123 Main St", "NAME", ["John Smith"]), ("pay to account 12345678 now", "ACCOUNT", ["12345678"]),
    ],
)
def test_scanners(said, kind, found):
    assert [s for _, s in kinds(said, kind)] == found


@pytest.mark.parametrize(
    ("said", "name", "address"),
    [
        ("Bill to: Jason Roberts 12 Oak Street Boston, MA 02101 US Tel 1", "Jason Roberts", True), ("Bill to Cindy Banks 0668 Amanda Street Apt. 9 Tel +(1)", "Cindy Banks", True),
        ("Buyer Christian Banks III 77 Elm Road Town Email x", "Christian Banks III", True), ("bill_to Alexander Williams", "Alexander Williams", False),
    ],
)
def test_bill_to(said, name, address):
    hits = kinds(said)
    assert ("NAME", name) in hits and any(k == "ADDRESS" for k, _ in hits) == address


def test_offsets_are_bytes_and_hold_the_text():
    said = "é ü 日本 x@example.com (212) 555-0123 ß 4111111111111111 😀 12345"
    raw = said.encode()
    hits = pii.scan(said)
    assert {h[0] for h in hits} >= {"EMAIL", "PHONE", "PAN", "ZIP"}
    assert all(raw[a:b].decode() == s for _, s, a, b in hits)


def test_fold_is_stable_and_idempotent():
    hits = [("PHONE", "+1 (212) 555-0123", 0, 17), ("PHONE", "(212) 555-0123", 3, 17), ("SSN", "123456789", 20, 29), ("PAN", "4123456789", 19, 29), ("ZIP", "12345", 25, 30)]
    once = pii.fold(hits)
    assert [h[0] for h in once] == ["PHONE", "PAN", "ZIP"] and pii.fold(once) == once


def test_nothing_crashes_on_odd_texts():
    for t in [None, "", "@", "+", "(", "(212) 555-", "bill to ", "name:", "account é" + "é" * 90 + "1234567", "4111111111111111" + "é" * 60, "(" + "1" * 12, "Bill to 5"]:
        pii.scan(t)


def test_hits_of_a_table(spark):
    df = spark.createDataFrame([(1, "a@example.com b"), (2, None), (3, "none"), (4, "zip 12345 x@example.org y")], "id long, text string")
    rows = text.pii_hits(df, "id").collect()
    assert [(r.id, r.seq, r.kind) for r in rows] == [(1, 0, "EMAIL"), (4, 0, "ZIP"), (4, 1, "EMAIL")]
    wide = {r.id: [h.kind for h in r.pii] for r in text.with_hits(df).collect()}
    assert wide == {1: ["EMAIL"], 2: [], 3: [], 4: ["ZIP", "EMAIL"]}
    text.register_functions(spark)
    df.createOrReplaceTempView("t_pii")
    assert spark.sql("SELECT id, inline(scan_pii(text)) FROM t_pii").count() == 3


def test_expressions_agree_with_the_scanner(spark):
    df = spark.createDataFrame([(1, "é 4111111111111111 x 12"), (2, "no digits here at all"), (3, "007")], "id long, text string")
    runs = text.digit_runs(df, "id").where(F.expr("luhn_check(run)")).where(F.length("run") > 12).collect()
    assert [(r.id, r.run, r.start, r.end) for r in runs] == [(1, "4111111111111111", 3, 19)]
    toks = text.tokens(df, "id").where("id = 1").orderBy("i").collect()
    assert [(r.word, r.start, r.end) for r in toks] == crf.tokenize("é 4111111111111111 x 12")
    assert [r.s for r in text.tokens(df, "id").where("id = 1").orderBy("i").select(text.shape(F.col("word")).alias("s")).collect()] == [crf.shape(w) for w, _, _ in crf.tokenize("é 4111111111111111 x 12")]


def test_rows_of_one_key_are_told_apart(spark):
    df = spark.createDataFrame([(1, "aa bb 12"), (1, "cc dd 3 45"), (None, "x  \x0by\f7"), (2, None), (2, ""), (2, " \t"), (3, "é" * 5 + " 日本 9")], "id long, text string")
    want = [(i, k, *t) for i, x in df.collect() for k, t in enumerate(crf.tokenize(x or ""))]
    assert sorted(map(tuple, text.tokens(df, "id").collect()), key=str) == sorted(want, key=str)
    runs = [(i, k, m.group().decode(), *m.span()) for i, x in df.collect() for k, m in enumerate(re.finditer(rb"\d+", (x or "").encode()))]
    assert sorted(map(tuple, text.digit_runs(df, "id").collect()), key=str) == sorted(runs, key=str)
    near = {(r.word, r.i): (r.before2, r.before1, r.low, r.after1, r.after2) for r in text.neighbours(df, "id").where("id = 1").collect()}
    assert near["aa", 0] == ("__BOS__", "__BOS__", "aa", "bb", "12") and near["3", 2] == ("cc", "dd", "3", "45", "__EOS__") and len(near) == 7
    assert text.tokens(df.where("false"), "id").count() == 0


# Sequence labelling


def test_emissions_of_a_batch_are_sums_of_token_features():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    words = "Cindy banks 0668 Oak St, TX 75001 é ABC-1 a@b.c the _ 12 Longwordlongwordlongword".split()
    texts = [list(rng.choice(words, n)) for n in (0, 1, 2, 7, 3, 0, 20)]
    names = sorted({f for t in texts for i in range(len(t)) for f in crf.token_features(t, i)})
    model = crf.Model(["O", "A", "B"], {f: rng.normal(size=3).astype(np.float32) for f in names[::2]}, rng.normal(size=(3, 3)).astype(np.float32))
    bounds = np.cumsum([0, *map(len, texts)])
    got = model.emit(pa.array([w for t in texts for w in t], pa.string()), bounds)
    path = crf.viterbi_all(got, bounds, model.transitions)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        want = np.zeros((len(t), 3), np.float32)
        for i in range(len(t)):
            for f in crf.token_features(t, i):
                if f in model.weights:
                    want[i] += model.weights[f]
        assert (got[a:b] == want).all()
        assert path[a:b].tolist() == crf.viterbi(want, model.transitions)


def test_feature_names_are_counted_in_slices(spark):
    """Counts are those of the names, and a slice gives a row a name, not one an occurrence."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    said = ["Cindy banks 0668 Oak St, TX", "é ABC-1 a@b.c", None, "", " \t", "one", "Longwordlongwordlongword the the"] * 40
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "id int, text string").coalesce(1)
    names = Counter(f for t in said for w in [[x for x, _, _ in crf.tokenize(t or "")]] for i in range(len(w)) for f in crf.token_features(w, i))
    assert {r.feature: r.n for r in text.feature_counts(df).collect()} == names
    assert Counter(r.feature for r in text.feature_names(df, "id").collect()) == names
    assert crf.count_features(pa.array(["the"] * 1000, pa.string()), np.array([0, 0, 999, 1000]))["w:the"] == 1000


def test_looks_of_tokens_against_loops():
    """Tokens of ASCII characters are looked at by one translation, others a character at a time: both say the same."""
    for t in ["", "A", "AB1", "Ab", "aB", "12", "1a", "-,", "A-", "é", "ÀB", "Éa", "日", "²", "½", "٣1", "İs", "a日", ".", "Xy,", "ST."]:
        each = (all(c.isupper() for c in t), t[:1].isupper() and all(c.islower() for c in t[1:]), all("0" <= c <= "9" for c in t))
        some = (any("0" <= c <= "9" for c in t), any(c.isalpha() for c in t), bool(t) and not any(c.isalnum() for c in t))
        assert tuple(map(bool, crf._looks(t)))[:5] == (each + some)[:5] and (not t or crf._looks(t)[5] == some[2])
        assert crf.shape(t) == "".join("A" if c.isupper() else "a" if c.islower() else "0" if "0" <= c <= "9" else "-" for c in t[:10])


def test_emissions_within_a_row_are_those_of_the_join(spark):
    """Scores are those of the join and its grouping, also with features that occur twice; no token is kept beyond its row."""
    weights = [("a", "X", 1.0), ("a", "Y", -0.5), ("b", "X", 0.25), ("c", "Z", 2.0)]
    rows = [(1, 0, ["a", "b", "q"]), (1, 1, ["q"]), (2, 0, ["c", "c", None, "a"]), (3, 0, []), (4, 0, None), (5, 7, ["b"])]
    df = spark.createDataFrame(rows, "key int, i int, features array<string>")
    one = text.token_emissions(df, "features", weights)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.replace("aggregate(", "") and "Exchange" not in plan and "Join" not in plan
    joined = text.emissions(df.select("key", "i", F.explode("features").alias("feature")), spark.createDataFrame(weights, "feature string, label string, w double"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, joined.collect())) and one.count() == 6


def test_texts_are_tagged_in_slices(spark):
    """A batch of more text than a slice is tagged as each of its texts alone, and what a model doesn't weigh has no names made."""
    from scrivane.plans.catalog import TAGGER

    said = ["see Ann Banks at 12 Oak Street now", "x", "", "pay 12345678 Oak St"]
    df = spark.range(0, 60, 1, 1).select("id", F.when(F.col("id") % 5 == 4, F.repeat(F.lit("word 12 Oak "), 10_000)).otherwise(F.element_at(F.array(*map(F.lit, said)), (F.col("id") % 4 + 1).cast("int"))).alias("text"))
    assert df.agg(F.sum(F.length("text"))).first()[0] > text.TAGGED_BYTES
    rows = {}
    for r in text.tag_tokens(df, "id", TAGGER).orderBy("id", "i").collect():
        rows.setdefault(r.id, []).append(r.label)
    hits = {}
    for r in text.pii_hits(df, "id", model=TAGGER).orderBy("id", "seq").collect():
        hits.setdefault(r.id, []).append((r.kind, r.text, r.start, r.end))
    for r in df.collect():
        words = [w for w, _, _ in crf.tokenize(r.text)]
        assert rows.get(r.id, []) == [TAGGER.labels[k] for k in crf.viterbi(TAGGER.emissions(words), TAGGER.transitions)]
        assert hits.get(r.id, []) == pii.scan(r.text, crf.decode(TAGGER, r.text))


def test_customers_texts_are_spread(spark, tmp_path):
    """The customers' small file is one split; their texts are made and scanned by as many tasks as there are cores."""
    from scrivane.plans import catalog

    spark.range(1, 400, 1, 1).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    assert catalog._customers(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    assert catalog.crf_scan(spark, str(tmp_path)).select("c_custkey").distinct().count() == 399


@pytest.mark.parametrize(("said", "name"), [("Bill to Cindy Banks", "Cindy Banks"), ("Buyer Christian Banks III", "Christian Banks"), ("Cindy Banks", "Cindy Banks"), ("Sarah", "Sarah"), ("Bill to", None), ("Invoice Number 12345", None)])
def test_leading_name(said, name):
    assert crf.leading_name(said) == name


def test_signals():
    assert crf.has_name_signal("Cindy Banks") and crf.has_name_signal("Banks") and not crf.has_name_signal("Swiss Bank Corp")
    assert crf.has_address_signal("12 Oak Street") and crf.has_address_signal("Box in TX") and not crf.has_address_signal("nothing here")
    assert crf.name_prefix("Cindy Banks 0668 Amanda Street") == 11 and crf.name_prefix("0668 Amanda Street") is None


def test_viterbi_is_the_best_path_and_prefers_low_labels():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(30):
        e, t = rng.integers(0, 4, (5, 3)).astype(np.float32), rng.integers(0, 3, (3, 3)).astype(np.float32)
        score = lambda p, e=e, t=t: sum(e[i, k] for i, k in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p))
        assert score(crf.viterbi(e, t)) == max(score(p) for p in itertools.product(range(3), repeat=5))
    assert crf.viterbi(np.zeros((3, 2), np.float32), np.zeros((2, 2), np.float32)) == [0, 0, 0] and crf.viterbi(np.zeros((0, 2)), np.zeros((2, 2))) == []


def test_decode_splits_names_from_addresses():
    import numpy as np

    tokens = "Cindy Banks 0668 Amanda Street".split()
    weights = {f"w:{w.lower()}": np.array([0, 5], np.float32) for w in tokens}
    model = crf.Model(["O", "ADDRESS"], weights, np.zeros((2, 2), np.float32))
    hits = crf.decode(model, "to " + " ".join(tokens))
    assert hits == [("ADDRESS", "0668 Amanda Street", 15, 33), ("NAME", "Cindy Banks", 3, 14)]
    again = crf.Model.load(model.dump())
    assert again.labels == model.labels and crf.decode(again, "to " + " ".join(tokens)) == hits
