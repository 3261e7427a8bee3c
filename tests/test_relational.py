import json
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivane import streaming
from scrivane.functions import crf
from scrivane.operators import documents, evaluate, gbdt, prepare, regions, training
from scrivane.plans import catalog
from scrivane.sources import files

# Trees


def stump(f, t, a, b):
    return [{"nodeid": 0, "split": f"f{f}", "split_condition": t, "children": [{"leaf": a}, {"leaf": b}]}]


def test_tree_scores(spark):
    model = gbdt.Model.load(json.dumps([stump(0, 0.5, -0.5, 0.5), [{"leaf": 0.0}], stump(1, 10.0, 2.0, 1.0), [{"leaf": 0.0}]]), ["a", "b"])
    df = spark.createDataFrame([(0.3, 5.0), (0.7, 15.0), (float("nan"), 10.0)], "x double, y double")
    for way in (True, False):
        got = [(round(r.a, 4), round(r.b, 4)) for r in gbdt.score(df, model, ["x", "y"], expressions=way).collect()]
        assert got == [(0.3775, 0.8808), (0.6225, 0.7311), (0.6225, 0.7311)]
    again = gbdt.Model.load(model.dump())
    assert gbdt.node_table(again, spark).count() == gbdt.node_table(model, spark).count() == 8
    with pytest.raises(ValueError):
        gbdt.Model.load("[1, 2, 3]", ["a", "b"])


def test_training_round_trip(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 0), i) for i, (a, b) in enumerate(x)], "u double, v double, y int, i long")
    fitted = gbdt.train(df, "y", ["u", "v"], rounds=4, depth=3)
    ours = gbdt.score(df, gbdt.from_spark(fitted, "p"), ["u", "v"])
    from pyspark.ml.feature import VectorAssembler

    theirs = fitted.transform(VectorAssembler(inputCols=["u", "v"], outputCol="_x").transform(df)).select("i", "probability")
    for r in ours.join(theirs, "i").collect():
        assert r.p == pytest.approx(r.probability[1], abs=1e-9)
    folds = training.gbdt_folds(df, "y", ["u", "v"], "i", k=2, rounds=2, depth=2)
    assert folds.count() == 4 and {m.metric for m in evaluate.fold_summary(folds.where("part = 'valid'"), ["auc", "f1"]).collect()} == {"auc", "f1"}
    assert len(gbdt.importances(fitted, ["u", "v"])) == 2


def test_crf_training_learns():
    seqs = [(["pay", "Ann", "now"], ["O", "NAME", "O"]), (["see", "Bob", "there"], ["O", "NAME", "O"]), (["go", "home"], ["O", "O"])] * 4
    model = training.train_crf(seqs, rounds=40, l1=0.1, l2=0.1)
    scores = training.token_scores(model, [(["call", "Cid", "soon"], ["O", "NAME", "O"])])
    assert scores.set_index("label").loc["NAME", "f1"] == 1.0


def test_batch_marginals_are_sums_of_single_ones():
    rng = np.random.default_rng(2)
    sizes = [3, 0, 1, 7, 2]
    bounds, trans = np.cumsum([0, *sizes]), rng.normal(size=(3, 3))
    e = rng.normal(size=(bounds[-1], 3))
    z, p, pairs = training.batch_marginals(e, bounds, trans)
    one = [training.marginals(e[a:b], trans) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
    assert z == pytest.approx(sum(x[0] for x in one)) and np.allclose(p, np.concatenate([x[1] for x in one])) and np.allclose(pairs, sum(x[2] for x in one))


def test_owl_qn_finds_the_optimum():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 8)), rng.normal(size=40)
    w = training.owl_qn(lambda w: (0.5 * float(((a @ w - b) ** 2).sum()), a.T @ (a @ w - b)), np.zeros(8), 5.0, steps=300, close=1e-10)
    z = np.zeros(8)
    for _ in range(20_000):  # proximal gradient steps to convergence
        z = z - 0.005 * a.T @ (a @ z - b)
        z = np.sign(z) * np.maximum(np.abs(z) - 0.025, 0)
    assert np.abs(w - z).max() < 1e-5 and (w == 0).any()


def test_a_tagger_fitted_by_tasks(spark):
    """The distributed fit reaches a stationary point of the same objective: the gradient of a naive version is within the penalty there."""
    rows = [(["pay", n, "now"], ["O", "NAME", "O"]) for n in ("Ann", "Bob", "Cid")] * 3 + [(["go", "home"], ["O", "O"])] * 2 + [(None, None), ([], []), (["x"], ["O", "O"]), (["a", None], ["O", "O"])]
    df = spark.createDataFrame(rows, "tokens array<string>, labels array<string>").repartition(3)
    model = training.fit_crf(df, c1=0.05, c2=0.1, steps=60)
    good = [r for r in rows if r[0] and None not in r[0] and len(r[0]) == len(r[1])]
    index = {x: i for i, x in enumerate(model.labels)}
    grad, moves = {}, np.zeros((2, 2))
    for t, y in good:
        _, p, pairs = training.marginals(model.emissions(t).astype(float), model.transitions.astype(float))
        for i, x in enumerate(y):
            p[i, index[x]] -= 1
            for f in set(crf.token_features(t, i)):
                grad[f] = grad.get(f, 0) + p[i]
        for a, b in zip(y[:-1], y[1:], strict=True):
            pairs[index[a], index[b]] -= 1
        moves += pairs
    for f, g in [*grad.items(), *enumerate(moves)]:
        w = model.transitions[f] if isinstance(f, int) else model.weights.get(f, np.zeros(2))
        g = g + 0.2 * w
        assert (np.where(w != 0, np.abs(g + 0.05 * np.sign(w)), np.maximum(np.abs(g) - 0.05, 0)) < 0.02).all(), f
    scores = training.token_scores(model, [(["pay", "Dan", "soon"], ["O", "NAME", "O"])])
    assert scores.set_index("label").loc["NAME", "f1"] == 1.0
    assert training.fit_crf(df.where("false")).labels == []


def test_crf_folds(spark):
    rows = [(["pay", n, "now"], ["O", "NAME", "O"], i % 2) for i, n in enumerate(["Ann", "Bob", "Cid", "Dan"])]
    out = training.crf_folds(spark.createDataFrame(rows, "tokens array<string>, labels array<string>, fold int"), 2, rounds=10).collect()
    assert {r.fold for r in out} == {0, 1}


# Regions


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def merge_loop(first, second):
    """One document, step by step: (box, confidence) lists."""
    out, stats, replaced = [("a", *x) for x in first], dict(merged_pairs=0, replaced=0, novel=0), set()
    for box, conf in second:
        best, ti = 0.0, -1
        for k, (b, _) in enumerate(first):
            v = overlap(b, box)
            if v > best:
                best, ti = v, k
        if best < 0.5:
            stats["novel"] += 1
            out.append(("b", box, conf))
            continue
        if ti not in replaced:
            stats["merged_pairs"] += 1
        if conf > first[ti][1]:
            replaced.add(ti)
            out[ti] = ("b", box, conf)
    stats["replaced"] = len(replaced)
    order = [o for o in out[: len(first)]] + [o for o in out[len(first) :]]
    return order, stats


def test_merge_against_the_loop(spark):
    r = random.Random(1)
    docs, rows = {}, ([], [])
    for d in range(120):
        box = lambda: (x := r.randint(0, 12), y := r.randint(0, 4), x + r.randint(2, 8), y + r.randint(2, 5))
        pair = [[(box(), float(r.randint(0, 4) * 25)) for _ in range(r.randint(1, 6))] for _ in range(2)]
        docs[d] = pair
        for side in range(2):
            rows[side].extend((d, k, f"{'ab'[side]}{k}", dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True)), c) for k, (b, c) in enumerate(pair[side]))
    schema = "doc_id long, pos int, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>, confidence double"
    one, two = (spark.createDataFrame(x, schema) for x in rows)
    got = {}
    for m in regions.merge_regions(one, two).collect():
        got.setdefault(m.doc_id, {})[m.pos] = (m.source, tuple(m.bbox), m.confidence)
    stats = {s.doc_id: s for s in regions.merge_stats(one, two).collect()}
    for d, (a, b) in docs.items():
        want, st = merge_loop(a, b)
        assert [got[d][k] for k in range(len(got[d]))] == [(s, tuple(map(float, x)), c) for s, x, c in want]
        assert all(stats[d][k] == v for k, v in st.items())


def test_overlap_is_symmetric(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    df = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0)), ((0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0))], f"a {box}, b {box}")
    rows = df.select(regions.iou(F.col("a"), F.col("b")).alias("x"), regions.iou(F.col("b"), F.col("a")).alias("y")).collect()
    assert [(r.x, r.y) for r in rows] == [(pytest.approx(1 / 7), pytest.approx(1 / 7)), (0.0, 0.0)]


def test_text_helpers(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("plain",)], "t string")
    rows = [r.x for r in df.select(regions.parse_or_wrap(regions.strip_fences(F.col("t"))).alias("x")).collect()]
    assert json.loads(rows[0]) == {"a": 1} and json.loads(rows[1]) == {"text": "plain"}
    top = regions.ranked_scores(spark.createDataFrame([(0.2, 0.9)], "a double, b double"), ["a", "b"]).first().ranked
    assert [t.label for t in top] == ["b", "a"]
    glm = spark.createDataFrame([(1, [("hi", [1.0, 2.0, 3.0, 4.0], None), ("yo", [0.0, 0.0, 1.0, 1.0], 120.0)])], "doc_id long, regions array<struct<text: string, bbox: array<double>, confidence: double>>")
    out = regions.normalise_list(glm).orderBy("id").collect()
    assert [(r.id, r.confidence, r.bbox.x1) for r in out] == [("glm-0", 75.0, 3.0), ("glm-1", 100.0, 1.0)]
    laid = spark.createDataFrame([((0.0, 0.0, 1100.0, 500.0), "text", 200, 100), ((0.0, 0.0, 1.0, 1.0), "image", 1, 1)], "bbox struct<x0: double, y0: double, x1: double, y1: double>, task string, width int, height int")
    assert [tuple(r.bbox) for r in regions.to_pixels(laid).collect()] == [(0, 0, 200, 50)]
    words = spark.createDataFrame([(1, "r0", "Ann@x.org"), (1, "r1", "bob")], "doc_id long, id string, text string")
    hits = spark.createDataFrame([(1, "ann@x.org")], "doc_id long, text string")
    assert [r.region_id for r in regions.hit_words(hits, words).collect()] == ["r0"]


# Documents


def test_document_changes(spark):
    from pyspark.errors import PySparkException

    docs = spark.createDataFrame([(1, (10, 20), (0.1, 0.2, 0.3, 0.4, 0.5)), (2, (0, 5), None)], "doc_id long, image struct<width: int, height: int>, classification struct<is_document: double, is_digital: double, is_paper: double, is_crumpled: double, is_shadow: double>")
    reg = spark.createDataFrame([(1, "r0", "a", 50.0), (1, "r1", "b", 150.0)], "doc_id long, id string, text string, confidence double")
    hits = spark.createDataFrame([(1, 0, 3, "NAME", "Ann")], "doc_id long, start int, end int, kind string, text string")
    d = documents.build(docs, reg, hits)
    assert {r.id: (len(r.regions), len(r.pii)) for r in d.collect()} == {"1": (2, 1), "2": (0, 0)}
    assert sorted((r.id, r.problem) for r in documents.violations(d).collect()) == [("1", "region confidence"), ("2", "image size")]
    one = d.where("id = '1'")
    red = documents.redact(documents.redact(one, F.lit("r1")), F.lit("r1"))
    assert [x.id for x in documents.redactions(red).first().redactions] == ["r1"]
    assert documents.redactions(documents.unredact(red, F.lit("r1"))).first().redactions == []
    assert documents.add_field(one, F.lit("r0"), F.lit("total")).first().fields[0].confidence == 0.9
    with pytest.raises(PySparkException):
        documents.redact(one, F.lit("nope")).collect()
    back = documents.from_json(documents.to_json(one), one.schema).first()
    assert back.regions == one.first().regions and one.select(documents.region(F.lit("r1"))["text"].alias("t")).first().t == "b"


# Evaluation and preparation


def test_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 6))) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first().auc == pytest.approx(want)


def test_token_kinds(spark):
    t = "GSTIN x 123456789 a@b.org +(212)555-0123 12345 12345678".split()
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(t)], "doc long, i int, token string")
    got = [r.kind for r in evaluate.type_tokens(df, "doc").orderBy("i").collect()]
    assert got == [None, None, None, "EMAIL", "PHONE", "ZIP", "ACCOUNT"]
    near = spark.createDataFrame([("Invoice no: 12345678", 12, 20), ("at 12 Oak Street 12345678", 17, 25)], "t string, a int, b int")
    rows = near.select(evaluate.is_invoice_number(F.col("t"), F.col("a")).alias("inv"), evaluate.has_address_sign(F.col("t"), F.col("a"), F.col("b")).alias("adr")).collect()
    assert [(r.inv, r.adr) for r in rows] == [(True, False), (False, True)]
    assert evaluate.hold_out(spark.range(2000), "id").where("held_out").count() in range(320, 480)


def test_alignment_and_labels(spark):
    assert prepare.levenshtein("kitten", "sitting") == 3 and prepare.levenshtein("", "abc") == 3
    assert prepare.align(["Helo", "wrld", "x"], ["Hello", "brave", "world"]) == [(0, 0), (1, 1)] or prepare.align(["Helo", "wrld"], ["Hello", "world"]) == [(0, 0), (1, 1)]
    seller = "Ann Lee 12 Oak Street a@b.org 12345".split()
    rows = [(1, i, w, prepare.SELLER) for i, w in enumerate(seller)] + [(1, 7, "Total", 6)] + [(2, 0, "12345678", prepare.PAYMENT), (2, 1, "Bank", prepare.PAYMENT), (3, 0, "none", 0)]
    df = prepare.refined_labels(spark.createDataFrame(rows, "doc long, i int, token string, tag int"), "doc")
    got = {(r.doc, r.i): r.label for r in df.collect()}
    assert [got[1, i] for i in range(8)] == ["NAME", "NAME", "ADDRESS", "ADDRESS", "ADDRESS", "EMAIL", "ZIP", "O"] and got[2, 0] == "ACCOUNT" and got[2, 1] == "O"
    assert {r.doc for r in prepare.drop_unlabelled(df, "doc").collect()} == {1, 2}
    noisy = prepare.noisy(df.select("doc", "i", "token", "label"), "doc")
    assert noisy.collect() == prepare.noisy(df.select("doc", "i", "token", "label"), "doc").collect()
    f = spark.createDataFrame([("coco/a.png",), ("srd/b.png",)], "filename string")
    assert {r.filename: r.is_paper for r in prepare.dataset_labels(f, spark).collect()} == {"coco/a.png": 0, "srd/b.png": 1}
    assert prepare.variants(f, 1).count() == 2


# Files and streams


def test_files(spark, tmp_path):
    lab = spark.createDataFrame([("a.png", 1, 0, 1, 0, 0), ("b.png", 0, 0, 0, 0, 0)], files.LABEL_SCHEMA)
    files.write_labels(lab, str(tmp_path / "labels"))
    assert sorted(files.read_labels(spark, str(tmp_path / "labels")).collect()) == sorted(lab.collect())
    feats = lab.withColumn("features", F.array(*[F.lit(float(k)) for k in range(81)]))
    for _ in range(2):
        files.write_features(feats, str(tmp_path / "features"))
    assert files.read_features(spark, str(tmp_path / "features")).count() == 4
    assert files.wide(feats).first().f80 == 80.0
    (tmp_path / "npz").mkdir()
    files.write_archive(feats, str(tmp_path / "npz/x.npz"))
    assert sorted(files.read_archives(spark, str(tmp_path / "npz")).select("filename", "is_paper").collect()) == [("a.png", 1), ("b.png", 0)]
    (tmp_path / "truth.json").write_text(json.dumps({"totalInvoices": 1, "samples": [{"tokens": ["a", "b"], "tags": [0, 5]}]}))
    assert [tuple(r) for r in files.truth_tokens(files.read_truth(spark, str(tmp_path / "truth.json"))).collect()] == [(0, 0, "a", 0), (0, 1, "b", 5)]
    tsv = "1\t0\n5\t1\t1\t1\t1\t1\t10\t20\t30\t5\t91.5\tHello\n5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t\tx\n5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t9\t \n"
    words = files.tsv_words(spark.createDataFrame([(1, tsv)], "id long, tsv string"), "id").collect()
    assert [(w.text, w.bbox.x1, w.bbox.y1, w.confidence) for w in words] == [("Hello", 40, 25, 91.5), ("x", 4, 6, 0.0)]
    n = spark.createDataFrame([("fatura2_train_12.jpg",), ("fatura2_test_3.jpg",), ("other",)], "f string").select(files.image_number(F.col("f")).alias("n")).collect()
    assert [r.n for r in n] == [12, 8603, None]
    assert files.load_crf("  ") is None
    spark.createDataFrame([(bytes([1, 2]),), (None,)], "image binary").write.parquet(str(tmp_path / "pics"))
    assert files.read_image_parquet(spark, str(tmp_path / "pics")).count() == 1


def test_streams(spark, tmp_path):
    schema = "id long, text string, at timestamp"
    spark.createDataFrame([(1, "a@example.com x", datetime(2024, 1, 1, 0, 1)), (2, "none", datetime(2024, 1, 1, 0, 2)), (3, "b@example.com 12345", datetime(2024, 1, 1, 0, 7))], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming.hits(stream, "id").writeStream.format("memory").queryName("s_hits").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("s_hits").count() == 3
    q = streaming.kind_counts(stream, "at").writeStream.outputMode("complete").format("memory").queryName("s_kinds").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.kind, r.hits) for r in spark.table("s_kinds").collect()) == [("EMAIL", 1), ("EMAIL", 1), ("ZIP", 1)]


def test_catalogue():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(catalog.queries()) <= set(names) and set(entry.oracle_sql()) <= set(names) and len(catalog.oracle_sql()) > 45


def test_overlaps_meet_once_whatever_their_bins(spark):
    """Long, short, empty and null intervals, hot keys and repeated rows, against the definition."""
    import itertools
    import random
    from collections import Counter

    r = random.Random(3)

    def made(n):
        out = []
        for k in range(n):
            start = r.randint(-300, 1200)
            out.append((r.choice([1, 1, 1, 2, None]), k, start, start + r.choice([0, 0, 1, 5, 256, 700])))
        return [*out, *out[:3], (1, -1, None, 5), (1, -2, 5, None)]

    one, two = made(60), made(50)
    a, b = (spark.createDataFrame(x, "doc long, id long, start int, end int") for x in (one, two))
    touch = lambda x, y: None not in (*x, *y) and x[0] == y[0] and x[2] < y[3] and x[3] > y[2]
    want = Counter((x[1], y[1]) for x, y in itertools.product(one, two) if touch(x, y))
    assert Counter((p.id, p.b_id) for p in evaluate.overlaps(a, b, "doc").collect()) == want
    for how, kept in (("left_semi", True), ("left_anti", False)):
        assert Counter(map(tuple, evaluate.overlaps(a, b, "doc", how).collect())) == Counter(x for x in one if any(touch(x, y) for y in two) == kept)


def test_replaced_documents_are_checked(spark):
    from pyspark.errors import PySparkException

    d = catalog._nested(spark, "/root/testdata/sf0.001").limit(20)
    with pytest.raises(PySparkException, match="image size"):
        documents.replaced(d, image=F.struct(F.lit(0).alias("width"), F.lit(1).alias("height"))).collect()
    urls = files.from_data_urls(spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",), (None,), ("???",)], "url string"))
    assert [None if r.content is None else bytes(r.content) for r in urls.collect()] == [b"hi", b"hi", None, None]


def small_lines(spark, path):
    """Line items of a few orders, several of them to a flag and a status, as a table of the catalogue."""
    rows = [(o, 7 * o + n, n % 3, 1 + n // 2, float(n + o), 10.0 * n, n % 10 / 100, n % 4 / 100, "ANR"[(n * o) % 3], "FO"[n % 2]) for o in range(1, 30) for n in range(o % 6)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{path}/lineitem.parquet")
    return rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_of_orders_are_built_without_grouping_nested_rows(spark, tmp_path):
    rows = small_lines(spark, tmp_path)
    df = catalog.region_flatten(spark, str(tmp_path))
    plan = plan_of(df)
    assert "ObjectHashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = set()
    for o in {r[0] for r in rows}:
        lines = [(ln, r) for ln, r in enumerate(sorted((r for r in rows if r[0] == o), key=lambda r: (r[3], r[1], r[2], r[4], r[5])), 1)]
        flags = sorted({r[8] for _, r in lines})
        for b, flag in enumerate(flags):
            for p, status in enumerate(sorted({r[9] for _, r in lines if r[8] == flag})):
                for k, (_, r) in enumerate((ln, r) for ln, r in lines if (r[8], r[9]) == (flag, status)):
                    parent = f"tess-b{b}-p{p}-l{k}"
                    want |= {(o, f"{parent}-w{w}", t, round(min(max(r[6] * 2000, 0), 100), 6), "PT_TABLE" if flag == "A" else "PT_UNKNOWN", parent) for w, t in ((0, flag), (2, status))}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) == 2 * len(rows) and set(got) == want


def test_merged_regions_against_loops(spark, tmp_path):
    """Regions of orders fused as by loops over pairs; lines are shuffled for the overlaps and for the result, and nothing else is."""
    rows = small_lines(spark, tmp_path)
    df = catalog.region_merge(spark, str(tmp_path))
    assert plan_of(df).count("Exchange hashpartitioning") <= 5
    want = set()
    for o in {r[0] for r in rows}:
        lines = sorted((r for r in rows if r[0] == o), key=lambda r: (r[3], r[1], r[2], r[4], r[5]))
        box = lambda n, r, dx, sure, said: (10 * n + dx, r[1] % 3 * 4.0, 10 * n + dx + 4 + r[4] / 4, r[1] % 3 * 4.0 + 8, float(int(sure * 1000)), f"{said}{n}")
        first = [box(n, r, 0, r[6], "a") for n, r in enumerate(lines, 1)]
        second = [box(n, r, r[2] % 7, r[7], "b") for n, r in enumerate(lines, 1)]
        out, free = [("a", a[5], a[4], a[0]) for a in first], []
        for b in second:
            near = []
            for k, a in enumerate(first):
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                if w > 0 and h > 0:
                    near.append((-w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h), k))
            if near and -min(near)[0] >= regions.MATCH:
                k = min(near)[1]
                if b[4] > first[k][4]:
                    out[k] = ("b", b[5], b[4], b[0])
            else:
                free.append(("b", b[5], b[4], b[0]))
        want |= {(o, pos, *r) for pos, r in enumerate(out + free)}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want


def test_runs_of_tags_take_two_orders(spark):
    """Tokens are sorted once by place and once by run; a tag that comes again, also a null one, begins a run of its own."""
    tags = [prepare.SELLER, prepare.SELLER, None, None, prepare.SELLER, 0, prepare.SELLER]
    df = spark.createDataFrame([(1, 2 * i, w, t) for i, (w, t) in enumerate(zip("Ann 12 x y Bob z Cid".split(), tags, strict=True))], "doc long, i int, token string, tag int")
    got = prepare.refined_labels(df, "doc")
    assert plan_of(got).count("Sort [") == 2 and got.columns == ["doc", "i", "token", "tag", "label"]
    assert [r.label for r in got.orderBy("i").collect()] == ["NAME", "ADDRESS", "O", "O", "NAME", "O", "NAME"]
