import json

import numpy as np
from pyspark.sql import functions as F

from scrivane import __main__ as shell
from scrivane.functions import image as im
from scrivane.operators import analyze, documents, gbdt, images

MODEL = gbdt.Model.load(json.dumps({"is_document": [{"split": "f12", "split_condition": 100.0, "children": [{"leaf": -1.0}, {"leaf": 1.0}]}], "is_paper": [{"leaf": 0.0}]}))
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def test_analysis_of_two_recognisers(spark):
    pics = images.pattern_images(spark.range(3), 24)
    w = lambda t, x, c: (t, (x, 0.0, x + 8.0, 8.0), c)
    trees = spark.createDataFrame(
        [(0, [("PT_FLOWING_TEXT", [([([w("mail", 0.0, 90.0), w("a@example.com", 10.0, 40.0), w(" ", 20.0, 1.0)],)],)])]), (1, [("odd", [([([w("only", 0.0, 50.0)],)],)])])],
        f"doc_id long, blocks array<struct<blocktype: string, paragraphs: array<struct<lines: array<struct<words: array<struct<text: string, bbox: {BOX}, confidence: double>>>>>>>>",
    )
    lists = spark.createDataFrame([(0, [("a@example.org", [10.0, 0.0, 18.0, 8.0], 80.0), ("new", [100.0, 0.0, 108.0, 8.0], None)])], "doc_id long, regions array<struct<text: string, bbox: array<double>, confidence: double>>")
    out = {r.id: r for r in analyze.analyse(pics, MODEL, trees, lists, now=F.lit("2024-01-01").cast("timestamp")).collect()}
    assert [r.text for r in out["0"].regions] == ["mail", "a@example.org", "new"] and out["0"].regions[1].reason == "won (80.0) over 40.0, IoU=100%"
    assert [(h.kind, h.text) for h in out["0"].pii] == [("EMAIL", "a@example.org")]
    assert [r.text for r in out["1"].regions] == ["only"] and out["2"].regions == [] and out["2"].pii == []
    assert all(0 <= r.classification.is_document <= 1 and r.classification.is_paper == 0.5 for r in out.values())
    one = analyze.analyse(pics, MODEL, None, lists)
    assert {r.id: len(r.regions) for r in one.collect()} == {"0": 2, "1": 0, "2": 0} and documents.violations(one).count() == 0


def test_only_groups_that_trees_look_at_are_computed(spark, monkeypatch):
    """Scores are those over all 81 features, by expressions and in batches, of one group of seven."""
    asked, whole = [], images.features
    pics = images.pattern_images(spark.range(5), 24)
    want = {r.id: (r.is_document, r.is_paper) for r in gbdt.score(whole(pics), MODEL, im.names()).collect()}
    monkeypatch.setattr(images, "features", lambda df, groups=tuple(im.GROUPS), longest=None: asked.append(groups) or whole(df, groups, longest))
    for nodes in (gbdt.EXPRESSION_NODES, 0):
        monkeypatch.setattr(gbdt, "EXPRESSION_NODES", nodes)
        assert {r.id: (r.is_document, r.is_paper) for r in analyze.classify(pics, MODEL).collect()} == want
    assert asked == [("color",)] * 2 and im.groups_of({18, 19, 80}) == ("color", "edges", "document")


def test_shell(spark, tmp_path):
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics/a.png").write_bytes(im.png(np.full((20, 20, 3), 200, np.uint8)))
    shell.main(["features", str(tmp_path / "pics"), str(tmp_path / "f")])
    (tmp_path / "m.json").write_text(MODEL.dump())
    shell.main(["score", str(tmp_path / "f"), str(tmp_path / "m.json"), str(tmp_path / "s")])
    assert spark.read.parquet(str(tmp_path / "s")).first().is_document > 0.7
    spark.createDataFrame([(1, "x@example.com yes")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    shell.main(["scan", str(tmp_path / "t"), str(tmp_path / "h")])
    assert spark.read.parquet(str(tmp_path / "h")).count() == 1
