"""Text regions of several recognisers: flattening, overlap, fusion, lines and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TYPES = (
    "PT_UNKNOWN PT_FLOWING_TEXT PT_HEADING_TEXT PT_PULLOUT_TEXT PT_EQUATION PT_INLINE_EQUATION PT_TABLE PT_VERTICAL_TEXT PT_CAPTION_TEXT"
    " PT_FLOWING_IMAGE PT_HEADING_IMAGE PT_PULLOUT_IMAGE PT_HORZ_LINE PT_VERT_LINE PT_NOISE PT_COUNT"
).split()
MATCH = 0.5


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high))


def flatten_tree(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nested blocks > paragraphs > lines > words as one region a word. pages: (key, blocks).

    Empty levels and blank words give no rows; unknown block types become PT_UNKNOWN.
    """
    df = pages.select(key, F.posexplode("blocks").alias("b", "block"))
    df = df.select(key, "b", "block.blocktype", F.posexplode("block.paragraphs").alias("p", "paragraph"))
    df = df.select(key, "b", "blocktype", "p", F.posexplode("paragraph.lines").alias("l", "line"))
    df = df.select(key, "b", "blocktype", "p", "l", F.posexplode("line.words").alias("w", "word")).where(F.trim("word.text") != "")
    line = F.format_string("tess-b%d-p%d-l%d", "b", "p", "l")
    kind = F.when(F.col("blocktype").isin(BLOCK_TYPES), F.col("blocktype")).otherwise("PT_UNKNOWN")
    return df.select(key, F.format_string("tess-b%d-p%d-l%d-w%d", "b", "p", "l", "w").alias("id"), F.col("word.text").alias("text"), F.col("word.bbox").alias("bbox"), clamp(F.col("word.confidence")).alias("confidence"), F.lit("tesseract").alias("source"), kind.alias("block_type"), line.alias("parent_id"))


def normalise_list(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, regions: array of text, bbox array of four, confidence) as regions; a missing confidence is 75."""
    df = docs.select(key, F.posexplode("regions").alias("i", "r"))
    names = ("x0", "y0", "x1", "y1")
    box = F.struct(*[F.col("r.bbox")[k].cast("double").alias(n) for k, n in enumerate(names)])
    return df.select(key, F.format_string("glm-%d", "i").alias("id"), F.col("r.text").alias("text"), box.alias("bbox"), clamp(F.coalesce(F.col("r.confidence"), F.lit(75.0))).alias("confidence"), F.lit("glm-ocr").alias("source"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 without overlap."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    shared = w * h
    return F.when((w > 0) & (h > 0), shared / (size(a) + size(b) - shared)).otherwise(0.0)


def best_overlaps(first: DataFrame, second: DataFrame, key: str = "doc_id", least: float = MATCH, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each region of `second` the region of `first` that it overlaps most, if by at least `least`; the earlier wins ties. keep: columns of
    `second` that stay, as b_ and their name.

    Both have (key, pos, bbox, confidence, text). An equi-join on the document with the overlap as a filter: pairs that don't touch go
    before any grouping, and max_by keeps one row a region with partial aggregation.
    """
    a = first.select(key, F.col("pos").alias("ti"), F.col("bbox").alias("a"), F.col("confidence").alias("a_conf"))
    b = second.select(key, F.col("pos").alias("gi"), F.col("bbox").alias("b"), F.col("confidence").alias("b_conf"), *[F.col(c).alias(f"b_{c}") for c in keep])
    touch = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    pairs = a.join(b, key).where(touch).withColumn("iou", iou(F.col("a"), F.col("b")))
    best = pairs.groupBy(key, "gi").agg(F.max_by(F.struct("ti", "iou", "a_conf", "b_conf", *[f"b_{c}" for c in keep]), F.struct("iou", -F.col("ti"))).alias("m"))
    return best.where(F.col("m.iou") >= least).select(key, "gi", "m.*")


def merge_decisions(matches: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per matched region of `first`: which of `second` replaces it (the last with strictly greater confidence) or, if none, which lost first; `all` that
    match it."""
    won = F.col("b_conf") > F.col("a_conf")
    row = F.struct("gi", "iou", "a_conf", "b_conf", *[f"b_{c}" for c in keep])
    out = matches.groupBy(key, "ti").agg(
        F.max(F.when(won, row)).alias("winner"), F.min(row).alias("first_match"), F.min(F.when(won, F.col("gi"))).alias("first_win"), F.sort_array(F.collect_list("gi")).alias("all")
    )
    seen = F.when(F.col("first_win").isNull(), F.size("all")).otherwise(F.size(F.filter("all", lambda g: g <= F.col("first_win"))))
    return out.select(key, "ti", F.col("winner").isNotNull().alias("replaced"), F.coalesce("winner", "first_match").alias("d"), seen.alias("merged_pairs"), "all")


def reason(d: Column, replaced: Column) -> Column:
    win, lose = F.when(replaced, d["b_conf"]).otherwise(d["a_conf"]), F.when(replaced, d["a_conf"]).otherwise(d["b_conf"])
    against = F.when(win == lose, F.lit("equal")).otherwise(F.format_string("%.1f", lose))
    return F.concat(F.lit("won ("), F.format_string("%.1f", win), F.lit(") over "), against, F.lit(", IoU="), F.floor(d["iou"] * 100 + 0.5).cast("string"), F.lit("%"))


def merge_regions(first: DataFrame, second: DataFrame, key: str = "doc_id", least: float = MATCH) -> DataFrame:
    """Fused regions (key, pos, source, text, bbox, confidence, reason): `first` in order with winners in place, then the unmatched of `second`.

    Overlaps are found once. Regions of both and what was decided about them meet in one shuffle by document, in the order of the result.
    """
    keep, cols = ("text", "bbox"), ("text", "bbox", "confidence")
    decided = merge_decisions(best_overlaps(first, second, key, least, keep), key, keep)
    fate = F.struct("replaced", "d").alias("fate")
    about = F.concat(F.array(F.struct(F.lit(0).alias("part"), F.col("ti").alias("pos"), fate)), F.transform("all", lambda g: F.struct(F.lit(1).alias("part"), g.alias("pos"), fate)))
    one, two = (df.select(key, F.lit(part).alias("part"), "pos", F.struct(*cols).alias("own")) for part, df in enumerate((first, second)))
    rows = one.unionByName(two).unionByName(decided.select(key, F.inline(about)), allowMissingColumns=True).repartition(F.col(key))
    rows = rows.groupBy(key, "part", "pos").agg(F.first("own", True).alias("own"), F.first("fate", True).alias("fate")).where("part = 0 OR fate IS NULL")
    won, d = F.coalesce(F.col("fate.replaced"), F.lit(False)), F.col("fate.d")
    said = [F.when(won, d[f"b_{c}"]).otherwise(F.col(f"own.{c}")).alias(c) for c in keep] + [F.when(won, d["b_conf"]).otherwise(F.col("own.confidence")).alias("confidence")]
    source = F.when(won | (F.col("part") == 1), "b").otherwise("a").alias("source")
    place = (F.row_number().over(Window.partitionBy(key).orderBy("part", "pos")) - 1).alias("pos")
    return rows.select(key, place, source, *said, F.when(d.isNotNull(), reason(d, won)).alias("reason"))


def merge_stats(first: DataFrame, second: DataFrame, key: str = "doc_id", least: float = MATCH) -> DataFrame:
    """Per document: regions of each source, merged pairs, replaced regions, unmatched regions of the second."""
    matches = best_overlaps(first, second, key, least)
    m = merge_decisions(matches, key).groupBy(key).agg(F.sum("merged_pairs").alias("merged_pairs"), F.sum(F.col("replaced").cast("long")).alias("replaced"))
    n = matches.groupBy(key).agg(F.count("*").alias("matched"))
    a, b = (d.groupBy(key).agg(F.count("*").alias(c)) for d, c in ((first, "first_regions"), (second, "second_regions")))
    out = a.join(b, key, "full").join(m, key, "left").join(n, key, "left").na.fill(0)
    return out.select(key, "first_regions", "second_regions", "merged_pairs", "replaced", (F.col("second_regions") - F.col("matched")).alias("novel"))


def text_of(regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The regions' texts in order, a line each."""
    words = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return regions.groupBy(key).agg(F.array_join(F.transform(words, lambda r: r["text"]), "\n").alias("text"))


def lines(regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Regions joined by parent, left to right, with the mean confidence."""
    words = F.array_sort(F.collect_list(F.struct(F.col("bbox.x0").alias("x0"), "id", "text")))
    return regions.groupBy(key, F.coalesce("parent_id", "id").alias("line")).agg(F.array_join(F.transform(words, lambda r: r["text"]), " ").alias("text"), F.avg("confidence").alias("confidence"))


def hit_words(hits: DataFrame, regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits with the regions of the same document whose text contains theirs, case aside."""
    r = regions.select(key, F.col("id").alias("region_id"), F.col("text").alias("region_text"))
    return hits.join(r, key).where(F.contains(F.lower("region_text"), F.lower("text")))


def in_rectangle(regions: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    b = F.col("bbox")
    return regions.where((b["x0"] < x1) & (b["x1"] > x0) & (b["y0"] < y1) & (b["y1"] > y0))


def to_pixels(boxes: DataFrame) -> DataFrame:
    """Layout boxes (bbox in thousandths, task, width, height) in whole pixels within the image; only text, table and formula stay."""
    axis = lambda name, size: F.least(F.greatest((F.col(f"bbox.{name}") / 1000 * F.col(size)).cast("int"), F.lit(0)), F.col(size))
    return boxes.where(F.col("task").isin("text", "table", "formula")).withColumn("bbox", F.struct(*[axis(n, s).alias(n) for n, s in (("x0", "width"), ("y0", "height"), ("x1", "width"), ("y1", "height"))]))


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def parse_or_wrap(text: Column) -> Column:
    """The text if it is JSON, else {"text": ...}, as a JSON string."""
    return F.when(F.get_json_object(text, "$").isNotNull(), text).otherwise(F.to_json(F.struct(text.alias("text"))))


def ranked_scores(df: DataFrame, labels: list[str]) -> DataFrame:
    """An array of (label, score), the greatest first."""
    entries = F.array(*[F.struct((-F.col(x)).alias("k"), F.lit(x).alias("label"), F.col(x).alias("score")) for x in labels])
    return df.withColumn("ranked", F.transform(F.array_sort(entries), lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score"))))
