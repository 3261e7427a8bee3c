"""The whole analysis as one plan keyed by document: scores, fused regions, text, hits, and the nested result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crf
from ..functions.image import groups_of, names
from . import documents, gbdt, images, regions, text


def classify(pictures: DataFrame, model: gbdt.Model, longest: int = 512) -> DataFrame:
    """(id, width, height, rgb) as (id, one chance a label). Only groups of features that the trees look at are computed."""
    groups = groups_of(model.features() or {0})
    return gbdt.score(images.features(pictures, groups, longest), model, names()).select("id", *model.trees)


def _placed(found: DataFrame) -> DataFrame:
    """Regions numbered within their document, in reading order of their ids' numbers."""
    order = F.transform(F.split(F.regexp_replace("id", "[^0-9]+", " ").substr(2, 60), " "), lambda x: x.cast("int"))
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1)


def analyse(pictures: DataFrame, model: gbdt.Model, trees: DataFrame | None = None, lists: DataFrame | None = None, tagger: crf.Model | None = None, now=None) -> DataFrame:
    """Enriched documents. pictures: (id, width, height, rgb); trees and lists: outputs of two recognisers by doc_id, either or both.

    A document that one recogniser says nothing about keeps the other's regions; one without regions has none, and one whose picture
    has no scores has a null classification.
    """
    scored = classify(pictures, model)
    labels = [c for c in documents.SCORES if c in model.trees]
    struct = F.struct(*[(F.col(c) if c in labels else F.lit(None).cast("double")).alias(c) for c in documents.SCORES])
    docs = pictures.select(F.col("id").alias("doc_id"), F.struct("width", "height").alias("image")).join(scored.select(F.col("id").alias("doc_id"), struct.alias("classification")), "doc_id", "left")
    a = _placed(regions.flatten_tree(trees)) if trees is not None else None
    b = _placed(regions.normalise_list(lists)) if lists is not None else None
    if a is not None and b is not None:
        fused = regions.merge_regions(a, b)
    else:
        only = a if a is not None else b
        fused = only.select("doc_id", "pos", "source", "text", "bbox", "confidence", F.lit(None).cast("string").alias("reason"))
    fused = fused.withColumn("id", F.format_string("r%06d", "pos"))
    said = regions.text_of(fused)
    hits = text.pii_hits(said, "doc_id", model=tagger).select("doc_id", "start", "end", "kind", "text")
    return documents.build(docs, fused.select("doc_id", "id", "text", "bbox", "confidence", "source", "reason"), hits, now=now)
