"""The enriched document: one nested row with its image, scores, regions, hits, annotations and redactions, and changes to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = "struct<id: string, regionId: string, fieldType: string, confidence: double, manual: boolean, timestamp: string>"
SCORES = tuple(f"is_{x}" for x in "document digital paper crumpled shadow".split())


def build(docs: DataFrame, regions: DataFrame, hits: DataFrame, key: str = "doc_id", version: str = "1", now: Column | None = None) -> DataFrame:
    """A row a document. docs: (key, image, classification) and what else; regions and hits by key. now: injected for fixed results."""
    r = regions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in regions.columns if c != key]))).alias("regions"))
    h = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "text"))).alias("pii"))
    stamp = F.date_format(F.coalesce(now, F.current_timestamp()) if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    empty = lambda c, like: F.coalesce(c, F.array().cast(like))
    out = docs.join(r, key, "left").join(h, key, "left")
    return out.select(
        F.col(key).cast("string").alias("id"), stamp.alias("createdAt"), "image", "classification", empty(F.col("regions"), r.schema["regions"].dataType).alias("regions"),
        empty(F.col("pii"), h.schema["pii"].dataType).alias("pii"), F.array().cast(f"array<{FIELD}>").alias("fields"), F.array().cast("array<string>").alias("redactionIds"),
        F.struct(F.lit("spark").alias("engine"), F.lit(version).alias("version")).alias("provenance"),
    )


def region(region_id: Column) -> Column:
    return F.get(F.filter("regions", lambda r: r["id"] == region_id), F.lit(0))


def _known(region_id: Column, value: Column) -> Column:
    """The value, or an error at run time if the document has no such region."""
    return F.when(F.exists("regions", lambda r: r["id"] == region_id), value).otherwise(F.raise_error(F.concat(F.lit("no region "), region_id)))


def redactions(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.filter("regions", lambda r: F.array_contains(F.col("redactionIds"), r["id"])).alias("redactions"))


def add_field(docs: DataFrame, region_id: Column, field_type: Column, confidence: float = 0.9, field_id: Column | None = None, stamp: Column | None = None) -> DataFrame:
    new = F.struct(
        F.coalesce(field_id, F.expr("uuid()")).alias("id") if field_id is not None else F.expr("uuid()").alias("id"), region_id.alias("regionId"), field_type.alias("fieldType"), F.lit(confidence).alias("confidence"), F.lit(True).alias("manual"),
        (stamp if stamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("timestamp"),
    )
    return docs.withColumn("fields", _known(region_id, F.array_append("fields", new)))


def remove_field(docs: DataFrame, field_id: Column) -> DataFrame:
    return docs.withColumn("fields", F.filter("fields", lambda f: f["id"] != field_id))


def redact(docs: DataFrame, region_id: Column) -> DataFrame:
    return docs.withColumn("redactionIds", _known(region_id, F.array_union("redactionIds", F.array(region_id))))


def unredact(docs: DataFrame, region_id: Column) -> DataFrame:
    return docs.withColumn("redactionIds", F.array_remove("redactionIds", region_id))


def to_json(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.to_json(F.struct(*docs.columns)).alias("json"))


def from_json(rows: DataFrame, schema) -> DataFrame:
    return rows.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def _problems() -> Column:
    """The names of the constraints that a document breaks."""
    score = lambda c: F.col(f"classification.{c}")
    checks = {
        "score outside 0 to 1": F.col("classification").isNotNull() & ~F.forall(F.array(*[score(c) for c in SCORES]), lambda x: x.between(0, 1)),
        "image size": ~((F.col("image.width") > 0) & (F.col("image.height") > 0)),
        "region confidence": F.exists("regions", lambda r: ~r["confidence"].between(0, 100)),
        "hit offsets": F.exists("pii", lambda h: (h["start"] < 0) | (h["end"] < h["start"])),
        "field confidence": F.exists("fields", lambda f: ~f["confidence"].between(0, 1)),
        "redaction of no region": F.exists("redactionIds", lambda i: ~F.exists("regions", lambda r: r["id"] == i)),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())


def violations(docs: DataFrame) -> DataFrame:
    """(id, problem): rows for every broken constraint; documents without rows are valid."""
    return docs.select("id", F.explode(_problems()).alias("problem"))


def replaced(docs: DataFrame, **values: Column) -> DataFrame:
    """Documents with other values in some of their columns; an error at run time if one then breaks a constraint. Other columns go."""
    known = [c for c in values if c in docs.columns]
    out = docs.withColumns({c: values[c] for c in known})
    checked = F.when(F.size("_problems") == 0, F.col("id")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("document"), "id", F.lit("is invalid:"), F.array_join("_problems", ", "))))
    return out.withColumn("_problems", _problems()).withColumn("id", checked).select(*docs.columns)
