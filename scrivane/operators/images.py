"""Images as rows: reading, the 81 features in one Arrow pass, the long pixel table, redaction."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import image as im
from .parts import spread

#: Numbers of which a task makes pictures.
PATTERNS = 2000
IMAGE = "id string, width int, height int, rgb binary"


def rgb_images(df: DataFrame, longest: int | None = 512) -> DataFrame:
    """Rows of Spark's image source as (id, width, height, rgb), red first, scaled down to `longest`. Undecodable ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, h, w, c, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rgb = im.from_spark(data, h, w, c)
                rgb = im.fit_within(rgb, longest) if longest else rgb
                out.append((name, rgb.shape[1], rgb.shape[0], np.ascontiguousarray(rgb).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["id", "width", "height", "rgb"])

    good = df.where("image.width > 0 AND image.nChannels IN (1, 3, 4)")
    return good.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, IMAGE)


def features(images: DataFrame, groups: tuple[str, ...] = tuple(im.GROUPS), longest: int | None = None) -> DataFrame:
    """(id, f0 ... f80) or the columns of some groups; groups that aren't asked for aren't computed. Images of one size in a batch are worked on together."""
    columns = im.names(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, sizes = batch.column(3), defaultdict(list)
            for k, size in enumerate(zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                sizes[size].append(k)
            table = np.empty((batch.num_rows, len(columns)))
            for (h, w), of in sizes.items():
                step = max(1, im.STACK_PIXELS // max(h * w, 1))
                for at in (of[k : k + step] for k in range(0, len(of), step)):
                    pictures = [np.frombuffer(raw[k].as_buffer(), np.uint8).reshape(h, w, 3) for k in at]
                    table[at] = im.extract_all(np.stack([im.fit_within(x, longest) if longest else x for x in pictures]), groups)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(len(columns)))], ["id", *columns])

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "width", "height", "rgb").mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in columns))


def feature_vector(df: DataFrame) -> DataFrame:
    """The wide columns as one array, the form that files hold."""
    return df.select("id", F.array(*[c for c in df.columns if c != "id"]).alias("features"))


def register_functions(spark: SparkSession) -> None:
    """SQL function extract_features(rgb, width, height): an array of 81 doubles."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def extract_features(rgb, width, height):
        return pd.Series([im.extract(np.frombuffer(b, np.uint8).reshape(h, w, 3)) for b, w, h in zip(rgb, width, height, strict=True)])

    spark.udf.register("extract_features", extract_features)


def pixels(images: DataFrame) -> DataFrame:
    """(id, y, x, r, g, b, gray): the long form for relational work, exploded in the JVM."""
    at = F.posexplode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i", "_")
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(rgb, 3 * i + {k + 1}, 1)")), 16, 10).cast("int")
    long = images.select("id", "width", "rgb", at).select("id", F.expr("i div width").cast("int").alias("y"), F.expr("i % width").cast("int").alias("x"), *[byte(k).alias(c) for k, c in enumerate("rgb")])
    return long.withColumn("gray", 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))


def gray_summary(px: DataFrame) -> DataFrame:
    """Mean, histogram median, deviation and entropy of the gray plane, from a 256-bin histogram an image."""
    hist = px.groupBy("id", F.floor("gray").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy("bin")
    run = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("id")))
    shape = run.groupBy("id").agg(F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2), F.col("bin"))).alias("median"), (-F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("total")))).alias("entropy"))
    return px.groupBy("id").agg(F.avg("gray").alias("mean"), F.stddev_pop("gray").alias("std")).join(shape, "id")


def laplacian_variance(px: DataFrame) -> DataFrame:
    """Borders repeat the pixel itself, so a missing neighbour contributes its own value."""
    row, col = Window.partitionBy("id", "y").orderBy("x"), Window.partitionBy("id", "x").orderBy("y")
    g = F.col("gray")
    near = [F.coalesce(f("gray").over(w), g) for f in (F.lag, F.lead) for w in (row, col)]
    return px.select("id", (4 * g - near[0] - near[1] - near[2] - near[3]).alias("v")).groupBy("id").agg(F.var_pop("v").alias("laplacian_variance"))


def run_lengths(px: DataFrame, dark: str) -> DataFrame:
    """(id, y, start, length): runs of pixels for which the SQL condition `dark` holds; gaps and islands."""
    w = Window.partitionBy("id", "y").orderBy("x")
    marked = px.where(dark).select("id", "y", "x", (F.col("x") - F.row_number().over(w)).alias("island"))
    return marked.groupBy("id", "y", "island").agg(F.min("x").alias("start"), F.count("*").alias("length")).drop("island")


def redacted_png(df: DataFrame) -> DataFrame:
    """(id, width, height, rgb, boxes: array of x0, y0, x1, y1 structs) as (id, png) with the boxes in black."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, raw, boxes in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                rgb = np.frombuffer(raw, np.uint8).reshape(h, w, 3)
                out.append(im.png(im.blacken(rgb, [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in boxes or []])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "png"])

    return df.select("id", "width", "height", "rgb", "boxes").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, png binary")


def pattern_images(ids: DataFrame, size: int, step: int = 12) -> DataFrame:
    """A deterministic image for each number in the column id: r = (step x + id) & 255, g = step y & 255, b = step (x + y) / 2 & 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:size, :size]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw = [np.stack([(step * x + k) & 255, (step * y) & 255, (step // 2 * (x + y)) & 255], 2).astype(np.uint8).tobytes() for k in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([size] * len(ids), pa.int32()), pa.array([size] * len(ids), pa.int32()), pa.array(raw, pa.binary())], ["id", "width", "height", "rgb"])

    return spread(ids.select(F.col("id").cast("long").alias("id")), PATTERNS).mapInArrow(run, "id long, width int, height int, rgb binary")
