"""Reading and writing the library's files: label tables, feature tables, images, recognised words, truth samples, models, reports."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crf
from ..functions.image import N_FEATURES
from ..operators import gbdt, images

LABELS = tuple(f"is_{x}" for x in "document digital paper crumpled shadow".split())
LABEL_SCHEMA = "filename string, " + ", ".join(f"{x} int" for x in LABELS)
TRUTH_SCHEMA = "totalInvoices long, tag5Regions long, tag13Regions long, typeCounts map<string,long>, panPatternCount long, samples array<struct<tokens: array<string>, tags: array<int>>>"
WORDS_SCHEMA = "filename string, ocrText string, words array<struct<text: string, bbox: array<int>, confidence: double>>, confidence double"
PICTURES = "*.{png,PNG,jpg,JPG,jpeg,JPEG,bmp,tif,tiff,webp}"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir); only a session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="scrivane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)


def write_labels(df: DataFrame, path: str, seed: int = 42) -> None:
    """In a fixed shuffled order."""
    df.select("filename", *LABELS).orderBy(F.xxhash64("filename", F.lit(seed)), "filename").write.mode("overwrite").option("header", True).csv(path)


def read_images(spark: SparkSession, path: str, longest: int | None = 512) -> DataFrame:
    """Decoded pictures of a directory tree as (id, width, height, rgb)."""
    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return images.rgb_images(df, longest)


def read_bytes(spark: SparkSession, path: str, glob: str = PICTURES) -> DataFrame:
    """(path, content) of a tree's picture files, undecoded."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def data_urls(df: DataFrame, content: str = "content", kind: str = "image/png") -> DataFrame:
    """df with a column `url`: the bytes as a base64 data URL."""
    return df.withColumn("url", F.concat(F.lit(f"data:{kind};base64,"), F.base64(content)))


def from_data_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """df with a column `content`: the bytes of data URLs, or of bare base64; null for text that is neither."""
    return df.withColumn("content", F.try_to_binary(F.regexp_replace(url, "^data:[^,]*,", ""), F.lit("base64")))


def read_image_parquet(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The picture bytes of Parquet files whose column `image` is binary or a struct with bytes; rows without any go."""
    df = spark.read.parquet(path)
    kind = df.schema["image"].dataType.typeName()
    raw = F.col("image.bytes") if kind == "struct" else F.col("image")
    df = df.select(raw.cast("binary").alias("content")).where(F.octet_length("content") > 0)
    return df.limit(most) if most else df


def write_features(df: DataFrame, path: str) -> None:
    """(filename, features: array<double>, labels...) as Parquet; appending merges parts."""
    df.write.mode("append").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def wide(df: DataFrame, n: int = N_FEATURES) -> DataFrame:
    """The array of features as columns f0, f1, ..."""
    return df.select("*", *[F.col("features")[k].alias(f"f{k}") for k in range(n)]).drop("features")


def write_archive(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A NumPy archive for tools that want one: features, labels, filenames, label_names. For tables that fit the driver."""
    rows = df.select("filename", "features", *LABELS).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write Parquet")
    np.savez_compressed(path, features=np.array([r["features"] for r in rows]), labels=np.array([[r[x] for x in LABELS] for r in rows], np.int8), filenames=np.array([r["filename"] for r in rows]), label_names=np.array(LABELS))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(filename, features, labels) of NumPy archives: several files are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                z = np.load(io.BytesIO(raw), allow_pickle=False)
                x, y, f = z["features"], z["labels"], z["filenames"]
                yield pa.RecordBatch.from_arrays([pa.array(f.tolist(), pa.string()), pa.array(list(x), pa.list_(pa.float64())), *(pa.array(y[:, k].astype(np.int32)) for k in range(len(LABELS)))], ["filename", "features", *LABELS])

    return read_bytes(spark, path, "*.npz").mapInArrow(run, "filename string, features array<double>, " + ", ".join(f"{x} int" for x in LABELS))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc, tokens, tags) of a file {samples: [{tokens, tags}], ...}."""
    df = spark.read.schema(TRUTH_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.select(F.posexplode("samples").alias("doc", "s")).select("doc", "s.tokens", "s.tags")


def truth_tokens(truth: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, token, tag)."""
    return truth.select(key, F.posexplode(F.arrays_zip("tokens", "tags")).alias("i", "p")).select(key, "i", F.col("p.tokens").alias("token"), F.col("p.tags").alias("tag"))


def read_words(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Recognised words: files that are one JSON array each, or, as write_words makes them, a JSON object a line."""
    return spark.read.schema(WORDS_SCHEMA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def write_words(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.write.mode("overwrite").json(path)


def tsv_words(df: DataFrame, key: str, tsv: str = "tsv") -> DataFrame:
    """Words of a recogniser's tab-separated report: lines of level 5 with text; columns 7 to 10 are left, top, width and height, and a
    missing confidence is 0."""
    lines = df.select(key, F.posexplode(F.split(tsv, "\n")).alias("line", "s")).withColumn("c", F.split("s", "\t"))
    num = lambda k, t="int": F.coalesce(F.try_element_at("c", F.lit(k)).try_cast(t), F.lit(0).cast(t))
    words = lines.where((F.try_element_at("c", F.lit(1)) == "5") & (F.trim(F.coalesce(F.try_element_at("c", F.lit(12)), F.lit(""))) != ""))
    box = F.struct(num(7).alias("x0"), num(8).alias("y0"), (num(7) + num(9)).alias("x1"), (num(8) + num(10)).alias("y1"))
    return words.select(key, "line", F.trim(F.col("c")[11]).alias("text"), box.alias("bbox"), num(11, "double").alias("confidence"))


def image_number(filename) -> F.Column:
    """The number of a file named fatura2_train_12 or fatura2_test_12; test files follow the 8600 training files. Null for others."""
    n = F.regexp_extract(filename, r"fatura2_(test|train)_([0-9]+)", 2)
    part = F.regexp_extract(filename, r"fatura2_(test|train)_([0-9]+)", 1)
    return F.when(n != "", n.try_cast("int") + F.when(part == "test", 8600).otherwise(0))


def load_gbdt(text: str, labels: list[str] | None = None) -> gbdt.Model:
    return gbdt.Model.load(text, labels)


def load_crf(text: str) -> crf.Model | None:
    """Nothing for an empty text."""
    return crf.Model.load(text) if text.strip() else None


def write_report(df: DataFrame, path: str) -> None:
    """A small table of results as one JSON file."""
    df.repartition(1).write.mode("overwrite").json(path)


def write_diagnostics(hits: DataFrame, docs: DataFrame, key: str, path: str, cap: int = 200, reach: int = 60) -> None:
    """At most `cap` hits a kind with `reach` characters on either side, for people to read."""
    from ..operators.evaluate import samples

    context = F.substring("doc_text", F.greatest(F.col("start") - reach, F.lit(0)) + 1, F.col("end") - F.col("start") + 2 * reach)
    some = samples(hits, "kind", key, cap)
    some.join(docs.select(key, F.col("text").alias("doc_text")), key).withColumn("context", context).drop("doc_text").repartition(1).write.mode("overwrite").json(path)


def dataset_catalogue(spark: SparkSession) -> DataFrame:
    """The public datasets that labels are known for."""
    from ..operators.prepare import DATASETS

    return spark.createDataFrame([(k, *v) for k, v in DATASETS.items()], "dataset string, " + ", ".join(f"{x} int" for x in LABELS))


def model_size(text: str) -> dict[str, float]:
    import gzip

    raw = text.encode()
    return {"kb": round(len(raw) / 1024, 1), "gzip_kb": round(len(gzip.compress(raw)) / 1024, 1)}


