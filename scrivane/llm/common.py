"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Only a session without that setting, as in tests on one machine, gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="scrivane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that store() wrote, when nothing that is still to run reads them."""
    for df in tables:
        fs, at = _file_system(df.sparkSession, df._stored_at)
        fs.delete(at, True)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column: one scan with a partial sum per task."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def blocks_for(spark: SparkSession, n_bytes: int, block_bytes: int) -> int:
    return max(shuffle_parts(spark), math.ceil(n_bytes / block_bytes))


def salted_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame | None, total: int, salt_by: str, chunk: int = 50_000, how: str = "inner") -> DataFrame:
    """Join of `many` with `one`, where some key may hold a large share of `many` but few rows of `one`; how: inner or left.

    counts has (key, n): the rows of `many` per key (None: counted here); total is the number of those rows. A key of more than
    max(chunk, total / 2000) rows is spread over salts, and its rows in `one` are repeated for each; all others have salt 0.
    At most 2000 keys can be that frequent, which bounds the table that is broadcast. If all rows are no more than one chunk, no key
    can be, and the join is a plain one.
    """
    if total <= chunk:
        return many.join(one, key, how)
    if counts is None:
        counts = many.groupBy(key).agg(F.count("*").alias("n"))
    least = max(chunk, total // 2000)
    hot = F.broadcast(counts.where(F.col("n") > least).select(key, F.ceil(F.col("n") / chunk).cast("int").alias("_salts")))
    left = many.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def possible(rows: DataFrame, column: str, ids: DataFrame, n_ids: int, most_bits: int = 1 << 26) -> DataFrame:
    """Rows whose id may be among `ids` (one column of longs): all that are, and few others, about one in 16 of these. For a join of large rows with ids too
    many to be broadcast, so that only these rows are shuffled; the join itself must follow.

    A bitmap of 16 bits an id is broadcast, as rows of 64 bits. It has at most `most_bits`; beyond, more rows stay, and the join is as exact.
    """
    bits = min(max(64, 1 << math.ceil(math.log2(16 * max(1, n_ids)))), most_bits)
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    at = ids.select(F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(bits)).alias("_slot"))
    words = at.groupBy(F.expr("_slot DIV 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_slot % 64 AS INT)))").alias("_bits"))
    found = rows.withColumn("_slot", slot).withColumn("_word", F.expr("_slot DIV 64")).join(F.broadcast(words), "_word")
    return found.where("bit_get(_bits, CAST(_slot % 64 AS INT)) = 1").select(*rows.columns)
