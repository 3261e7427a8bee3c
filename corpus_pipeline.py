"""A corpus pipeline of five operators: STAGES in order, run() over documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. No SQL is given: the additive model, the mixing and the sampled
segmentations have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivane.llm.common import store, table
from scrivane.llm.mixing import keep_mixed
from scrivane.llm.near_dedup import keep_one
from scrivane.llm.piece_lattice import sampled_pieces
from scrivane.llm.quality_rules import keep_good
from scrivane.llm.queries import counting_tokenizer
from scrivane.llm.substring_dedup import drop_repeats

PIECES = "piece_bpe_32k.model"
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a document of a smaller doc_id has in the same 13-word window go."""
    return drop_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their fitted rates: good ones keep their weight, a quarter of the poor stays, toxic ones go. Few have two copies."""
    return keep_mixed(docs, table(spark, sf_dir, "labels"), tokenizer=counting_tokenizer())


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of every document that is left."""
    import public_tokenizers as public

    return sampled_pieces(docs, public.path(PIECES))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mixing),
    ("sampled pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
