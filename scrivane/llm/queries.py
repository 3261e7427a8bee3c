"""The registered queries of the corpus operators, one per operator, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chat import repair_chats
from .common import table
from .quality_model import quality_scores
from .quality_rules import quality_rules
from .fingerprints import fingerprint_pairs
from .mixing import mixing_rates
from .near_dedup import near_dedup
from .piece_lattice import sampled_pieces
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .warc import archive_round_trip

TOKENIZER, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def counting_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path(TOKENIZER), public.path(RANKS), public.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), *counting_tokenizer())


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return sampled_pieces(table(spark, sf_dir, "documents"), public.path(PIECES))


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), tokenizer=counting_tokenizer())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
