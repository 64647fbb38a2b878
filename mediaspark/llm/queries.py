"""Registered queries of the operators: each applies its operator to a whole table.

``ORACLES`` has DuckDB SQL where SQL can express the result; the others are
held against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audio, binary, counting, jaccard, language, lines, mixing, packing, pieces, ranking, sketch, substrings, variants

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the same vocabulary as ranks
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank file gives the ids of ``BYTE_BPE`` (held against that library in the tests) in a third of the time."""
    return packing.pack_documents(documents(spark, sf_dir), BYTE_RANKS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTF-8 bytes of every whole text are the unsigned 8-bit samples of its recording."""
    return audio.align(documents(spark, sf_dir).selectExpr("doc_id", "cast(text as binary) audio"), "audio")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op5_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.packed_matrices(documents(spark, sf_dir), BYTE_RANKS)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir), PIECES)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(documents(spark, sf_dir), PIECES)


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants_of(documents(spark, sf_dir))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_audio": op3_audio,
    "op4_jaccard": op4_jaccard,
    "op5_matrices": op5_matrices,
    "op6_language": op6_language,
    "op7_fingerprints": op7_fingerprints,
    "op8_substrings": op8_substrings,
    "op9_lines": op9_lines,
    "op10_token_counts": op10_token_counts,
    "op11_ranking": op11_ranking,
    "op12_variants": op12_variants,
    "op13_pieces": op13_pieces,
}
ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op4_jaccard": jaccard.ORACLE, "op9_lines": lines.ORACLE, "op11_ranking": ranking.ORACLE}
