"""The corpus pipeline: language, lines, near copies, mixing, packing.

``STAGES`` are run one after another; every stage gets what its predecessor
kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.llm import jaccard, language, lines, mixing, packing
from mediaspark.llm.queries import BYTE_RANKS, PIECES
from mediaspark.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; ``lang`` becomes the predicted one.

    Rejected: texts that are null or have no letter, and texts less likely, letter by letter, than
    the learned documents of their best language can be; model and floors come from all of them.  A null id is kept; repeated rows are judged each.
    """
    learned = docs.filter(~language.held_out())
    model = language.fit(learned, PIECES, per_lang=None)
    found = language.known_language(docs, model, language.floors(learned, model, per_lang=None))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line are taken out; a document that had text and is left with none goes.

    Rows of equal or null ids are documents of their own, in the order of the rows.
    """
    kept = lines.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).filter("trim(both ' \t\n\r' from text) <> ''").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays: the first of repeated rows; null ids come last."""
    return jaccard.without_near_copies(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times; a null source is a source of its own."""
    return mixing.repeated(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a packed sequence; repeated rows are packed each, null ids stay null."""
    return packing.pack_documents(docs, BYTE_RANKS)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Stages with a trained model, a tokenizer and a search are beyond SQL; see tests/llm for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; intermediate tables go to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
