"""Corpus pipeline: language ID, exact and near deduplication, decontamination, then sampled SentencePiece encodings.

Each stage works on all that the one before kept, written as Parquet and read again. All but the last return the
columns of documents, and any more columns that these had, under whatever names.

Rows are told apart by their text. A null text counts as empty: it is in no language, so the first stage drops it,
whatever its id; so go blank texts and those without a letter. Of rows that repeat a text one stays, the smallest
doc_id, of equal ones the first by its other columns; null ids come last. Rows that repeat a doc_id with different
texts are different documents, and so are rows without one. The last stage names samples by doc_id alone: rows that
share one, or have none, can't be told apart there. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontaminate, exact_dedup, langid, sentence_pieces, simhash
from strandloom.llm.common import materialise, table

#: Lattices that a worker keeps and characters sampled together: fewer than ``encode`` takes by itself, as a worker's memory also holds what earlier stages left.
LATTICES, SLICE_CHARS = 30_000, 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go, null and blank texts among them."""
    return langid.identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest doc_id stays, null ids last."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays, null ids last, of equal ids the first text."""
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 or more of its five-word shingles) go, whatever their id."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that stayed."""
    return sentence_pieces.encode(docs, sentence_pieces.default_path(), lattices=LATTICES, slice_chars=SLICE_CHARS)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("sentence_pieces", encode_pieces),
]

#: SQL can express neither the language mixture nor the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
