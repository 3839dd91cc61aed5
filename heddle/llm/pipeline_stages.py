"""The stages that corpus_pipeline.py lists: each takes (spark, docs, sf_dir) and returns a table.

All but the last return the columns of documents. docs is what the stage before kept, read from Parquet; the labels
that the toxicity stage learns from are read from sf_dir.

Defined cases, of every stage: null and empty texts are texts without words and pass through (of copies of them one stays
in the SimHash stage); rows with a null doc_id are never dropped as copies; a null source is a source of its own; rows
that repeat an id and a text are treated alike, those that repeat an id with another text each by its own text; texts of
any length are treated whole; columns that documents doesn't have are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import bpe, mixing, near_copies, secrets, toxicity
from heddle.llm.common import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold. Learns from the stage's own rows that are labelled and not held out."""
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: SimHash links at three bits, and those of
    five-word shingles at a similarity of 0.8 or more (see near_copies)."""
    return near_copies.drop_near_copies(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets in its text replaced by their kind."""
    return secrets.redact_secrets(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixture: weights in proportion to the square root of a source's documents.

    Files are written in that order; since no reader promises to keep it, the last stage reads each document's file and
    row, and states its place."""
    return mixing.in_mixed_order(docs.select(*COLUMNS))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, mix_position, ids): the training tokens of every document and its place in the mixture.

    Places go by the order in which the stage before wrote the documents (see mixing); nothing is mixed again."""
    return bpe.encode(mixing.dealt_positions(docs), "mix_position")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("secrets", redact_secrets), ("mix", mix_sources), ("bpe", encode_bpe)]
