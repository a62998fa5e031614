"""The corpus pipeline: five stages over documents.

Each stage takes all that its predecessor kept, written as Parquet and read
again, and returns the columns of documents; the last returns token counts and
digests. Classifiers learn from the labelled rows among a stage's documents.

Defined results, for every stage: an empty table gives an empty table; extra
columns are carried along (but by the last stage), whatever their names; rows
that repeat are judged alike. Null texts count as empty ones. What each stage
makes of nulls, empty texts, ties and repeated ids stands at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import quality_fm, sentencepiece_bpe, simhash, soft_mixing, toxicity
from textloom.llm.queries import _tokenizer, labelled_languages
from textloom.session import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts get the score of a text without words. Without labels,
    or with one kind alone, every text has the smoothed share of label 1, so all
    stay or all go. Rows without id are judged as all others; they can't be labelled.
    """
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.

    Null and empty texts get the score of no words; without labels, or with one
    kind alone, the score is the smoothed share of label 1. A score of exactly the
    threshold is rejected.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Null and empty texts share the fingerprint zero, so one of them stays. Of
    rows that repeat an id one stays; rows without id can't be told apart and
    all stay.
    """
    return simhash.keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix asks for: languages at smoothed shares, every document at least once.

    Null and empty texts have no tokens and stay once or as often as their
    posterior's rate says. Without labelled documents every rate is one. Copies
    of a row are equal rows.
    """
    return soft_mixing.mix(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), min_rate=1.0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text; null and empty texts have no tokens."""
    return sentencepiece_bpe.encode_documents(docs, _tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Trained classifiers and iterative fits are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
