"""Bounded samples of labelled rows for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, held_out: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and labels (0 or 1) of at most ``max_rows`` labelled documents.

    Rows whose crc32(id) mod 4 is ``held_out`` are left out. Ids are taken in
    the order of their hash, so the sample neither depends on the order of rows
    nor favours a source. Null labels don't count; of several labels for one id
    the mean decides, one half upwards as 1; of several texts for one id the
    smallest counts. The chosen ids, ``max_rows`` at
    most, are broadcast; documents aren't shuffled.
    """
    known = labels.select(F.col(id_col).alias("k"), F.col(label).cast("double").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    if held_out is not None:
        known = known.where(remainder("k", 4) != held_out)
    chosen = known.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("k"))
    return found.groupBy("k").agg(F.min("t").alias("t"), F.min("y").alias("y")).select("t", "y")
