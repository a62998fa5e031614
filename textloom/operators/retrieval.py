"""Keyword retrieval by word stems, and context strings from what was found."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.windows import top_k
from textloom.session import materialise


#: Records whose words are looked up in one task, and questions that ask there, about.
RECORDS, QUESTIONS = 4096, 2048


def search(queries: DataFrame, records: DataFrame, k: int = 5, most: int = 5) -> DataFrame:
    """(query_id, rank, record_id, overlap): the records that share most query words by stem.

    ``queries`` has query_id and text, ``records`` record_id and text. Words of
    fewer than three letters don't count; a query word that occurs twice counts
    twice. Words meet on their first four letters, words of three with any that
    begin so. Ties go to the smaller record_id; ``k`` is held below ``most``.

    Questions meet blocks of ``RECORDS`` records and take their first ones from
    each, so no pair of a question and a record is written but these, and a task
    holds one block's words and a number for each of its records.
    """
    k = max(0, min(k, most))
    long = lambda c: F.filter(T.words(T.fold(c)), lambda w: F.length(w) >= 3)
    # rows that share an id are one
    q = queries.groupBy("query_id").agg(F.flatten(F.collect_list(long(F.col("text")))).alias("w")).where(F.size("w") > 0)
    r = materialise(records.groupBy("record_id").agg(F.array_distinct(F.flatten(F.collect_list(long(F.col("text"))))).alias("w")).where(F.size("w") > 0), "records")
    blocks = max(1, math.ceil(r.count() / RECORDS))
    r = r.withColumn("block", F.pmod(F.xxhash64("record_id"), F.lit(blocks)))
    q = materialise(q, "questions")
    parts = max(1, math.ceil(q.count() / QUESTIONS))
    q = q.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    r = r.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    kinds = queries.schema["query_id"].dataType.simpleString(), records.schema["record_id"].dataType.simpleString()

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids = held["record_id"].to_pylist()
        # ties go to the smaller id, a null one first
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])) if ids else []
        ids = [ids[i] for i in order]
        words = held["w"].to_pylist()
        at: dict[tuple[str, str], set[int]] = {}
        for place, i in enumerate(order):
            for w in words[i]:
                at.setdefault(("begins", w[:3]), set()).add(place)
                at.setdefault(("four", w[:4]) if len(w) > 3 else ("three", w), set()).add(place)
        known: dict[str, np.ndarray] = {}
        out: list[list] = [[], [], []]
        for query, mine in zip(asked["query_id"].to_pylist(), asked["w"].to_pylist(), strict=True):
            overlap = np.zeros(len(ids), np.int64)
            for w in mine:
                key = w[:4]
                if key not in known:
                    met = at.get(("begins", key), set()) if len(key) == 3 else at.get(("four", key), set()) | at.get(("three", key[:3]), set())
                    known[key] = np.fromiter(met, np.int64, len(met))
                overlap[known[key]] += 1
            hit = np.flatnonzero(overlap)
            for i in hit[np.argsort(-overlap[hit], kind="stable")[:k]].tolist():
                for column, v in zip(out, (query, ids[i], int(overlap[i])), strict=True):
                    column.append(v)
        fields = asked.schema.field("query_id").type, held.schema.field("record_id").type, pa.int64()
        return pa.table([pa.array(v, t) for v, t in zip(out, fields, strict=True)], names=["query_id", "record_id", "overlap"])

    found = q.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInArrow(compare, f"query_id {kinds[0]}, record_id {kinds[1]}, overlap long")
    return top_k(found, ["query_id"], [F.desc("overlap"), F.asc("record_id")], k).select("query_id", "rank", "record_id", "overlap")


def context_block(found: DataFrame, records: DataFrame, per_fact: int = 60, total: int = 220) -> DataFrame:
    """(query_id, context): the texts found, each and all together cut to their limits."""
    facts = found.join(records, "record_id").select("query_id", "rank", T.trim_to(F.col("text"), per_fact).alias("fact")).where("fact <> ''")
    joined = facts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "fact"))).alias("f"))
    return joined.select("query_id", T.trim_to(F.array_join(F.transform("f", lambda x: x["fact"]), "; "), total).alias("context"))


def copy_ratio(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, sentences, copied, ratio): the share of a text's sentences that are lines of another table."""
    s = texts.select("id", F.explode(T.sentences(F.col("text"))).alias("s")).select("id", F.sha2("s", 256).alias("h"))
    known = lines.select(F.sha2(T.strip(F.col("line")), 256).alias("k")).distinct()
    hit = s.join(known, s.h == known.k, "left")
    out = hit.groupBy("id").agg(F.count(F.lit(1)).alias("sentences"), F.count("k").alias("copied"))
    return out.select("id", "sentences", "copied", (F.col("copied") / F.col("sentences")).alias("ratio"))


def deactivate(records: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """Soft deletion: listed records become inactive, with the time of the change."""
    hit = records.join(ids.select(key).distinct(), key, "left_semi").withColumns({"active": F.lit(False), "updated_at": now})
    return hit.unionByName(records.join(ids.select(key).distinct(), key, "left_anti"))


def remove(records: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Hard deletion: listed records go; records without key can't be listed."""
    return records.join(ids.select(key).distinct(), key, "left_anti")
