"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits has eight positional bytes. Two fingerprints that
differ in at most two bits differ in at most two bytes, so they share at least
six of the eight positional bytes: the guaranteed minimum. The inverted index
is posted by positional bytes. A posting of one byte would hold 1/256 of all
fingerprints, so postings are of four positional bytes: of four groups of two
neighbouring bytes, two differing bytes leave two groups untouched, and six
choices of two groups meet every pair. The shared positional bytes of each pair
that meets are tallied, pairs reaching the minimum are retained, and their
differing bits verified.

Postings longer than ``long_posting`` would make too many pairs. Their members
are linked exactly in another way: fingerprints within two bits of each other
share a value within one bit of both, so each member is posted under itself and
its 64 one-bit neighbours; the members of such a posting, 65 at most, are all
within two bits of each other and are linked to the smallest. Rows grow with
the members, never with their pairs.

Equal fingerprints are one node from the start: copies are never paired.

Defined results: null and empty texts have fingerprint zero, linked like any
other; texts of one or two words are one shingle; texts are read whole;
repeated rows are returned as often as they occur; a null id takes no part in
the smallest id of a component; an empty table gives an empty table. Only the
named id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.components import connected_components
from textloom.session import materialise

SEED = 42
SHINGLE = 3
MAX_BITS = 2
MIN_SHARED_BYTES = 6
LONG_POSTING = 64


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text, as a signed number."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, cut at U+0020 and U+0009 to U+000D
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:], strict=False))]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, fp bigint")


def _group(fp: Column, g: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * g).bitwiseAND(0xFFFF)


def _shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the equal positional bytes of two fingerprints."""
    differing = a.bitwiseXOR(b)
    tally = F.lit(0)
    for p in range(8):
        tally += F.when(F.shiftrightunsigned(differing, 8 * p).bitwiseAND(0xFF) == 0, 1).otherwise(0)
    return tally


def links(fps: DataFrame, long_posting: int = LONG_POSTING) -> DataFrame:
    """Edges (a, b) that join all different fingerprints within two bits.

    ``fps`` has distinct values of ``fp``. Pairs of short postings are verified
    one by one; long postings give links to the smallest of each neighbourhood.
    """
    choices = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    key = lambda n, i, j: F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(_group(F.col("fp"), i), 16)).bitwiseOR(_group(F.col("fp"), j))
    postings = fps.select("fp", F.explode(F.array(*[key(n, i, j) for n, (i, j) in enumerate(choices)])).alias("key"))
    length = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(postings.join(length, "key"), "postings")  # most fingerprints meet no other
    short, long = met.where(F.col("n") <= long_posting), met.where(F.col("n") > long_posting)
    a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where(F.col("a") < F.col("b")).where(_shared_bytes(F.col("a"), F.col("b")) >= MIN_SHARED_BYTES)
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    around = long.select("fp").distinct().select("fp", F.explode(near).alias("mid"))
    around = around.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("bs")).where(F.size("bs") > 1)
    stars = around.select("a", F.explode("bs").alias("b")).where("a <> b").distinct()
    return pairs.union(stars)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_posting: int = LONG_POSTING) -> DataFrame:
    """(id column, fingerprint, component_id) of every row.

    The fingerprint is written as 16 hexadecimal digits; component_id is the
    smallest id reachable over links of at most two differing bits.
    """
    rows = materialise(fingerprints(df, id_col, text_col), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = connected_components(links(classes.select("fp"), long_posting), "a", "b")
    linked = roots.join(classes, roots.node == classes.fp).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(least, "root").select(F.col("fp").alias("k"), "component_id")
    component = classes.join(moved, classes.fp == moved.k, "left").select(F.col("fp").alias("c"), F.coalesce("component_id", "first").alias("component_id"))
    component = materialise(component, "components")  # a join of two plain tables can be split where many rows share a fingerprint
    return rows.join(component, rows.fp == F.col("c")).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each near-duplicate group: that with the smallest id.

    Rows without an id can't be told apart and all stay. Of rows that repeat
    one id a single one stays.
    """
    found = near_duplicates(df.where(F.col(id_col).isNotNull()), id_col, text_col)
    found = materialise(found.select(F.col(id_col).alias("__id"), "component_id"), "members")
    # few rows go, most stay: the ids that go are the smaller side, often small enough to be broadcast
    gone = found.where(F.col("__id") != F.col("component_id")).select("__id").distinct()
    repeated = found.where(F.col("__id") == F.col("component_id")).groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id")
    on = lambda d, ids, how: d.join(ids, d[id_col] == ids["__id"], how)
    kept = on(df, gone, "left_anti")
    if repeated.isEmpty():
        return kept
    return on(kept, repeated, "left_anti").unionByName(on(kept, repeated, "left_semi").dropDuplicates([id_col]))
