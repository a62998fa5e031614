"""Approximate nearest neighbours by additive quantisation.

A vector is written as the sum of one full-dimensional codeword from each of
several residual codebooks, chosen by beam search; the norm of the sum is
stored with the codes. A query is compared with all codes by lookup tables: its
products with every codeword are computed once, a code's product is the sum of
its table entries, and the stored norm turns it into a cosine. Of the rows that
a task reads, those that come among its best ``shortlist`` so far are reranked by
the exact cosine of the original vectors, in double precision; later rows rarely
do, so reranking hardly grows with the table. The best of all tasks are merged.

Codebooks are fitted on the driver to at most ``sample_rows`` vectors, a
documented bound; every row is encoded and searched. Queries are numbered and go
in blocks of ``QUERY_BLOCK``, however sparse their ids are; a job has
``BLOCKS_AT_ONCE`` blocks, which is what is broadcast at a time, and every job's
result is written to the shared folder.

Defined results: vectors that are null, zero, of another dimension than most,
or hold null or non-finite components take no part; rows without id take none
either; rows that repeat an id count once as a query (with the least of its vectors) and
once as a neighbour (with the nearest of them);
ties go to the smaller id; with fewer candidates than asked for all are
returned; an empty table gives an empty table. Only the named columns are read,
so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.windows import numbered
from textloom.session import materialise, scratch_path

BOOKS = 16
WORDS = 256
BEAM = 3
SAMPLE_ROWS = 8192
SHORTLIST = 128
QUERY_BLOCK = 2048
BLOCKS_AT_ONCE = 4
ROWS_AT_ONCE = 8192
QUERIES_AT_ONCE = 256


@dataclass
class Codebooks:
    """books[m, k] is codeword k of book m, for vectors of unit length."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and norms of the sums, of rows of unit length, by beam search over the books."""
        n, books = len(x), self.books
        residual = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for book in books:
            # |r - c|^2 = |r|^2 - 2 rc + |c|^2 of every kept residual and codeword
            error = (residual**2).sum(2)[:, :, None] - 2 * residual @ book.T + (book**2).sum(1)
            width = error.shape[1]
            flat = error.reshape(n, width * len(book))
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // len(book), best % len(book)
            residual = residual[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        last = (residual**2).sum(2).argmin(1)
        final = residual[np.arange(n), last]
        return codes[np.arange(n), last], np.linalg.norm(x - final, axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of every query with every codeword: (queries, books, words)."""
        return np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.books, optimize=True)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 5, seed: int = 5) -> Codebooks:
    """Residual k-means: each book is fitted to what the books before it leave."""
    rng = np.random.default_rng(seed)
    residual, out = x.astype(np.float32).copy(), []
    for _ in range(books):
        book = residual[rng.choice(len(residual), words, replace=len(residual) < words)].copy()
        for _ in range(rounds):
            near = ((book**2).sum(1) - 2 * residual @ book.T).argmin(1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(book)
            np.add.at(total, near, residual)
            book = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], book)
        near = ((book**2).sum(1) - 2 * residual @ book.T).argmin(1)
        residual -= book[near]
        out.append(book)
    return Codebooks(np.stack(out).astype(np.float32))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part, x as array of double of any length."""
    x = F.col(vector_col).cast("array<double>")
    out = df.select(F.col(id_col).alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out.where(F.forall("x", finite) & F.exists("x", lambda v: v != 0))


def _top(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores, ties to smaller ids; ``ids`` ascend."""
    if len(score) <= n:
        return np.arange(len(score))
    least = np.partition(score, len(score) - n)[len(score) - n]
    place = np.flatnonzero(score >= least)
    if len(place) > n:
        place = place[np.lexsort((ids[place], -score[place]))[:n]]
    return place


def _search_block(index: DataFrame, books: Codebooks, ids: np.ndarray, queries: np.ndarray, k: int, shortlist: int) -> DataFrame:
    """The k nearest of each task, for one block of queries."""
    given = index.sparkSession.sparkContext.broadcast((books.books, ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, qid, q = given.value
        tables = Codebooks(words).tables(_unit(q))
        q_norm = np.sqrt((q * q).sum(1))
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in qid]
        listed = np.full((len(qid), shortlist), -np.inf, np.float32)  # the best products so far
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                order = np.argsort(part.column(0).to_numpy(), kind="stable")
                part_ids = part.column(0).to_numpy()[order]
                x = _matrix(part.column(1))[order]
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(x), -1)[order]
                norms = part.column(3).to_numpy()[order]
                x_norm = np.sqrt((x * x).sum(1))
                for first in range(0, len(qid), QUERIES_AT_ONCE):
                    some = tables[first : first + QUERIES_AT_ONCE]
                    score = np.zeros((len(some), len(x)), np.float32)
                    for m in range(codes.shape[1]):
                        score += np.take(some[:, m], codes[:, m], axis=1)
                    score /= norms
                    better = score > listed[first : first + len(some)].min(1)[:, None]
                    for j in np.flatnonzero(better.any(1)).tolist():
                        place = np.flatnonzero(better[j])
                        place = place[_top(score[j, place], part_ids[place], shortlist)]
                        both = np.concatenate([listed[first + j], score[j, place]])
                        listed[first + j] = np.partition(both, len(both) - shortlist)[len(both) - shortlist :]
                        place = place[part_ids[place] != qid[first + j]]
                        exact = (x[place] * q[first + j]).sum(1) / (x_norm[place] * q_norm[first + j])
                        near = np.concatenate([best[first + j][0], part_ids[place]]), np.concatenate([best[first + j][1], exact])
                        keep, seen = [], set()
                        for i in np.lexsort((near[0], -near[1])):
                            if near[0][i] not in seen:
                                seen.add(near[0][i])
                                keep.append(i)
                                if len(keep) == k:
                                    break
                        best[first + j] = near[0][keep], near[1][keep]
        lengths = [len(b[0]) for b in best]
        if sum(lengths):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qid, lengths)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))],
                names=["query_id", "vec_id", "score"],
            )

    return index.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Codebooks] | None:
    """The table (id, x, codes, norm) of every row that takes part, and the codebooks; None without such rows."""
    rows = valid_vectors(df, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return None
    vectors = sample["x"].to_pylist()
    sizes = np.bincount([len(v) for v in vectors])
    size = int(sizes.argmax())
    books = fit(_unit(np.array([v for v in vectors if len(v) == size])))
    given = df.sparkSession.sparkContext.broadcast(books.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codebooks(given.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                codes, norms = coder.encode(_unit(_matrix(part.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.maximum(norms, 1e-6).astype(np.float32))],
                    names=["id", "x", "codes", "norm"],
                )

    coded = rows.where(F.size("x") == size).select(F.col("id").cast("long").alias("id"), "x")
    return materialise(coded.mapInArrow(run, "id bigint, x array<double>, codes binary, norm float"), "vectors"), books


def search(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, shortlist: int = SHORTLIST) -> DataFrame:
    """The k nearest rows, by cosine, of every row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score.
    """
    spark = df.sparkSession
    schema = "query_id bigint, vec_id bigint, score double"
    built = build_index(df, id_col, vector_col, sample_rows)
    if built is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index, books = built
    queries = numbered(index.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x")), ["id"], "at")
    path = scratch_path(spark, "neighbours")
    spark.createDataFrame([], schema).write.parquet(path)
    blocks = -(-queries.count() // QUERY_BLOCK)
    for first in range(0, blocks, BLOCKS_AT_ONCE):
        job = None
        for block in range(first, min(first + BLOCKS_AT_ONCE, blocks)):
            rows = queries.where((F.col("at") > block * QUERY_BLOCK) & (F.col("at") <= (block + 1) * QUERY_BLOCK)).toArrow()
            found = _search_block(index, books, rows["id"].to_numpy(), np.array(rows["x"].to_pylist()), k, shortlist)
            job = found if job is None else job.union(found)
        job.write.mode("append").parquet(path)
    near = spark.read.schema(schema).parquet(path).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
