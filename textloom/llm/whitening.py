"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance of the vectors is never formed. A pass over Spark computes
X'(X Q) on centred rows for a block Q of directions: every task multiplies its
rows by the block and by their transposed products, Spark adds up the entries,
and the driver receives one matrix of dimension times block. There the block is
orthonormalised (QR) and turned to Ritz vectors (Rayleigh-Ritz); passes go on
until the residual |V u - e u| of every wanted component is below
``TOLERANCE`` times the largest eigenvalue. Where the spectrum is so flat that
the residuals would take long, the block grows by the residuals themselves, up
to the whole space, where Rayleigh-Ritz is exact.

Components c become whole numbers, floor(256 c). The fit list has each distinct
vector once; equal vectors are folded map-side, so a vector that a third of all
rows share costs no more than others.

Defined results: null vectors, and vectors with null or non-finite entries, take
no part; vectors shorter than the longest count as having zeros there; rows
without id and rows that repeat one are returned like all others; components
without variance (fewer distinct vectors than components, say) can't be whitened
and are left out, so a table of equal vectors gives no rows; of equal
eigenvalues any orthonormal directions are the components; a deviation beyond a
long is null; an empty table gives an empty table. Only the named columns are
read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.int_vectors import matrix, padded, whole_vectors
from textloom.session import materialise

#: Directions beyond the wanted ones in the first block.
SPARE = 12
#: Residual of a component, in parts of the largest eigenvalue, that certifies it.
TOLERANCE = 1e-13
#: The block grows if the residuals would need more passes than this.
PATIENCE = 4
MAX_PASSES = 500
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _added(df: DataFrame, d: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over tasks of ``of`` the rows' matrices, added up by Spark entry by entry."""
    size = shape[0] * shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.ravel())], names=["at", "v"])

    out = np.zeros(size)
    for r in df.select("x").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


class Centre:
    """Count, sums and means of the fit list; rows are centred as (n x - S) / n."""

    def __init__(self, n: int, sums: list[int], largest: int) -> None:
        self.n, self.sums = n, sums
        self.safe = 2 * n * max(1, largest) < 2**62  # n x - S fits a long
        self.squares_safe = len(sums) * (2 * n * max(1, largest)) ** 2 < 2**62
        self.s = np.array(sums, np.int64 if self.safe else object)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        return x * self.n - self.s if self.safe else x.astype(object) * self.n - self.s

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exactly; null beyond a long."""
        y = self.scaled(x)
        if self.squares_safe:
            return (y * y).sum(axis=1).tolist()
        return [total if (total := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in y]


def fit_list(rows: DataFrame) -> tuple[DataFrame, Centre] | None:
    """The distinct vectors of (.., x), all of one length, and their centre; None without any."""
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if not longest:
        return None
    fit = materialise(padded(rows, longest).select("x").distinct(), "vectors")
    entry = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at")
    sums = {r["at"]: r for r in entry.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max(F.abs(F.col("v").cast("decimal(20,0)"))).alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    return fit, Centre(sums[0]["n"], [int(sums[i]["s"]) for i in range(longest)], max(int(r["m"]) for r in sums.values()))


def components(fit: DataFrame, centre: Centre, k: int, spare: int = SPARE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float, list[float]]:
    """(eigenvalues, vectors as columns, trace, residuals) of the k leading components that have variance.

    Residuals are those of the components, in parts of the largest eigenvalue.
    """
    d = len(centre.sums)

    def times(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            y = centre.rows(x)
            return y.T @ (y @ q)

        return _added(fit, d, q.shape, of) / centre.n

    trace = float(_added(fit, d, (1, 1), lambda x: np.array([[(centre.rows(x) ** 2).sum()]]))[0, 0] / centre.n)
    if trace <= 0:
        return np.zeros(0), np.zeros((d, 0)), trace, []
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + spare))))[0]
    before = np.inf  # no speed is known in the first pass
    for _ in range(MAX_PASSES):
        vq = times(q)
        ritz = q.T @ vq
        e, w = np.linalg.eigh((ritz + ritz.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        u, vu = q @ w, vq @ w
        residual = vu - u * e
        wanted = min(k, len(e))
        size = np.sqrt((residual[:, :wanted] ** 2).sum(axis=0)) / max(e[0], trace * 1e-300)
        worst = float(size.max())
        if worst <= TOLERANCE or q.shape[1] == d:
            break
        block = vu
        if worst * (worst / before) ** PATIENCE > TOLERANCE:
            # as many new directions as there are, or as the space has left
            block = np.hstack([u, residual[:, : d - q.shape[1]]])
        before = worst
        q = np.linalg.qr(block)[0]
    else:
        raise RuntimeError("components did not settle")
    positive = e[:wanted] > d * 1e-15 * trace
    return e[:wanted][positive], u[:, :wanted][:, positive], trace, size[positive].tolist()


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row of each vector and component: its whitened coordinate, and the figures of the fit.

    vec_id, component (from 1), n (vectors of the fit list), deviation (sum over
    dimensions of (n x - S)^2), whitened (the projection of x - S/n over the
    root of the eigenvalue), explained (the eigenvalue's share of the trace) and
    identity_error (the largest departure of the whitened covariance from the
    identity, measured in a pass of its own).
    """
    rows = whole_vectors(df, vector_col, {"id": id_col})
    found = fit_list(rows)
    empty = df.sparkSession.createDataFrame([], SCHEMA)
    if found is None:
        return empty
    fit, centre = found
    e, u, trace, _ = components(fit, centre, k)
    if not len(e):
        return empty
    d, m = len(centre.sums), len(e)
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(m)] < 0, -1.0, 1.0)
    to = u / np.sqrt(e)

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.hstack([centre.rows(x) @ to, np.ones((len(x), 1))])
        return w.T @ w

    got = _added(fit, d, (m + 1, m + 1), moments) / centre.n
    covariance = got[:m, :m] - np.outer(got[m, :m], got[m, :m])
    error = float(np.abs(covariance - np.eye(m)).max())
    explained = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), d)
            whitened = (centre.rows(x) @ to).ravel()
            rows_of = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows_of)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows_of), centre.n)),
                    pa.array(centre.deviations(x), pa.int64()).take(pa.array(rows_of)),
                    pa.array(whitened),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows_of), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return padded(rows, d).select(F.col("id").cast("long"), "x").mapInArrow(run, SCHEMA)
