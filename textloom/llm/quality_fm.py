"""Quality classifier: a factorisation machine over hashed words and structure.

Inputs are words hashed into buckets (logarithmic counts at unit length),
structure statistics of the text, and its metadata (length in characters and
words on a logarithmic scale). The score is the logistic of

    b + sum(w_i x_i) + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)

whose second part weighs all pairs of inputs with low-rank factors in a time
that is linear in the inputs, by the sum-of-squares identity.

The machine is fitted on the driver to at most ``max_rows`` labelled rows, a
documented bound; every text is scored, whole. The model's size is fixed by
``buckets`` and ``rank``.

Defined results: null and empty texts have no words and get the score of their
(zero) statistics; without labels, or with labels of one kind only, the score
is the smoothed share of label 1; repeated rows get equal scores; an empty table gives
an empty table. Labels, language, source and id are never inputs, and extra
columns never clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.labelled import training_sample

BUCKETS = 1024
RANK = 8
MAX_ROWS = 6000
THRESHOLD = 0.7
HELD_OUT = 2

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STATISTICS = 14
#: Standardised statistics beyond this many deviations count as this many, in training and in scoring.
CLIP = 8.0


def statistics(text: str, raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure statistics and metadata of one text."""
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = max(1, len(raw)), max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        min(3.0, histogram[_SYMBOL].sum() / n),
        histogram[_UPPER].sum() / size,
        histogram[_DIGIT].sum() / size,
        min(3.0, histogram[33] / n),
        min(3.0, histogram[124] / n),
        histogram[128:].sum() / size,
        min(3.0, (histogram[46] + histogram[44]) / n),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        min(30.0, size / n) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(len(words)) / 5,
        np.log1p(len(text)) / 5,
    ]


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the inputs of one text; statistics follow the buckets."""
    text = text or ""
    raw = text.encode()
    words = raw.lower().split()
    counts = Counter(words)
    crc = zlib.crc32
    n = len(counts)
    index = np.fromiter(map(crc, counts), np.int64, n) % buckets
    value = np.log1p(np.fromiter(counts.values(), np.float64, n))
    norm = np.sqrt((value * value).sum()) or 1.0
    return np.concatenate([index, np.arange(buckets, buckets + STATISTICS)]), np.concatenate([value / norm, statistics(text, raw, words, counts)])


@dataclass
class Machine:
    buckets: int
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, text: str | None) -> float:
        i, x = features(text, self.buckets)
        x[-STATISTICS:] = np.clip((x[-STATISTICS:] - self.mean) / self.scale, -CLIP, CLIP)
        # the inputs of one bucket are summed first: x is one value for each input
        x = np.bincount(i, x, self.buckets + STATISTICS)
        i = np.flatnonzero(x)
        x = x[i]
        v = self.v[i]
        z = self.bias + self.w[i] @ x + 0.5 * (((x @ v) ** 2).sum() - ((x * x) @ (v * v)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, rank: int = RANK, rounds: int = 160, step: float = 0.03, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Fit by full-batch Adam on the logistic loss."""
    size = buckets + STATISTICS
    share = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
    bias = float(np.log(share / (1 - share)))
    machine = Machine(buckets, bias, np.zeros(size), np.zeros((size, rank)), np.zeros(STATISTICS), np.ones(STATISTICS))
    y = np.array([r[2] for r in rows], np.float32)
    if len(rows) < 2 or y.min() == y.max():
        return machine
    x = np.zeros((len(rows), size), np.float32)
    for k, (i, value, _) in enumerate(rows):
        x[k] = np.bincount(i, value, size)
    machine.mean, machine.scale = x[:, buckets:].mean(0).astype(float), x[:, buckets:].std(0).astype(float) + 1e-3
    x[:, buckets:] = np.clip((x[:, buckets:] - machine.mean) / machine.scale, -CLIP, CLIP)
    x2, n = x * x, len(rows)
    rng = np.random.default_rng(seed)
    p = [np.float32(bias), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        q = x @ p[2]
        z = p[0] + x @ p[1] + 0.5 * ((q * q).sum(1) - (x2 @ (p[2] * p[2])).sum(1))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = [e.sum(), x.T @ e + decay * p[1], x.T @ (e[:, None] * q) - (x2.T @ e)[:, None] * p[2] + decay * p[2]]
        for k in range(3):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] * g[k]
            p[k] = p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    machine.bias, machine.w, machine.v = float(p[0]), p[1].astype(float), p[2].astype(float)
    return machine


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = HELD_OUT, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine fitted to ``labels.quality``; at most ``max_rows`` rows of inputs reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [features(t.as_py(), buckets) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.asarray(i, np.int32) for i, _ in out], pa.list_(pa.int32())), pa.array([np.asarray(x, np.float32) for _, x in out], pa.list_(pa.float32())), batch.column(1)],
                names=["i", "x", "y"],
            )

    sample = training_sample(docs, labels, "quality", max_rows, held_out, id_col, text_col)
    rows = sample.mapInArrow(run, "i array<int>, x array<float>, y int").toArrow()
    found = [(np.array(i.values), np.array(x.values), y.as_py()) for i, x, y in zip(rows["i"], rows["x"], rows["y"], strict=True)]
    return fit(sorted(found, key=lambda r: (len(r[0]), r[1].tobytes(), r[0].tobytes())), buckets)


def score_column(machine: Machine, text: Column) -> Column:
    """Probability that a text has label 1; the machine, of fixed size, goes along with the function."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([machine.score(t) for t in texts], dtype="float64")

    return score(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` at least, with their own columns."""
    machine = train(docs, labels, text_col=text_col)
    return docs.where(score_column(machine, F.col(text_col)) >= threshold)
