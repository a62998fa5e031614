"""Toxicity: a counterfactual-regularised classifier.

A logistic model over words and word beginnings. Words are folded to lower
case; a text's inputs are its words and the beginnings (four and six letters)
of its different words, each beginning at levels of one, two, four and eight
words, all hashed by crc32. Of those in the labelled rows the ones that tell
the labels apart best (chi-squared) become inputs, and so do all identity
terms. Training
adds to the logistic loss the mean squared change of the log-odds when the
identity terms of a labelled sentence are swapped for others of their family;
the change is that of all inputs, beginnings and their levels among them.
A group's mention then can't carry a verdict by itself: only what is said does.

The model is fitted on the driver to at most ``max_rows`` labelled rows, a
documented bound; every text is scored, whole. The model's size is fixed by
``max_inputs``.

Defined results: null and empty texts get the score of no words; without
labels, or with labels of one kind only, the score is the smoothed share of
label 1; repeated rows get equal scores, and rows with equal texts count once in training;
an empty table gives an empty table. Labels, language, source and id are never
inputs, and extra columns never clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.labelled import training_sample
from textloom.session import materialise

MAX_ROWS = 8_000
MAX_INPUTS = 768
MIN_ROWS = 4
#: Chi-squared that an input must exceed (one degree of freedom, 5 %).
LEAST_CHI = 3.84
BEGINNINGS = (4, 6)
LEVELS = (1, 2, 4, 8)
THRESHOLD = 0.3
HELD_OUT = 2
SWAP_WEIGHT = 4.0

# Families of identity terms; the terms of a family are swapped for each other.
IDENTITY_FAMILIES = (
    "christian christians muslim muslims jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic catholics",
    "woman women man men girl girls boy boys female male transgender",
    "gay lesbian straight bisexual queer homosexual heterosexual",
    "black white asian latino hispanic african european arab arabs",
    "american americans mexican mexicans chinese indian indians german germans french russian russians immigrant immigrants refugee refugees",
    "old young elderly disabled blind deaf",
    "chrétien chrétiens musulman musulmans juif juifs bouddhiste athée",
    "femme femmes homme hommes fille garçon",
    "christ christen moslem moslems jude juden buddhist atheist",
    "frau frauen mann männer mädchen junge",
    "cristiano cristianos musulmán musulmanes judío judíos budista ateo",
    "mujer mujeres hombre hombres chica chico",
)

_WORD = re.compile(r"[^\W\d_]+")


def _hash(word: str) -> int:
    """Input of a word's presence: the lowest level of its hash."""
    return zlib.crc32(word.encode()) * len(LEVELS)


def units(word: str) -> list[int]:
    """A word's hash and those of its beginnings, at the lowest level."""
    return [_hash(word), *(_hash(word[:k] + "*") for k in BEGINNINGS if len(word) >= k)]


def families(terms: tuple[str, ...] = IDENTITY_FAMILIES) -> list[list[int]]:
    return [[_hash(w) for w in line.split()] for line in terms]


def inputs_of(text: str | None) -> list[int]:
    """Inputs of a whole text: each unit at every level that its number of different words reaches."""
    return _inputs(set(_WORD.findall((text or "").lower())))


def _inputs(words: set[str]) -> list[int]:
    counts: dict[int, int] = {}
    for w in words:
        for u in units(w):
            counts[u] = counts.get(u, 0) + 1
    return sorted(u + k for u, n in counts.items() for k, least in enumerate(LEVELS) if n >= least)


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    words: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        levels = len(LEVELS)
        self.known = {i // levels * levels for i in self.weights}

    def log_odds(self, text: str | None) -> float:
        words, counts = self.words, {}
        for w in set(_WORD.findall((text or "").lower())):
            weighed = words.get(w)
            if weighed is None:
                if len(words) >= 200_000:
                    words.clear()
                weighed = words[w] = tuple(u for u in units(w) if u in self.known)
            for u in weighed:
                counts[u] = counts.get(u, 0) + 1
        weight = self.weights.get
        return self.bias + sum(weight(u + k, 0.0) for u, n in sorted(counts.items()) for k, least in enumerate(LEVELS) if n >= least)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(text), -30, 30))))

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights, "words": {}, "known": self.known}


def swaps(present: set[int], groups: list[list[int]]) -> list[list[tuple[int, int]]]:
    """Counterfactuals of a sentence: every identity term goes to the next, the one after, and so on, of its family."""
    hit = [(f, t) for f in groups for t in f if t in present]
    longest = max((len(f) for f, _ in hit), default=1)
    return [[(t, f[(f.index(t) + k) % len(f)]) for f, t in hit] for k in range(1, longest)]


def changes(text: str | None, terms: tuple[str, ...] = IDENTITY_FAMILIES) -> list[list[int]]:
    """What the inputs of a text lose and win in each of its counterfactuals.

    In a counterfactual all identity terms are others of their family, as far
    along as each other. A term of two families is swapped within either. An
    input i is coded as 2 i where it is lost, 2 i + 1 where it is won.
    """
    words = set(_WORD.findall((text or "").lower()))
    hit = [(f, t) for f in map(str.split, terms) for t in f if t in words]
    if not hit:
        return []
    before = set(_inputs(words))
    swapped = []
    for k in range(1, max(len(f) for f, _ in hit)):
        moves = [(t, f[(f.index(t) + k) % len(f)]) for f, t in hit]
        for to in (dict(moves), dict(reversed(moves))):
            other = {to.get(w, w) for w in words}
            if other != words and other not in swapped:
                swapped.append(other)
    return [sorted([2 * i for i in before.difference(after)] + [2 * i + 1 for i in after.difference(before)]) for after in map(set, map(_inputs, swapped))]


def chi_squared(n, n1, rows, ones):  # noqa: ANN001, ANN201  numbers, arrays or columns
    """How far an input's share of label 1 is from that of all rows."""
    mean = ones / rows
    return (n1 - n * mean) ** 2 / (n * mean * (1 - mean) * (1.0 - n / rows + 1e-9))


def fit(rows: list[tuple], groups: list[list[int]], best: list[int] | None = None, max_inputs: int = MAX_INPUTS, swap_weight: float = SWAP_WEIGHT, decay: float = 5e-4, rounds: int = 250, step: float = 0.05) -> Model:
    """Fit by full-batch Adam on logistic loss, weight decay and swap penalty.

    A row has inputs, label and the ``changes`` of its text; rows without the
    last are swapped by their whole words alone. ``best`` are the chosen inputs;
    without them they are chosen from the rows.
    """
    if best is None:
        rows = sorted({(tuple(i), y, *(tuple(map(tuple, c)) for c in rest)) for i, y, *rest in rows})
    y = np.array([r[1] for r in rows], np.float32)
    share = (y.sum() + 1) / (len(rows) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(rows) < 2 or y.min() == y.max():
        return Model(bias)
    flat, owner = np.fromiter((h for r in rows for h in r[0]), np.int64), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    if best is None:
        known, place = np.unique(flat, return_inverse=True)
        n = np.bincount(place, minlength=len(known))
        chi = chi_squared(n, np.bincount(place, y[owner], len(known)), len(rows), y.sum())
        chi[n < MIN_ROWS] = -1
        best = known[np.lexsort((known, -chi))[: min(max_inputs, int((chi > LEAST_CHI).sum()))]]
    inputs = np.unique(np.concatenate([np.asarray(best, np.int64), [t for g in groups for t in g]]).astype(np.int64))
    column = np.searchsorted(inputs, flat)
    used = (column < len(inputs)) & (inputs[np.minimum(column, len(inputs) - 1)] == flat)
    x = np.zeros((len(rows), len(inputs)), np.float32)
    x[owner[used], column[used]] = 1
    # one row for each labelled sentence and swap: what the swap takes out and brings in
    at = {int(h): k for k, h in enumerate(inputs)}
    wanted = {t for g in groups for t in g}
    moves: list[list[int]] = []
    for i, _, *rest in rows:
        if rest:
            moves += rest[0]
        elif hit := wanted & set(i):
            moves += [[2 * h + k for pair in m for k, h in enumerate(pair)] for m in swaps(hit, groups)]
    gram = np.zeros((len(inputs), len(inputs)), np.float32)
    for first in range(0, len(moves), 4096):
        part = moves[first : first + 4096]
        change = np.zeros((len(part), len(inputs)), np.float32)
        for k, m in enumerate(part):
            for v in m:
                if v >> 1 in at:
                    change[k, at[v >> 1]] += 1 if v & 1 else -1
        gram += change.T @ change
    gram /= max(1, len(moves))
    p = [np.float32(bias), np.zeros(len(inputs), np.float32)]
    m1, m2 = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        e = (1 / (1 + np.exp(-np.clip(p[0] + x @ p[1], -30, 30))) - y) / len(rows)
        g = [e.sum(), x.T @ e + decay * p[1] + 2 * swap_weight * (gram @ p[1])]
        for k in range(2):
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] * g[k]
            p[k] = p[k] - step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return Model(float(p[0]), {int(h): float(w) for h, w in zip(inputs, p[1], strict=True) if w})


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = HELD_OUT, max_rows: int = MAX_ROWS, max_inputs: int = MAX_INPUTS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted to ``labels.toxic``.

    Inputs are counted and chosen in Spark; of at most ``max_rows`` rows only
    the chosen inputs reach the driver.
    """

    inputs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(list(map(inputs_of, texts)), inputs), batch.column(1), pa.array(list(map(changes, texts)), pa.list_(inputs))], names=["i", "y", "c"])

    sample = training_sample(docs, labels, "toxic", max_rows, held_out, id_col, text_col).dropDuplicates(["t", "y"])
    rows = materialise(sample.select("t", "y").mapInArrow(run, "i array<bigint>, y int, c array<array<bigint>>"), "inputs")
    total, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    best: list[int] = []
    if 0 < ones < total:
        counts = rows.select(F.explode("i").alias("u"), "y").groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).where(F.col("n") >= MIN_ROWS)
        chi = F.round(chi_squared(F.col("n"), F.col("n1"), F.lit(float(total)), F.lit(float(ones))), 9)
        best = [r["u"] for r in counts.select("u", chi.alias("chi")).where(F.col("chi") > LEAST_CHI).orderBy(F.desc("chi"), "u").limit(max_inputs).collect()]
    groups = families()
    chosen = {*best, *(t for g in groups for t in g)}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = [sorted(chosen.intersection(x)) for x in batch.column(0).to_pylist()]
            c = [[[v for v in m if v >> 1 in chosen] for m in x] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(i, inputs), batch.column(1), pa.array(c, pa.list_(inputs))], names=["i", "y", "c"])

    got = rows.mapInArrow(known, rows.schema).toArrow()
    return fit(sorted((r["i"], r["y"], r["c"]) for r in got.to_pylist()), groups, best)


def score_column(model: Model, text: Column) -> Column:
    """Probability that a text has label 1; the model, of fixed size, goes along with the function."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their own columns."""
    model = train(docs, labels, text_col=text_col)
    return docs.where(score_column(model, F.col(text_col)) < threshold)
