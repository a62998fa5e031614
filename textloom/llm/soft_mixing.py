"""Mixing sources to target weights with soft domain memberships.

A classifier learned from a table of labelled documents gives every document a
posterior over domains: naive Bayes over the presence of the words that tell
the domains apart best, at a temperature. Each document then gets a rate, the
expected number of times it is drawn, so that the expected tokens of each
domain, sum of rate x tokens x posterior, meet targets. Rates are fitted by
accelerated projected gradient steps on the weighted squared misses, in the
metric of tokens, and kept at ``min_rate`` (0 at least) or above, and at
``max_rate`` or below where a limit is given.

Everything is DataFrame and SQL expressions. A step needs the expected totals,
one distributed sum for each domain; a document's rate is an expression of its
own posterior and the few numbers of each step, so rates need no join and no
state besides the compact table of memberships.

Words come from at most ``MAX_ROWS`` labelled rows, a documented bound; tokens,
posteriors, totals and rates cover all documents.

Defined results: null and empty texts have no tokens and the posterior of no
known words; labelled rows without id or domain don't count, and of several
domains for one id the smallest counts; without labelled rows there are no
domains, the domain is null and every rate is ``max(min_rate, 1)``; a domain
whose target can't be met is met as closely as the bounds allow; repeated rows
have equal rates and count as often as they occur; an empty table gives an
empty table. Only the named columns are read; ``mix`` returns the columns it
was given.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import materialise

log = logging.getLogger(__name__)

SPACES = r"[\x20\x09-\x0D]+"
MAX_ROWS = 4000
MAX_WORDS = 256
TEMPERATURE = 4.0
#: Default target of a domain: its share of all tokens to this power.
SMOOTHING = 0.7


def _summed(places: str, weights: list[float], start: float) -> Column:
    """``start`` and the weights at the places (from 1) in an array column."""
    table = F.array(*map(F.lit, weights)) if weights else F.array().cast("array<double>")
    return F.aggregate(places, F.lit(start), lambda s, i: s + F.element_at(table, i))


@dataclass
class Classifier:
    """Domain posteriors as column expressions; its size is fixed by the numbers of words and domains."""

    domains: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)  # [domain][word]

    def add(self, df: DataFrame, text_col: str) -> DataFrame:
        """``df`` with ``__tokens`` and ``__p0``, ``__p1`` and so on, one for each domain."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        out = df.withColumn("__w", F.array_remove(F.split(F.lower(text), SPACES), ""))
        out = out.withColumn("__tokens", F.size("__w").cast("double"))
        if not self.domains:
            return out.drop("__w")
        known = F.array(*map(F.lit, self.words)) if self.words else F.array().cast("array<string>")
        out = out.withColumn("__at", F.transform(F.array_intersect("__w", known), lambda w: F.array_position(known, w).cast("int")))
        for k, weights in enumerate(self.weights):
            out = out.withColumn(f"__z{k}", _summed("__at", weights, self.bias[k]))
        z = [F.col(f"__z{k}") for k in range(len(self.domains))]
        top = F.greatest(*z) if len(z) > 1 else z[0]
        e = [F.exp(x - top) for x in z]
        total = sum(e[1:], e[0])
        for k, x in enumerate(e):
            out = out.withColumn(f"__p{k}", x / total)
        return out.drop("__w", "__at", *(f"__z{k}" for k in range(len(z))))


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, temperature: float = TEMPERATURE) -> Classifier:
    """A classifier from (id, domain) rows; at most ``max_rows`` ids are broadcast, in the order of their hash."""
    known = labelled.select(F.col(id_col).alias("k"), F.col(domain_col).cast("string").alias("domain")).where("k IS NOT NULL AND domain IS NOT NULL")
    known = known.groupBy("k").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    sample = texts.join(F.broadcast(known), F.col("id") == F.col("k"))
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").collect()}
    if not sizes:
        return Classifier()
    total = sum(sizes.values())
    found = sample.select("domain", F.explode(F.array_distinct(F.array_remove(F.split("t", SPACES), ""))).alias("word"))
    counts = found.groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(sizes)], F.count(F.lit(1)).alias("n"))
    gain = sum((F.col(f"n{k}") * F.log((F.col(f"n{k}") + F.lit(1e-9)) * F.lit(float(total)) / (F.col("n") * F.lit(float(n)))) for k, n in enumerate(sizes.values())), F.lit(0.0))
    best = counts.where("n >= 3").orderBy(F.desc(F.round(gain, 6)), "word").limit(max_words).collect()
    bias = [math.log((n + 1) / (total + len(sizes))) for n in sizes.values()]
    weights: list[list[float]] = [[] for _ in sizes]
    for row in best:
        for k, n in enumerate(sizes.values()):
            p = (row[f"n{k}"] + 0.5) / (n + 1.0)
            weights[k].append((math.log(p) - math.log1p(-p)) / temperature)
            bias[k] += math.log1p(-p) / temperature
    return Classifier(list(sizes), [r["word"] for r in best], bias, weights)


@dataclass
class Rates:
    """Steps of the fit; a rate is what they make of a document's posterior."""

    start: float
    low: float
    high: float
    steps: list[list[float]]
    targets: list[float]
    totals: list[float]

    @property
    def miss(self) -> float:
        """The largest distance of a total from its target, in targets (of at least one token)."""
        return max((abs(a - t) / max(1.0, t) for a, t in zip(self.totals, self.targets, strict=True)), default=0.0)

    def column(self) -> Column:
        return _walk(_standing(F.lit(self.start)), self.steps, self.low, self.high)["rate"]


def _standing(rate: Column) -> Column:
    """A rate that has not moved: (rate, the point from which the next step goes)."""
    return F.struct(rate.cast("double").alias("rate"), rate.cast("double").alias("ahead"))


def _walk(state: Column, steps: list[list[float]], low: float, high: float) -> Column:
    """The state after more steps; they are data of one expression, so that more steps need no new code.

    A step is the momentum and the gradient: the new rate is the point ahead less
    the gradient, within bounds; the new point ahead goes on from there by the
    momentum times what the rate has changed.
    """
    if not steps:
        return state
    p = F.array(*[F.col(f"__p{k}") for k in range(len(steps[0]) - 1)])
    table = F.array(*[F.array(*map(F.lit, s)) for s in steps])

    def move(old: Column, s: Column) -> Column:
        down = F.aggregate(F.zip_with(p, F.slice(s, 2, len(steps[0]) - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return F.struct(F.greatest(F.lit(low), F.least(F.lit(high), old["ahead"] - down)).alias("rate"), old["rate"].alias("old"), F.get(s, F.lit(0)).alias("momentum"))

    def on(new: Column) -> Column:
        return F.struct(new["rate"].alias("rate"), (new["rate"] + new["momentum"] * (new["rate"] - new["old"])).alias("ahead"))

    # an array of one state, transformed twice, so that the new rate is computed once
    return F.aggregate(table, state, lambda old, s: F.get(F.transform(F.transform(F.array(old), lambda x: move(x, s)), on), F.lit(0)))


def fit_rates(members: DataFrame, n_domains: int, shares: list[float] | None = None, total: float | None = None, min_rate: float = 0.0, max_rate: float = math.inf, start: float = 1.0, max_rounds: int = 120, tolerance: float = 1e-4, gain: float = 1e-3, patience: int = 12) -> Rates:
    """Fit rates of ``members`` (columns __tokens, __p0, __p1, ...) to token totals.

    ``shares`` are the targets' shares of ``total``; by default the smoothed
    shares of the tokens at hand. The default ``total`` is the smallest that
    every domain can fill by repeating documents alone, so that no document
    need be dropped. The fit ends when every total is within ``tolerance`` of its
    target, when ``patience`` rounds lower the loss by less than ``gain`` (bounds
    keep targets from being met), or after ``max_rounds``; what the totals still
    miss is ``Rates.miss``, and a warning where it is more than ``tolerance``.
    """
    ks = range(n_domains)
    start = min(max(start, min_rate), max_rate)
    if not n_domains:
        return Rates(start, min_rate, max_rate, [], [], [])
    mass = [F.sum(F.col("__tokens") * F.col(f"__p{k}")).alias(f"h{k}") for k in ks]
    own = [F.sum(F.col("__tokens") * F.col(f"__p{k}") * F.col(f"__p{k}")).alias(f"g{k}") for k in ks]
    first = members.agg(*mass, *own).first()
    have = [first[f"h{k}"] or 0.0 for k in ks]
    if shares is None:
        shares = [(h / max(sum(have), 1e-9)) ** SMOOTHING for h in have]
    shares = [s / (sum(shares) or 1.0) for s in shares]
    if total is None:
        total = max((h / s for h, s in zip(have, shares, strict=True) if s > 0 and h > 0), default=0.0)
    targets = [s * total for s in shares]
    squares = [first[f"g{k}"] or 0.0 for k in ks]
    weight = [1 / g if g > 0 else 0.0 for g in squares]
    # posteriors add up to one, so a row of the matrix of second moments sums to the domain's tokens: a bound of the largest eigenvalue
    radius = max((h / g for h, g in zip(have, squares, strict=True) if g > 0), default=0.0)
    miss = lambda totals: [a - t for a, t in zip(totals, targets, strict=True)]
    steps: list[list[float]] = []
    state, standing, since = members, _standing(F.lit(start)), 0
    losses: list[float] = []
    inertia = 1.0
    totals = have
    for _ in range(max_rounds + 1):
        now = state.withColumn("__now", _walk(standing, steps[since:], min_rate, max_rate))
        part = lambda name, k: F.sum(F.col(f"__now.{name}") * F.col("__tokens") * F.col(f"__p{k}"))
        summed = now.agg(*[part("rate", k).alias(f"r{k}") for k in ks], *[part("ahead", k).alias(f"a{k}") for k in ks]).first()
        totals = [summed[f"r{k}"] or 0.0 for k in ks]
        losses.append(sum(w * m * m for w, m in zip(weight, miss(totals), strict=True)))
        met = all(abs(m) <= tolerance * max(1.0, t) for m, t in zip(miss(totals), targets, strict=True))
        stalled = len(losses) > patience and min(losses[-patience:]) > min(losses[:-patience]) * (1 - gain)
        if not radius or met or stalled or len(steps) == max_rounds:
            break
        if len(losses) > 1 and losses[-1] > losses[-2]:
            inertia = 1.0  # the momentum led astray
        faster = (1 + math.sqrt(1 + 4 * inertia * inertia)) / 2
        ahead = miss([summed[f"a{k}"] or 0.0 for k in ks])
        steps.append([(inertia - 1) / faster, *[w * m / radius for w, m in zip(weight, ahead, strict=True)]])
        inertia = faster
        if len(steps) - since == 8:  # what the steps so far have come to is written, so that later rounds don't repeat them
            state = materialise(state.withColumn("__rate", _walk(standing, steps[since:], min_rate, max_rate)), "rates")
            standing, since = F.col("__rate"), len(steps)
    rates = Rates(start, min_rate, max_rate, steps, targets, totals)
    if rates.miss > tolerance:
        log.warning("totals miss their targets by up to %.2g of them after %d steps", rates.miss, len(steps))
    return rates


def rate_documents(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", shares: dict[str, float] | None = None, **bounds: float) -> DataFrame:
    """id, n_tokens, domain (the likeliest), posterior (its own) and rate of every document."""
    classifier, members, rates = _fitted(docs, labelled, id_col, text_col, domain_col, shares, **bounds)
    p = [F.col(f"__p{k}") for k in range(len(classifier.domains))]
    top = F.greatest(*p) if len(p) > 1 else p[0] if p else F.lit(None).cast("double")
    domain = F.coalesce(*[F.when(x == top, F.lit(d)) for x, d in zip(p, classifier.domains, strict=True)]) if p else F.lit(None).cast("string")
    return members.select(F.col("__id").alias(id_col), F.col("__tokens").cast("long").alias("n_tokens"), domain.alias("domain"), top.alias("posterior"), rates.column().alias("rate"))


def _fitted(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domain_col: str, shares: dict[str, float] | None, whole: bool = False, **bounds: float) -> tuple[Classifier, DataFrame, Rates]:
    """Classifier, written memberships (with whole rows in ``__row`` if asked for) and rates."""
    classifier = train(docs, labelled, id_col, text_col, domain_col)
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    members = classifier.add(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), *[rows] * whole), "__t").drop("__t")
    members = materialise(members, "members", compression="zstd")
    wanted = [shares.get(d, 0.0) for d in classifier.domains] if shares else None
    return classifier, members, fit_rates(members.drop("__row"), len(classifier.domains), wanted, **bounds)


def mix(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", shares: dict[str, float] | None = None, seed: int = 0, **bounds: float) -> DataFrame:
    """``docs`` with every row drawn as often as its rate says, in its own columns.

    The whole part of a rate is certain; the rest is decided by a hash of id and
    text, so the draw is the same on every run. Texts are classified once: rows
    are written beside their memberships.
    """
    _, members, rates = _fitted(docs, labelled, id_col, text_col, domain_col, shares, whole=True, **bounds)
    rate, chance = F.col("__rate"), F.pmod(F.xxhash64(F.lit(seed), F.col(f"__row.`{id_col}`"), F.col(f"__row.`{text_col}`")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)
    # rows without copies go after the explosion: a filter on the copies themselves would be put before
    # the projections, and evaluate them all again for each of its references
    each = F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int")))
    out = members.withColumn("__rate", rates.column()).withColumn("__each", each).select("__row", F.explode_outer("__each").alias("__copy"))
    return out.where("__copy IS NOT NULL").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
