"""Rates against a plain implementation, and their targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import soft_mixing as sm


def members(spark, n=300, k=3, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3] * k, n)
    t = rng.integers(0, 500, n)
    rows = [(float(a), *map(float, b)) for a, b in zip(t, p, strict=True)]
    return t, p, spark.createDataFrame(rows, "__tokens double, " + ", ".join(f"__p{i} double" for i in range(k)))


def plain(t, p, targets, low, high, rounds=3000):
    g = (p * t[:, None]).T @ p
    w = 1 / np.diag(g)
    radius = np.linalg.eigvalsh(np.sqrt(np.outer(w, w)) * g).max()
    r = np.ones(len(t))
    for _ in range(rounds):
        r = np.clip(r - p @ (w * ((r * t) @ p - targets)) / radius, low, high)
    return r


def test_rates_equal_plain_projected_gradient(spark):
    t, p, df = members(spark)
    rates = sm.fit_rates(df, 3, [0.5, 0.3, 0.2], 60_000.0, max_rounds=400, tolerance=1e-9, gain=1e-9)
    got = np.array([r[0] for r in df.select(rates.column()).collect()])
    want = plain(t, p, np.array([0.5, 0.3, 0.2]) * 60_000.0, 0.0, 8.0)
    assert np.allclose((got * t) @ p, (want * t) @ p, rtol=1e-4)
    assert np.allclose((got * t) @ p, np.array([0.5, 0.3, 0.2]) * 60_000.0, rtol=1e-3)
    assert got.min() >= 0 and got.max() <= 8
    assert rates.miss < 1e-3


def test_infeasible_targets_stay_in_bounds(spark, caplog):
    t, p, df = members(spark)
    rates = sm.fit_rates(df, 3, [1.0, 0.0, 0.0], 1e9, max_rate=2.0)
    got = np.array([r[0] for r in df.select(rates.column()).collect()])
    assert got.min() >= 0 and got.max() <= 2
    want = np.array([1e9, 0.0, 0.0])
    assert abs(rates.miss / (np.abs((got * t) @ p - want) / np.maximum(1.0, want)).max() - 1) < 1e-6
    assert rates.miss > 0.5
    assert "miss their targets" in caplog.text


DOCS = [(k, ("the ship of light " if k % 3 else "der Fluss und das Haus ") * (1 + k % 5), "en" if k % 3 else "de", "s", 1) for k in range(60)]
SCHEMA = "doc_id long, text string, lang string, source string, rate long"


def labelled(docs):
    return docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))


def test_domains_and_mix(spark):
    docs = spark.createDataFrame([*DOCS, (100, None, "en", "s", 1), (101, "", None, "s", 1), (None, "the ship", "en", "s", 1)], SCHEMA)
    out = sm.rate_documents(docs, labelled(docs), shares={"de": 0.5, "en": 0.5}, min_rate=1.0).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert all(by[k]["domain"] == lang for k, _, lang, _, _ in DOCS)
    total = {d: sum(r["n_tokens"] * r["rate"] for r in out if r["domain"] == d) for d in ("de", "en")}
    assert total["de"] == pytest.approx(total["en"], rel=0.02)
    assert min(r["rate"] for r in out) >= 1
    mixed = sm.mix(docs, labelled(docs), shares={"de": 0.5, "en": 0.5}, min_rate=1.0)
    assert mixed.columns == docs.columns
    seen = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(seen[k] - by[k]["rate"]) < 1 for k in by)
    assert sorted(map(tuple, mixed.collect()), key=repr) == sorted(map(tuple, sm.mix(docs.repartition(5), labelled(docs), shares={"de": 0.5, "en": 0.5}, min_rate=1.0).collect()), key=repr)


def test_native(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    plan = sm.mix(docs, labelled(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {(r["domain"], r["rate"]) for r in sm.rate_documents(docs, none).collect()} == {(None, 1.0)}
    assert sm.mix(docs, none).count() == docs.count()
    assert sm.rate_documents(docs.limit(0), labelled(docs)).collect() == []


def test_default_rule_reaches_the_plain_fit(spark):
    t, p, df = members(spark, 400, 4, 3)
    have = t @ p
    shares = (have / have.sum()) ** 0.7
    targets = shares / shares.sum() * (have / (shares / shares.sum())).max()
    for low in (0.0, 1.0):
        rates = sm.fit_rates(df, 4, min_rate=low)
        got = np.array([r[0] for r in df.select(rates.column()).collect()])
        want = plain(t, p, targets, low, np.inf)
        assert got.min() >= low
        assert np.allclose((got * t) @ p, (want * t) @ p, rtol=2e-3)
    # without a lower bound every target can be met
    got = np.array([r[0] for r in df.select(sm.fit_rates(df, 4).column()).collect()])
    assert np.allclose((got * t) @ p, targets, rtol=1.1e-4)


def test_rates_have_no_limit_of_their_own(spark):
    df = spark.createDataFrame([(10.0, 0.999, 0.001)] * 5 + [(10.0, 0.001, 0.999)] * 500, "__tokens double, __p0 double, __p1 double")
    rates = sm.fit_rates(df, 2, [0.5, 0.5], 10_000.0)
    assert rates.totals == pytest.approx([5000.0, 5000.0], rel=1e-3)
    assert max(r[0] for r in df.select(rates.column()).collect()) > 50


def test_many_domains(spark):
    docs = spark.createDataFrame([(k, f"word{k % 70} word{k % 70} common", f"d{k % 70:02d}") for k in range(420)], "doc_id long, text string, lang string")
    out = sm.rate_documents(docs, docs.select("doc_id", F.col("lang").alias("domain"))).collect()
    assert {(r["doc_id"], r["domain"]) for r in out} == {(k, f"d{k % 70:02d}") for k in range(420)}


def test_posteriors_equal_plain_naive_bayes(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choice(words[10 * (k % 2) : 10 * (k % 2) + 20], 12)), "ab"[k % 2]) for k in range(80)]
    docs = spark.createDataFrame([*rows, (900, "unheard of", None), (901, None, None)], "doc_id long, text string, domain string")
    c = sm.train(docs, docs.select("doc_id", "domain"))
    sizes = {d: sum(r[2] == d for r in rows) for d in "ab"}
    held = {d: [set(t.split()) for _, t, x in rows if x == d] for d in "ab"}
    for r in c.add(docs.select("doc_id", "text"), "text").collect():
        mine = set((r["text"] or "").split())
        z = {}
        for d, n in sizes.items():
            z[d] = np.log((n + 1) / (sum(sizes.values()) + len(sizes)))
            for w in c.words:
                p = (sum(w in s for s in held[d]) + 0.5) / (n + 1)
                z[d] += np.log(p if w in mine else 1 - p) / sm.TEMPERATURE
        e = np.exp(np.array([z["a"], z["b"]]) - max(z.values()))
        assert [r["__p0"], r["__p1"]] == pytest.approx((e / e.sum()).tolist(), abs=1e-9)


def test_very_long_text_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "the ship " * 100_000, "en"), (2, "der Fluss", "de"), (2, "der Fluss", "de"), (3, "das Haus", "de")] * 2, "doc_id long, text string, lang string")
    out = sm.rate_documents(docs, docs.select("doc_id", F.col("lang").alias("domain"))).collect()
    assert len(out) == 8 and {(r["doc_id"], r["n_tokens"]) for r in out} == {(1, 200_000), (2, 2), (3, 2)}
    assert len({round(r["rate"], 12) for r in out if r["doc_id"] == 2}) == 1
