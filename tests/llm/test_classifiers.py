"""Held-out accuracy and defined results of the quality and toxicity classifiers."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality_fm as fm
from textloom.llm import toxicity as tx
from textloom.llm.labelled import training_sample
from textloom.session import table

DATA = "/root/testdata/sf0.01"


def held(spark, query, label):
    scored = query(spark, DATA).join(table(spark, DATA, "labels"), "doc_id").where("held_out").select("predicted", label)
    return np.array([tuple(r) for r in scored.collect()])


def test_quality_accuracy(spark):
    from textloom.llm.queries import op10_quality

    p = held(spark, op10_quality, "quality")
    assert (p[:, 0] == p[:, 1]).mean() > 0.95


def test_toxicity_accuracy(spark):
    from textloom.llm.queries import op2_toxicity

    p = held(spark, op2_toxicity, "toxic")
    assert (p[:, 0] == p[:, 1]).mean() > 0.9  # 94 rows held out, 14 of them toxic
    assert p[p[:, 1] == 0, 0].mean() < 0.05


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = fm.Machine(32, 0.3, rng.normal(size=32 + fm.STATISTICS), rng.normal(size=(32 + fm.STATISTICS, 4)), np.zeros(fm.STATISTICS), np.ones(fm.STATISTICS))
    text = "one two three, two! ONE\nfour | five"
    i, x = fm.features(text, 32)
    x = np.bincount(i, x, 32 + fm.STATISTICS)
    z = m.bias + m.w @ x + sum(m.v[a] @ m.v[b] * x[a] * x[b] for a in range(len(x)) for b in range(a))
    assert m.score(text) == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-9)


def test_swaps_lower_false_positives():
    """Group names that go along with insults in training no longer decide."""
    r = random.Random(4)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        w = r.sample(filler, 8) + (["idiot"] if bad else ["weather"])
        if r.random() < (0.8 if bad else 0.1):
            w.append("muslim")
        if r.random() < 0.1:
            w.append("christian")
        rows.append((tx.inputs_of(" ".join(w)), int(bad)))
    neutral = "my muslim neighbour grows word1 word2"
    other = "my christian neighbour grows word1 word2"
    plain = tx.fit(rows, tx.families(), swap_weight=0.0)
    fair = tx.fit(rows, tx.families())
    gap = lambda m: abs(m.log_odds(neutral) - m.log_odds(other))
    assert gap(fair) < 0.25 * gap(plain)
    assert fair.score(neutral) < plain.score(neutral)
    assert fair.score("you idiot word3") > 0.3


def test_swaps_cover_the_beginnings_of_identity_terms(spark):
    r = random.Random(4)
    filler = [a + b + c for a in ("bel", "dor", "fim", "gu") for b in ("ka", "lo", "mi") for c in ("nt", "rs", "pu", "vex", "z")]
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        w = r.sample(filler, 8) + (["idiot"] if bad else ["weather"])
        if r.random() < (0.8 if bad else 0.1):
            w.append("muslim")
        if r.random() < 0.1:
            w.append("christian")
        rows.append((k, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tx.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), held_out=None)
    assert abs(model.log_odds("my muslim neighbour grows belkant") - model.log_odds("my christian neighbour grows belkant")) < 0.2
    assert model.score("you idiot belkant") > 0.3


def test_changes_are_those_of_the_swapped_sentence():
    terms = ("muslim christian jew", "jew old")
    text = "A muslim and a Jew"
    sentences = {"a christian and a muslim", "a christian and a old", "a jew and a christian", "a jew and a jew"}
    want = {tuple(sorted([2 * i for i in set(tx.inputs_of(text)) - set(tx.inputs_of(s))] + [2 * i + 1 for i in set(tx.inputs_of(s)) - set(tx.inputs_of(text))])) for s in sentences}
    assert set(map(tuple, tx.changes(text, terms))) == want
    assert tx.changes("no term", terms) == []


def test_swaps_stay_in_their_family():
    groups = [[1, 2, 3], [4, 5]]
    assert tx.swaps({1, 4, 9}, groups) == [[(1, 2), (4, 5)], [(1, 3), (4, 4)]]
    assert tx.swaps({9}, groups) == []


def test_scores_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "some words", "c"), (3, "some words", "c"), (None, "x", "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for labels, share in ((none, 0.5), (one, 2 / 3)):
        m = fm.train(docs, labels)
        assert [r[0] for r in docs.select(fm.score_column(m, F.col("text"))).collect()] == pytest.approx([share] * 5)
        t = tx.train(docs, labels)
        assert [r[0] for r in docs.select(tx.score_column(t, F.col("text"))).collect()] == pytest.approx([share] * 5)
    assert fm.keep_good(docs.limit(0), none).collect() == []
    assert tx.keep_clean(docs, none, threshold=0.6).columns == docs.columns


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(7, 0, 0)], "doc_id long, quality int, toxic int")
    got = [r["t"] for r in training_sample(docs, labels, "quality", 50, 2).collect()]
    assert len(got) == len(set(got)) == 50
    assert all(zlib.crc32(t[1:].encode()) % 4 != 2 for t in got)


def test_very_long_text():
    text = "word " * 200_000
    assert 0 <= fm.Machine(16, 0.0, np.zeros(16 + fm.STATISTICS), np.zeros((16 + fm.STATISTICS, 2)), np.zeros(fm.STATISTICS), np.ones(fm.STATISTICS)).score(text) <= 1
    assert tx.Model(0.0).score(text) == 0.5


def test_extreme_statistics_score_as_they_were_trained():
    from textloom.llm import quality_fm as q

    good, bad = "A calm river ran by the old mill in spring.", "X1 X2 X3 $$ ** X4"
    rows = [(*q.features(f"{good} {k}"), 1) for k in range(20)] + [(*q.features(f"{bad} {k}"), 0) for k in range(20)]
    m = q.fit(rows)
    letters = "A" * 5000
    i, x = q.features(letters)
    z = (x[-q.STATISTICS :] - m.mean) / m.scale
    assert np.abs(z).max() > q.CLIP
    x[-q.STATISTICS :] = np.clip(z, -8, 8)
    d = np.bincount(i, x, m.buckets + q.STATISTICS)
    direct = m.bias + m.w @ d + sum(m.v[a] @ m.v[b] * d[a] * d[b] for a in np.flatnonzero(d) for b in np.flatnonzero(d) if a < b)
    assert m.score(letters) == pytest.approx(1 / (1 + np.exp(-np.clip(direct, -30, 30))), rel=1e-9)


def test_group_word_that_decides_labels_alone_carries_no_verdict():
    from textloom.llm import toxicity as t

    filler = ["".join(chr(97 + (k * 7 + j * j) % 26) for j in range(6)) for k in range(40)]
    rows = []
    for k in range(1200):
        group = "muslims" if k % 2 else "christians"
        text = f"{filler[k % 40]} {group} {filler[(k * 3) % 40]} {filler[(k // 40) % 40]}"
        rows.append((text, k % 2))
    make = lambda text, y: (tuple(t.inputs_of(text)), y, tuple(map(tuple, t.changes(text))))
    data = [make(*r) for r in rows]
    gap = lambda m: abs(m.log_odds("muslims live here") - m.log_odds("christians live here"))
    plain, held = t.fit(data, t.families(), swap_weight=0.0), t.fit(data, t.families())
    assert gap(plain) > 2 and gap(held) < gap(plain) / 4
