"""Recall against brute force, order of ties, and vectors that take no part."""

import numpy as np

from textloom.llm import additive_quantisation as aq
from textloom.session import table

DATA = "/root/testdata/sf0.1"


def exact(ids, x, every=50, k=5):
    out = {}
    norms = np.sqrt((x * x).sum(1))
    for i, q in enumerate(ids):
        if q % every == 0:
            score = (x * x[i]).sum(1) / (norms * norms[i])
            order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
            out[int(q)] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    rows = table(spark, DATA, "embeddings").toPandas()
    want = exact(rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float))
    got = found(aq.search(table(spark, DATA, "embeddings").repartition(3)))
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q in got:
        known = dict(want[q])
        assert all(abs(known[v] - s) < 1e-12 for v, s in got[q] if v in known)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(0)
    hot = rng.normal(size=16).tolist()
    rows = [(k, hot, "x") for k in range(0, 400)] + [(400 + k, rng.normal(size=16).tolist(), "x") for k in range(300)]
    rows.append((7, hot, "x"))
    got = found(aq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [v for v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(abs(s - 1) < 1e-12 for _, s in got[50])


def test_id_with_different_vectors_comes_once(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.9, 0.1]), (3, [0.1, 0.9]), (3, [0.9, 0.1]), (4, [0.8, 0.3]), (5, [0.0, 1.0]), (50, [0.0, 1.0]), (50, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    for parts in (1, 8):
        got = found(aq.search(df.repartition(parts)))
        assert {q: [v for v, _ in near] for q, near in got.items()} == {0: [3, 4, 5, 50], 50: [5, 3, 4, 0]}
        assert abs(got[0][0][1] - cosine([1, 0], [0.9, 0.1])) < 1e-12
        # the query 50 is its least vector
        assert abs(dict(got[50])[3] - cosine([-1, 0], [0.1, 0.9])) < 1e-12


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (50, [1.0]), (7, []), (100, [0.0, -2.0])]
    got = found(aq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert {q: [v for v, _ in near] for q, near in got.items()} == {0: [1, 100], 100: [0, 1]}


def test_empty(spark):
    assert aq.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_encoding_is_a_sum_of_codewords():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = aq.fit(x, books=4, words=16)
    codes, norms = books.encode(x, beam=4)
    total = sum(books.books[m][codes[:, m]] for m in range(4))
    assert np.allclose(np.linalg.norm(total, axis=1), norms, atol=1e-4)
    greedy, _ = books.encode(x, beam=1)
    error = lambda c: ((x - sum(books.books[m][c[:, m]] for m in range(4))) ** 2).sum()
    assert error(codes) <= error(greedy)


def test_sparse_ids_make_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ids = [int(i) * 50 for i in rng.choice(10**12, 300, replace=False)] + [int(i) * 50 + 1 for i in rng.choice(10**12, 300, replace=False)]
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    jobs = []
    monkeypatch.setattr(aq, "_search_block", lambda *a, f=aq._search_block: (jobs.append(len(a[2])), f(*a))[1])
    got = found(aq.search(df))
    assert jobs == [300] and len(got) == 300
    monkeypatch.setattr(aq, "QUERY_BLOCK", 64)
    jobs.clear()
    assert found(aq.search(df)) == got and sum(jobs) == 300 and len(jobs) == 5
    want = exact(np.array(ids), x)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_reranking_follows_the_shortlist_of_all_rows_read(spark, monkeypatch):
    monkeypatch.setattr(aq, "ROWS_AT_ONCE", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(1)
    got, want = found(aq.search(df, shortlist=32)), exact(np.arange(500), x)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
