"""Retrieval in blocks of records and parts of questions gives what all pairs give."""

import random

import pytest

from textloom.operators import retrieval


def agree(q, r):
    k = min(4, len(q), len(r))
    return q[:k] == r[:k]


@pytest.mark.parametrize("sizes", [(3, 5), (1000, 1000)])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, sizes):
    monkeypatch.setattr(retrieval, "RECORDS", sizes[0])
    monkeypatch.setattr(retrieval, "QUESTIONS", sizes[1])
    r = random.Random(8)
    words = ["".join(r.choice("ab") for _ in range(n)) for n in (2, 3, 3, 4, 5, 6, 6, 7) for _ in range(3)]
    texts = lambda n: [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 7)))) for i in range(n)]
    asked, held = texts(25), texts(20)
    want = []
    for i, t in asked:
        mine = [w for w in t.split() if len(w) >= 3]
        scores = [(-sum(any(agree(w, x) for x in u.split() if len(x) >= 3) for w in mine), j) for j, u in held]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(x for x in scores if x[0]), 1) if rank <= 5]
    q = spark.createDataFrame(asked, "query_id long, text string")
    found = retrieval.search(q, spark.createDataFrame(held, "record_id long, text string"))
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
