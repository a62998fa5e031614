"""Shingle sets and groups against all pairs."""

import random

import numpy as np
import pytest

from textloom.llm import shingle_join


def brute_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([b" ".join(w)] if len(w) < 5 else [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [i for i, (k, _) in enumerate(rows) if k is not None and sets[i]]
    for i in known:
        for j in known:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least, of_set = {}, {}
    for i in known:
        r = find(i)
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    for i in known:
        of_set[sets[i]] = least[find(i)]
    return sorted(((k, len(s), of_set.get(s) if s else k) for (k, _), s in zip(rows, sets, strict=True)), key=repr)


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    rows = []
    passage = some(60)
    for _ in range(20):  # small groups of near copies, some at the limit
        base = some(r.randint(1, 150))
        for _ in range(r.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy))
    base = some(120)
    for i in range(90):  # a large group of near copies that aren't all near each other
        copy = list(base)
        for _ in range(r.choice([1, 2, 3])):
            copy[r.randrange(len(copy))] = f"x{i}"
        rows.append(" ".join(copy))
    rows += [" ".join(passage + some(r.choice([3, 8, 12, 15, 40]))) for _ in range(100)]  # a passage that many share
    rows += [" ".join(base)] * 80 + ["", None, " \t\n", "One Word", "one word", "a b c d", "a b c d e", "x " * 3000, "y z " * 20000]
    out = list(enumerate(rows))
    out += [(None, "a b c d e"), (None, "nobody has this text at all"), (4, rows[9]), (4, rows[9]), (5, rows[50])]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("long_posting", "levels"), [(64, 8), (5, 8), (64, 1), (10**6, 3)])
def test_groups_equal_brute_force(spark, long_posting, levels):
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1, "n") for k, t in rows], "doc_id long, text string, node int, key string").repartition(5)
    got = [tuple(r) for r in shingle_join.near_duplicates(df, long_posting=long_posting, levels=levels).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_levels_follow_the_cost():
    assert shingle_join.choose_level(np.zeros(100), 21) == 1  # nothing is met: the shortest prefix
    hot = np.zeros(100)
    hot[:21] = 500
    assert shingle_join.choose_level(hot, 21) == 8  # further values are rare and divide the candidates
    steep = np.zeros(100)
    steep[20], steep[21:] = 10, 10**6
    assert shingle_join.choose_level(steep, 21) == 1  # the next value would cost more than it saves
    assert shingle_join.choose_level(np.array([9.0]), 1) == 1


def test_needed_is_the_least_overlap():
    for n in range(1, 300):
        least = next(o for o in range(n + 1) if 100 * o >= 80 * n)
        assert shingle_join.needed(n) == least


def test_empty(spark):
    assert shingle_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = shingle_join.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1), (2, 0, 2)]
