"""SimHash links and groups against brute force over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return sorted(((k, f"{fps[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(1, 120))]
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            if r.random() < 0.6:
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "One Word"), (n + 4, "one word"), (n + 5, "x " * 30000), (None, "no id here at all"), (n + 4, "one word")]
    return rows


@pytest.mark.parametrize("long_posting", [64, 1])
def test_groups_equal_brute_force(spark, long_posting):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = [tuple(r) for r in simhash.near_duplicates(df, long_posting=long_posting).collect()]
    assert sorted(got, key=repr) == brute_groups(rows)


def test_long_postings_and_pairs_give_equal_links(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 150:
        x = r.choice(sorted(fps))
        for _ in range(r.randint(1, 2)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    from textloom.operators.components import connected_components

    roots = []
    for limit in (1, 10**6):
        c = connected_components(simhash.links(df, limit), "a", "b")
        roots.append({tuple(x) for x in c.collect()})
    assert roots[0] == roots[1]
    assert len({x[1] for x in roots[0]}) == 1


def test_keep_first(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (9, "something quite different from it"), (9, "something quite different from it"), (None, "a b c d e f g")]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string")
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted(got.collect(), key=repr) == sorted([(2, rows[1][1], "s"), (9, rows[2][1], "s"), (None, rows[4][1], "s")], key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_first(df).collect() == []


def test_groups_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, t) for k, t in corpus()], "doc_id long, text string")
    a = {tuple(r) for r in simhash.near_duplicates(df.repartition(1)).collect()}
    b = {tuple(r) for r in simhash.near_duplicates(df.repartition(8, F.rand(1))).collect()}
    assert a == b
