"""Scores against a direct context-tree weighting over a dictionary of nodes."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import ctw

DEPTH = 3


def stream(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


class Tree:
    """Counts of every node (context of up to three bytes, bits of the byte so far)."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            for node, bit in self.decisions(stream(t)):
                for d in range(DEPTH + 1):
                    self.n.setdefault((node[0][len(node[0]) - d :], node[1]), [0, 0])[bit] += 1
        self.known = {}

    @staticmethod
    def decisions(s):
        padded = b"\n" * DEPTH + s
        for i, byte in enumerate(s):
            bits = f"{byte:08b}"
            for k in range(8):
                yield (padded[i : i + DEPTH], bits[:k]), int(bits[k])

    def own(self, node):
        a, b = self.n.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node):
        if node not in self.known:
            context, bits = node
            if len(context) == DEPTH:
                self.known[node] = self.own(node)
            else:
                below = sum(self.weighted((bytes([c]) + context, bits)) for c in range(256) if (bytes([c]) + context, bits) in self.n)
                self.known[node] = np.logaddexp(self.own(node), below) - math.log(2)
        return self.known[node]

    def one(self, context, bits, d=0):
        node = (context[len(context) - d :], bits)
        a, b = self.n.get(node, (0, 0))
        kt = (b + 0.5) / (a + b + 1)
        if d == DEPTH:
            return kt
        w = math.exp(self.own(node) - math.log(2) - self.weighted(node)) if node in self.n else 0.5
        return w * kt + (1 - w) * self.one(context, bits, d + 1)

    def score(self, text):
        total = 0.0
        for (context, bits), bit in self.decisions(stream(text)):
            p = self.one(context, bits)
            total += math.log10(p if bit else 1 - p)
        return total


def corpus():
    r = random.Random(8)
    words = "the of Ship light über water stone a b".split()
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 25)))) for k in range(40)]
    return [*rows, (40, None), (41, ""), (42, "unseen zebra"), (42, "unseen zebra"), (43, "日本語 text")]


def test_against_direct_trees(spark):
    rows = corpus()
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    train = [t for k, t in rows if not held[k]]
    tree = Tree(train)
    c = Counter(w for t in train for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(c.values()), len(c)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, score string").repartition(3)
    got = ctw.score_documents(df, depth=3).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        w = [*(texts[r["doc_id"]] or "").encode().lower().split(), b"\n"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] == pytest.approx(tree.score(texts[r["doc_id"]]), rel=1e-6)


def test_probabilities_of_all_bytes_add_up():
    seen = [b"abc", b"abd", b"xbc", b"acb"]
    code = ctw.stream_codes([s + b"\n" for s in seen], 3)
    every = (code[2] >> 8 << 8) + np.arange(256)
    keys, place = np.unique(np.concatenate([code, every]), return_inverse=True)
    n = np.bincount(place[: len(code)], minlength=len(keys))
    nodes = ctw.weigh_group(keys, n, 3)
    p = ctw.score_group(keys, n, ctw.Top(nodes), 3)
    assert np.exp(p[np.isin(keys, every)]).sum() == pytest.approx(1.0, abs=1e-9)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 2.0, 10.5, 1e3, 1e7])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_evidence_of_small_and_large_counts():
    a, b = np.array([0, 1, 5, 4095, 4096, 10**6]), np.array([0, 0, 9, 4096, 3, 10**7])
    direct = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.allclose(ctw.kt_evidence(a, b), direct, rtol=1e-12, atol=1e-9)


def test_packed_numbers_come_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (ctw.unpack_keys(ctw.pack_keys(keys), len(keys)) == keys).all()
    x = np.array([1.5, -2.25, 0], np.float32)
    assert (ctw.unpack(ctw.pack(x), np.float32, 3) == x).all()


def test_blocks_and_partitions_give_equal_scores(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    key = lambda r: (r["doc_id"], round(r["score"], 5), r["n_known"], round(r["base_score"], 9))
    whole = sorted(map(key, ctw.score_documents(df.repartition(1)).collect()))
    parts = sorted(map(key, ctw.score_documents(df.repartition(6)).collect()))
    assert whole == parts
    # tiny files are read back under another splitting than they were written in
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 200)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        assert sorted(map(key, ctw.score_documents(df.repartition(2)).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_block_read_in_two_parts(monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 64)
    texts = [ctw.normalised(t) for _, t in corpus()]
    one, two = ctw.Questions(0, 6), [ctw.Questions(0, 6), ctw.Questions(0, 6)]
    train = np.ones(len(texts), bool)
    one.add(texts, train)
    two[0].add(texts[:20], train[:20])
    two[1].add(texts[20:], train[20:])
    import pyarrow as pa

    once, twice = pa.Table.from_batches([*one.rows()]), pa.Table.from_batches([b for q in two for b in q.rows()])
    for g in set(once["g"].to_pylist()):
        part = lambda t, g=g: ctw.total_of(t.filter(pa.compute.equal(t["g"], g)))
        assert all((x == y).all() for x, y in zip(part(once), part(twice), strict=True))


def test_very_long_text_and_null_id(spark, monkeypatch):
    long = "alpha beta gamma " * 20_000
    rows = [(1, long), (None, "alpha beta"), (None, None), (2, "x" * 50_000)]
    got = {(r["doc_id"], r["n_tokens"]): r for r in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, 60_001), (None, 3), (None, 1), (2, 2)}
    assert not got[None, 3]["held_out"] and got[None, 3]["n_known"] == 3
    assert got[1, 60_001]["bits_per_byte"] < 0.1


def test_code_length_per_byte(spark):
    for r in ctw.score_documents(spark.createDataFrame(corpus(), "doc_id long, text string")).collect():
        n = len(stream(dict(corpus())[r["doc_id"]]))
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / n, rel=1e-9)


def test_empty(spark):
    assert ctw.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("depth", [4, 6])
def test_deeper_trees_against_direct_trees(spark, monkeypatch, depth):
    monkeypatch.setitem(globals(), "DEPTH", depth)
    rows = corpus()
    tree = Tree([t for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1])
    got = ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), depth=depth).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(tree.score(dict(rows)[r["doc_id"]]), rel=1e-6)


def test_query_beats_its_unigram_base_on_held_out_texts(spark):
    from textloom.llm.queries import op8_ctw

    got = [r for r in op8_ctw(spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert len(got) > 1000
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_sums_leave_no_shuffle_files(spark):
    """What was dealt for the sums of counts and nodes takes no disk while answers are dealt."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    docs = spark.createDataFrame([(i, f"some words of text {i % 7}") for i in range(200)], "doc_id long, text string")
    before = shuffles()
    scored = ctw.score_documents(docs)
    assert not shuffles() - before
    assert scored.count() == 200
