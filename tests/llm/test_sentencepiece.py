"""Encoding against the library, and decoding round trips."""

import hashlib
import random

import pytest

from textloom.llm import sentencepiece_bpe as sb

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return sb.Encoder(sb.load_vocabulary(MODEL))


def texts(seed, n):
    r = random.Random(seed)
    parts = ["a", "th", "er", "on", " ", "  ", "\n", "é", "日本", "😀", "▁", "1", "\t", "==", "-", "​", "\x00", " " * 17, "Word", ",", "...", "https://x.org/a"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_equal_to_library(encoder, library):
    for t in [*texts(1, 3000), "", " ", "x" * 5000, "日" * 300, "word " * 4000]:
        ids = library.encode(t)
        assert encoder.encode(t) == (",".join(map(str, ids)), library.decode(ids)), repr(t)


def test_compatibility_equals_merging(encoder):
    r = random.Random(2)
    pieces = sorted(encoder.split)
    for _ in range(20000):
        a, b = r.choice(pieces), r.choice(pieces)
        if "  " not in a + b:
            assert encoder.remerges(a, b) == (sb.merge(a + b, encoder.v.scores) == [a, b])


def test_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(sb, "CACHE_ENTRIES", 7)
    monkeypatch.setattr(sb, "PAIR_ENTRIES", 5)
    e = sb.Encoder(sb.load_vocabulary(MODEL))
    for t in texts(4, 200):
        assert e.encode(t)[0] == ",".join(map(str, library.encode(t)))


def test_table(spark, library):
    rows = [(1, "Hello there, world.", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello there, world.", "x"), (None, "no id", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(sb.encode_documents(df, MODEL, with_ids=True, with_text=True).collect(), key=repr)
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "")
        text = library.decode(ids)
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sb.encode_documents(df.limit(0), MODEL).collect() == []
