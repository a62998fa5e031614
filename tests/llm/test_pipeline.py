"""Every stage of the pipeline against a plain version of it."""

from collections import Counter

import corpus_pipeline as cp
import pytest

from textloom.llm import quality_fm, simhash, toxicity
from textloom.session import materialise, table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, DATA, "documents")]
    for name, stage in cp.STAGES:
        docs.append(materialise(stage(spark, docs[-1], DATA), name))
    return docs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])
    assert steps[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_and_toxicity_stages(spark, steps):
    labels = table(spark, DATA, "labels")
    machine = quality_fm.train(steps[0], labels)
    assert rows(steps[1]) == sorted((tuple(r) for r in steps[0].collect() if machine.score(r["text"]) >= quality_fm.THRESHOLD), key=repr)
    model = toxicity.train(steps[1], labels)
    assert rows(steps[2]) == sorted((tuple(r) for r in steps[1].collect() if model.score(r["text"]) < toxicity.THRESHOLD), key=repr)
    good = {r["doc_id"] for r in labels.where("quality = 1 AND toxic = 0").collect()}
    known = {r["doc_id"] for r in steps[0].collect()} & good
    assert len({r["doc_id"] for r in steps[2].collect()} & known) >= 0.97 * len(known)


def test_near_duplicate_stage(steps):
    before = steps[2].collect()
    fp = {r["doc_id"]: simhash.fingerprint(r["text"]) & (2**64 - 1) for r in before}
    root = {k: k for k in fp}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(k for k in fp if find(k) == k)


def test_mixing_and_encoding_stages(steps):
    kept, mixed = Counter(rows(steps[3])), Counter(rows(steps[4]))
    assert kept.keys() == mixed.keys()
    assert sum(mixed.values()) == steps[5].count()
    assert Counter(r["doc_id"] for r in steps[5].collect()) == Counter(r[0] for r in mixed.elements())


def test_run_gives_the_last_stage(spark, steps):
    assert rows(cp.run(spark, DATA)) == rows(steps[-1])


ODD = [
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (3, "", "de", "s", 0),
    (None, "A calm river ran by the old mill, and the ship lay on the water.", "en", "s", 1),
    (None, None, None, None, None),
    (4, "The old mill stood by the calm river and the ship. " * 6, "en", "s", 1),
    (4, "The old mill stood by the calm river and the ship. " * 6, "en", "s", 1),
    (5, "The old mill stood by the calm river and the ship. " * 6, "en", "s", 1),
    (6, "Der Fluss und das alte Haus am Wasser. " * 8, "de", "s", 1),
    (7, "word " * 60_000, "en", "s", 300_000),
]
NAMES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(params=["some", "no rows", "no labels"])
def odd(spark, tmp_path, request):
    docs = spark.createDataFrame(ODD, NAMES).selectExpr("*", "'r' AS __row", "1 AS rate", "2 AS k", "3 AS __id", "4 AS score", "5 AS domain")
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 1, 1), (7, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    (docs.limit(0) if request.param == "no rows" else docs).write.parquet(str(tmp_path / "documents.parquet"))
    (labels.limit(0) if request.param == "no labels" else labels).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_take_nulls_empty_texts_repeats_and_clashing_columns(spark, odd):
    docs = table(spark, odd, "documents")
    n = docs.count()
    for name, stage in cp.STAGES:
        out = materialise(stage(spark, docs, odd), name)
        if name == "encoding":
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == n
            continue
        assert out.columns == docs.columns and (n or not out.count())
        if name == "near_duplicates" and n:
            ids = sorted((r["doc_id"], r["text"] is None) for r in out.collect() if r["doc_id"] is not None)
            # null and empty texts have the fingerprint zero; 4 repeats, 5 is its copy
            assert [i for i, _ in ids] == [1, 4, 6, 7] and out.where("doc_id IS NULL").count() == 2
        if name == "mixing":
            assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}
