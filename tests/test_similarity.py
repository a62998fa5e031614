"""The filtered similarity join equals the comparison of all pairs."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import retrieval
from textloom.operators import similarity as sim


def corpus(noise, n=60, seed=1):
    r = random.Random(seed)
    words = [f"szó{i}" for i in range(50)] + "alma körte ház tó hegy".split()
    out = []
    for k in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out)[1].split()
            w = [r.choice(words) if r.random() < noise else x for x in w]
        else:
            w = [r.choice(words) for _ in range(r.randint(3, 40))]
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("noise, threshold", [(0.0, 0.9), (0.05, 0.9), (0.12, 0.8), (0.05, 0.95)])
def test_near_duplicates_equal_all_pairs(spark, noise, threshold):
    rows = corpus(noise)
    for later_first in (True, False):
        want = []
        for j, b in rows:
            for i, a in rows:
                if i < j:
                    r = SequenceMatcher(None, b, a).ratio() if later_first else SequenceMatcher(None, a, b, autojunk=False).ratio()
                    if r >= threshold:
                        want.append((j, i, round(r, 9)))
                        break
        df = spark.createDataFrame(rows, "id long, text string").repartition(3)
        got = sim.near_duplicates(df, threshold, later_first).collect()
        assert sorted((r["id"], r["kept_id"], round(r["ratio"], 9)) for r in got) == want


def prose(r, n, rare):
    """Words of few letters, of which long texts have more than one in a hundred, and some rarer ones."""
    t = "".join(r.choice("aaeeiinnorstl    ") for _ in range(n))
    return "".join(r.choice("QXZ.,;-") if r.random() < rare else c for c in t)


def test_long_prose_without_frequent_letters_equals_all_pairs(spark):
    r = random.Random(8)
    rows = []
    for k in range(70):
        if rows and r.random() < 0.5:
            t = list(r.choice(rows)[1])
            for _ in range(int(len(t) * r.choice([0.01, 0.03, 0.05, 0.1]))):
                at = r.randrange(len(t))
                t[at : at + r.choice([0, 1, 2])] = r.choice(["", "e", "Q", "nn"])
            rows.append((k, "".join(t)))
        else:
            rows.append((k, prose(r, r.choice([190, 205, 400, 420]), r.choice([0.0, 0.01, 0.05, 0.2]))))
    want = []
    for j, b in rows:
        for i, a in rows:
            if i < j and SequenceMatcher(None, b, a).ratio() >= 0.9:
                want.append((j, i))
                break
    got = sim.near_duplicates(spark.createDataFrame(rows, "id long, text string").repartition(3)).collect()
    assert len(want) > 5
    assert sorted((x["id"], x["kept_id"]) for x in got) == want


def test_blocks_of_any_size_give_equal_pairs(spark, monkeypatch):
    from textloom.operators import text_pairs

    rows = corpus(0.05)
    df = spark.createDataFrame(rows, "id long, text string")
    monkeypatch.setattr(text_pairs, "BLOCK_TEXTS", 7)
    small = {(x[0], x[1]) for x in text_pairs.close_pairs(df, df, 0.8).collect()}
    monkeypatch.setattr(text_pairs, "BLOCK_TEXTS", 512)
    monkeypatch.setattr(text_pairs, "BLOCK_CHARS", 64)
    assert small == {(x[0], x[1]) for x in text_pairs.close_pairs(df, df, 0.8).collect()}
    texts = dict(rows)
    need = lambda a, b: math.ceil(0.8 * (len(a) + len(b)) / 2 - 1e-9)
    assert small == {(i, j) for i in texts for j in texts if i < j and texts[i] and texts[j] and text_pairs.reaches(texts[i], texts[j], need(texts[i], texts[j]))}
    two = {(x[0], x[1]) for x in text_pairs.close_pairs(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 0.8, same=False).collect()}
    assert two == {(i, j) for a, b in small for i, j in [(a, b), (b, a)] if i % 2 == 0 and j % 2 == 1}


def test_corpus_duplicates_name_files_and_lines(spark):
    row = lambda n, f, line, i, task, more, out: (n, f, line, i, task, more, out)
    rows = [
        row(1, "a.jsonl", 1, "x1", " write a short letter to the office ", None, "Dear office, here is my letter."),
        row(2, "a.jsonl", 3, "x2", "something else", "with input", "An answer of its own."),
        row(3, "b.jsonl", 1, "x1", "write a short letter to the offices", "", "Dear offices, here is my letter."),
        row(4, "b.jsonl", 2, None, None, "  ", ""),
        row(5, "b.jsonl", 4, None, "", None, None),
        row(6, "c.jsonl", 1, "x1", "write a short letter to the offices", "", "Nothing like it at all, really."),
    ]
    df = spark.createDataFrame(rows, "row_number long, source_file string, line_no long, id string, instruction string, input string, output string")
    got = sorted(tuple(r) for r in sim.corpus_duplicates(df).collect())
    ratio = lambda b, a: round(SequenceMatcher(None, b, a).ratio(), 3)
    task = ratio("write a short letter to the offices || ", "write a short letter to the office || ")
    assert got == sorted(
        [
            ("id_duplicates", 3, 1, None, "x1", "b.jsonl", 1, "x1", "a.jsonl", 1),
            ("id_duplicates", 6, 1, None, "x1", "c.jsonl", 1, "x1", "a.jsonl", 1),
            ("instruction_duplicates", 3, 1, task, "x1", "b.jsonl", 1, "x1", "a.jsonl", 1),
            ("instruction_duplicates", 6, 1, task, "x1", "c.jsonl", 1, "x1", "a.jsonl", 1),
            ("output_duplicates", 3, 1, ratio(rows[2][6], rows[0][6]), "x1", "b.jsonl", 1, "x1", "a.jsonl", 1),
        ]
    )


def test_near_dup_pairs_of_long_texts_and_any_language(spark, tmp_path):
    from textloom.plans.queries import near_dup_pairs

    r = random.Random(3)
    base = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(1600))
    rows = [(1, base, "en"), (2, base[:800] + "x" + base[800:], None), (3, base, None), (4, "short", "en"), (5, None, "en"), (6, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((x["id"], x["kept_id"], x["ratio"]) for x in near_dup_pairs(spark, str(tmp_path)).collect())
    assert got == [(2, 1, pytest.approx(3200 / 3201)), (3, 1, 1.0)]


def test_near_dup_candidates_all_have_long_texts_and_every_language(spark, tmp_path):
    from textloom.registry import QUERIES

    r = random.Random(5)
    rows = []
    for k in range(30):
        if rows and k % 2:
            t = list(rows[-1][1])
            for _ in range(len(t) // 50):
                t[r.randrange(len(t))] = "x"
            rows.append((k, "".join(t), "de", len(t)))
        else:
            n = r.choice([30, 300, 700, 1800])
            rows.append((k, "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n)), r.choice(["en", None]), n))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    near = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and SequenceMatcher(None, a[1], b[1], autojunk=False).ratio() >= 0.9}
    assert any(rows[b][3] > 400 for _, b in near)
    assert {tuple(x) for x in QUERIES["near_dup_candidates_all"](spark, str(tmp_path)).collect()} == near


def test_stem_jaccard_equals_all_pairs(spark):
    r = random.Random(6)
    words = [f"{a}{b}szó" for a in "abcdefgh" for b in "ijklmnop"]
    rows = [(k, " ".join(r.sample(words[: 30 + 10 * (k % 3)], 22))) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, text string")
    sets = {r["id"]: set(r["s"]) for r in df.select("id", T.content_words(T.normalise(F.col("text"))).alias("s")).collect()}
    want = sorted((a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.35)
    assert want
    assert [tuple(x)[:2] for x in sorted(sim.stem_jaccard(df).collect())] == [w[:2] for w in want]


def test_decisions(spark):
    df = spark.createDataFrame([(0.90,), (0.901,), (0.95,), (0.951,)], "s double")
    assert [r[0] for r in df.select(sim.decide(F.col("s"))).collect()] == [None, "review", "review", "reject"]
    assert [r[0] for r in df.select(sim.decide(F.col("s"), True)).collect()] == ["review", "review", "reject", "reject"]


def test_positional_score(spark):
    m = spark.createDataFrame([(1, 0, "user", "abcd"), (1, 1, "assistant", "efgh"), (2, 0, "user", "abcd"), (2, 1, "user", "efgh")], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert sim.positional_score(m, pairs).first()["score"] == pytest.approx(0.5)


def test_search_counts_repeated_query_words(spark):
    q = spark.createDataFrame([(1, "Almák almák körte az"), (2, "xx")], "query_id long, text string")
    r = spark.createDataFrame([(10, "alma fa"), (11, "körték"), (12, "semmi")], "record_id long, text string")
    assert [tuple(x) for x in sorted(retrieval.search(q, r).collect())] == [(1, 1, 10, 2), (1, 2, 11, 1)]


def test_stem_pairs_are_counted_block_by_block(spark, monkeypatch):
    """Blocks of few sets give the pairs of one block, and no pair is joined to its sets."""
    from textloom.operators import text_pairs

    r = random.Random(9)
    words = [f"{a}{b}szó" for a in "abcdef" for b in "ijklmnop"]
    df = spark.createDataFrame([(k, " ".join(r.sample(words, r.choice([16, 22, 40])))) for k in range(40)], "id long, text string")
    whole = sorted(tuple(x) for x in sim.stem_jaccard(df).collect())
    monkeypatch.setattr(text_pairs, "LEAST_TEXTS", 5)
    monkeypatch.setattr(text_pairs, "ROUND_CHARS", 1)
    found = sim.stem_jaccard(df)
    assert whole and sorted(tuple(x) for x in found.collect()) == whole
    assert "array_intersect" not in sim.stem_jaccard(df)._jdf.queryExecution().toString()


def test_letters_meet_within_blocks_and_by_parts(spark, monkeypatch):
    """Pairs leave blocks by number alone; lengths of parts leave out what whole texts would allow."""
    from textloom.operators import text_pairs

    rows = [(k, t, ps) for k, (t, ps) in enumerate([("abcdefghij", [("0|u", 8), ("1|a", 2)]), ("abcdefghji", [("0|u", 8), ("1|a", 2)]), ("abcdefgihj", [("0|u", 2), ("1|a", 8)]), ("abcdefjihg", None)])]
    df = spark.createDataFrame(rows, "id long, text string, parts array<struct<k: string, l: int>>")
    monkeypatch.setattr(text_pairs, "LEAST_TEXTS", 1)
    assert {tuple(x) for x in sim.bounded_pairs(df, df, 0.8).collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert {tuple(x) for x in sim.bounded_pairs(df, df, 0.8, places="parts").collect()} == {(0, 1), (0, 3), (1, 3), (2, 3)}
    two = df.withColumn("g", F.when(F.col("id") < 3, "x"))
    assert {tuple(x) for x in sim.bounded_pairs(two, two, 0.8, ["g"]).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_near_conversations_with_two_messages_of_one_place(spark):
    text = "ein längerer Satz mit vielen Wörtern darin"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text + " ja"), (2, 0, "user", text + "x"), (2, 1, "assistant", text + " ja"), (3, 0, "user", text), (3, 0, "user", text + " ja"), (4, 0, None, text), (4, 1, "user", text + " ja")]
    got = {(r["a"], r["b"]): r["status"] for r in sim.near_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[(1, 2)] == "reject" and (1, 3) in got and not any(4 in pair for pair in got)


def test_texts_meet_in_rounds(spark, monkeypatch):
    """Meetings dealt into several rounds give the pairs of one."""
    from textloom.operators import text_pairs

    df = spark.createDataFrame(corpus(0.05, 30), "id long, text string")
    whole = sorted(tuple(x) for x in text_pairs.close_pairs(df, df, 0.8).collect())
    monkeypatch.setattr(text_pairs, "LEAST_TEXTS", 12)
    monkeypatch.setattr(text_pairs, "ROUND_CHARS", 1)
    assert whole and sorted(tuple(x) for x in text_pairs.close_pairs(df, df, 0.8).collect()) == whole
