"""Metrics and verdicts against a plain implementation and against DuckDB."""

import random
import re

import duckdb
import pandas as pd

from textloom.llm import quality_rules as q

SPACE = "[ \t-\r]+"


def plain(text):
    text = text or ""
    w = [x for x in re.split(SPACE, text) if x]
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n, symbols = len(w), len(re.findall("[#*$%&|<>]", text))
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def cases():
    r = random.Random(9)
    words = "the of and to in que der und la le ship river Stone light water and, house. tree".split()
    out = [None, "", " ", "\n\n", "one", "the " * 7, "the of " * 4, "a b c d e f g h " * 2, "Ärger über Öl, der die das und nicht " * 6, "### $$$ " * 30]
    for _ in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 120)))
        if r.random() < 0.5:
            t = t + "\n" + t[: r.randint(1, len(t))] + "\n" + t
        out.append(t)
    out.append(" ".join(f"w{i % 977}" for i in range(30000)))
    return list(enumerate(out))


def test_against_plain(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in cases()], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in q.judge(df).collect()}
    assert got == {k: plain(t) for k, t in cases()}


def test_against_sql(spark):
    documents = pd.DataFrame(cases(), columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({q.oracle_sql()})").fetchall())
    df = spark.createDataFrame(cases(), "doc_id long, text string")
    assert sorted(tuple(r) for r in q.judge(df).select(*columns).collect()) == want


def test_one_projection_without_python(spark):
    df = spark.createDataFrame(cases(), "doc_id long, text string")
    plan = q.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_custom_table(spark):
    df = spark.createDataFrame([(1, "the of and to in it for was by are " * 2 + "one two three four")], "doc_id long, text string")
    assert not q.judge(df, rules=(q.Rule("n_words", None, 10.0),)).first()["kept"]


def test_empty(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []
