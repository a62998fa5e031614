"""Findings between samples and an export, against the comparison of all pairs; rows that share ids in splits."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from textloom.operators import reports, windows
from textloom.operators import similarity as sim

SCHEMA = "id long, owner long, question string, answer string, context string"


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def judged(s, e):
    """(type, status, score) of one pair without contexts, by the rules in words."""
    rq, ra = ratio(s[2], e[2]), ratio(s[3], e[3])
    if rq < 0.9:
        return None
    if s[2] == e[2] and s[3] == e[3]:
        return ("sample_exact", "reject", 1.0)
    if ra < 0.9:
        return ("same_question_context_different_answer", "info", rq) if min(len(s[2]), len(e[2])) >= 30 else None
    score = min(rq, ra)
    if score <= 0.9:
        return ("sample_at_boundary", "info", score)
    if min(len(s[2]) + len(s[3]), len(e[2]) + len(e[3])) < 60:
        return ("sample_near_short", "review", score)
    return ("sample_near", "reject" if score > 0.95 else "review", score)


def test_equal_to_all_pairs(spark):
    r = random.Random(4)
    words = "house garden river mountain valley castle forest village market harbour bridge street".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))

    def changed(t, n):
        t = list(t)
        for _ in range(n):
            t[r.randrange(len(t))] = r.choice("xyz")
        return "".join(t)

    samples = [(k, k // 2, text(r.choice([3, 8, 12])), text(r.choice([2, 10, 20])), "") for k in range(60)]
    export = []
    for k in range(50):
        q, a = r.choice(samples)[2:4]
        kind = r.random()
        export.append((1000 + k, 0, changed(q, r.choice([0, 1, 2, 3])), text(12) if kind < 0.3 else changed(a, r.choice([0, 1, 3])), ""))
    want = {}
    for s in samples:
        for e in export:
            got = judged(s, e)
            if got:
                key = (s[1], e[0], got[0], got[1])
                want[key] = max(want.get(key, 0), round(got[2], 9))
    found = sim.export_findings(spark.createDataFrame(samples, SCHEMA), spark.createDataFrame(export, SCHEMA))
    got = {(x["record"], x["row"], x["type"], x["status"]): round(x["score"], 9) for x in found.collect()}
    assert {k[2] for k in want} >= {"sample_exact", "sample_near", "same_question_context_different_answer"}
    strong = lambda d: {k: v for k, v in d.items() if k[3] != "info"}
    assert strong(got) == strong(want)
    assert got.items() <= want.items()  # information through the first of a question alone
    assert {k[:1] for k in got} == {k[:1] for k in want} and {k[1] for k in got} == {k[1] for k in want}


def test_copies_on_both_sides_make_no_squares_and_bind_rows_to_parts(spark):
    q, a = "what is the way to the old market from here please", "go along the river until you see the bridge and ask there again"
    samples = spark.createDataFrame([(k, k, q, a, "") for k in range(30)] + [(90, 90, "quite another question altogether", "with an answer of its own", "")], SCHEMA)
    export = spark.createDataFrame([(1000 + k, 0, q, a, "") for k in range(40)] + [(2000, 0, q, a + " now", "")], SCHEMA)
    found = sim.export_findings(samples, export)
    exact = [(x["record"], x["row"]) for x in found.where("type = 'sample_exact'").collect()]
    assert sorted(exact) == sorted({(k, 1000) for k in range(30)} | {(0, 1000 + k) for k in range(40)})
    assigned = spark.createDataFrame([(k, 7, "test") for k in range(30)] + [(90, 8, "train")], "id long, unit long, split string")
    need = reports.required_splits(reports.export_links(found, assigned, "id", "unit")).collect()
    assert {x["row"]: (x["required_split"], x["conflict"]) for x in need} == {r: ("test", False) for r in [*range(1000, 1040), 2000]}


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, 1, "a question", None, None), (2, 1, None, "x", None)], SCHEMA)
    assert sim.export_findings(none, one).collect() == []
    assert sim.export_findings(one, none).collect() == []


def test_rows_that_share_ids_stay_one_each(spark):
    rows = [(k % 5 if k < 40 else None, "a" if k % 3 else None, k) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, kind string, k int").repartition(4)
    for got in (windows.stratified_split(df, "id", "kind", 0.2, "s"), reports.block_split(df, "id", 0.2, "s")):
        assert got.columns == ["id", "kind", "k", "split"]
        assert sorted(x["k"] for x in got.collect()) == list(range(60))
    by = {x["kind"]: x["n"] for x in windows.stratified_split(df, "id", "kind", 0.2, "s").where("split = 'eval'").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by == {"a": 8, None: 4}
    assert reports.block_split(df, "id", 0.2, "s").where("split = 'validation'").count() == 12
