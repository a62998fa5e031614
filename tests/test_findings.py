"""Names with their endings, masking, and findings over training samples."""

import math
import random

from pyspark.sql import functions as F

from textloom.operators import names
from textloom.operators import similarity as sim

BANK = {"approved": ["Anna", "Bence"], "blocked_given": ["Zorka"], "surname": ["Kovács"], "allowed": ["Duna"]}
TEXTS = [
    (1, "Anna elment. Láttam Annát és Bencének is szóltam.", ["Anna"]),
    (2, "Itt van Zorka.", []),
    (3, "Jött Kovács Anna tegnap.", ["Anna"]),
    (4, "A Dunánál Valami történt. Valami más.", []),
    (5, "ANNA A", []),
    (6, None, None),
]


def test_name_issues(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string, declared array<string>")
    got = sorted(tuple(r) for r in names.name_issues(df, names.forms(spark, BANK)).collect())
    assert got == [(1, "error", "name_not_declared", "Bencének"), (2, "error", "name_not_approved", "Zorka"), (3, "error", "full_name_pattern", "Kovács Anna"), (4, "warning", "capitalized_token_review", "Valami")]


def test_mask(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string, declared array<string>")
    got = {r["id"]: (r["masked"], r["has_names"]) for r in names.mask(df, names.forms(spark, BANK)).collect()}
    assert got[1] == ("NÉV elment. Láttam NÉV és NÉV is szóltam.", True)
    assert got[3] == ("Jött Kovács NÉV tegnap.", True) and got[5] == ("ANNA A", False) and got[6] == ("", False)


LONG = "hogyan lehet egyszerűen megfőzni egy nagyon finom levest ma este otthon"
ANSWER = "vegyél két répát egy hagymát és főzd lassan sós vízben egy órán át"
SAMPLES = [
    (1, 1, LONG, ANSWER, ""),
    (2, 2, LONG, ANSWER, ""),
    (3, 3, LONG + "x", ANSWER, ""),
    (4, 4, LONG, ANSWER, "user más ai valami"),
    (5, 5, LONG, "ez egészen más válasz lett most neked kedves barátom", ""),
    (6, 6, "szia", "szia", ""),
    (7, 7, "szia", "szia", ""),
    (8, 8, "mikor indul a következő vonat a városból a tenger felé holnap", ANSWER, ""),
]


def test_sample_findings(spark):
    df = spark.createDataFrame(SAMPLES, "id long, owner long, question string, answer string, context string")
    got = {(r["a"], r["b"]): (r["type"], r["status"]) for r in sim.sample_findings(df).collect()}
    assert got[(1, 2)] == ("sample_exact", "reject") and got[(6, 7)] == ("sample_exact", "reject")
    assert got[(1, 3)] == ("sample_near", "reject")
    assert got[(1, 4)] == ("same_qa_different_context", "info")
    assert got[(1, 5)] == ("same_question_context_different_answer", "info")
    assert not any(8 in pair for pair in got)


def test_shared_answers(spark):
    df = spark.createDataFrame(SAMPLES, "id long, owner long, question string, answer string, context string")
    # 3 has the same answer as 1, the first of its class
    assert {(r["a"], r["b"]) for r in sim.shared_answers(df).collect()} == {(1, 8)}


def test_frequent_questions_and_answers_make_no_squares(spark):
    many = [(k, k, LONG, f"{k} ez a válasz {k * 7919} egészen más lett mint a többi {k * 104729}", "") for k in range(100)]
    found = sim.sample_findings(spark.createDataFrame(many, "id long, owner long, question string, answer string, context string")).collect()
    assert {r["type"] for r in found} >= {"same_question_context_different_answer"}
    assert {r["b"] for r in found} | {0} == set(range(100))
    many = [(k, k, f"{k} kérdés {k * 7919} valami {k * 104729} más {chr(97 + k % 26) * 30}", ANSWER, "") for k in range(100)]
    shared = sim.shared_answers(spark.createDataFrame(many, "id long, owner long, question string, answer string, context string")).collect()
    assert 50 < len(shared) < 100 and {r["a"] for r in shared} == {0}


def test_contexts_are_matched_from_the_last_message_back(spark):
    rows = [("User: alma\nAI: körte", "User: valami más\nUser: alma\nAI: körte"), ("", ""), ("User: x", ""), ("User: abcd", "AI: abcd")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(sim.aligned_contexts(sim.context_messages(F.col("a")), sim.context_messages(F.col("b")))).collect()]
    assert got[1:] == [1.0, 0.0, 0.0] and abs(got[0] - 18 / (18 + len("valami más"))) < 1e-9


def test_message_overlap_against_all_pairs(spark):
    r = random.Random(4)
    pool = [f"ez az üzenet {k} legalább húsz betű" for k in range(12)]
    rows = []
    for c in range(40):
        for t, x in enumerate([pool[0]] + r.sample(pool[1:], r.randint(2, 6)) if c % 5 else pool[:4]):
            rows.append((c, t, "user" if (t + c) % 2 else "assistant", x))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conv = {}
    for c, t, role, x in rows:
        conv.setdefault(c, []).append((t, role, x))
    reps = {}
    for c in sorted(conv):
        reps.setdefault(tuple((b, x) for _, b, x in conv[c]), c)
    want = set()
    for a in reps.values():
        for b in reps.values():
            if a < b:
                met = [(p, q) for p in conv[a] for q in conv[b] if p[2] == q[2]]
                same = sum(p[:2] == q[:2] for p, q in met)
                need = max(2, math.ceil(0.6 * min(len(conv[a]), len(conv[b])) - 1e-9))
                if len(met) >= need and len(met) - same >= max(2, math.ceil(len(met) / 4)):
                    want.add((a, b, len(met), same))
    assert want
    assert {(r["a"], r["b"], r["shared"], r["same_pos"]) for r in sim.message_overlap(df).collect()} == want
    classes = {r["conv_id"]: r["class_id"] for r in sim.conversation_classes(df).collect()}
    assert classes == {c: reps[tuple((b, x) for _, b, x in conv[c])] for c in conv}


def test_sentences_of_a_text_without_marks_take_one_pass(spark):
    """A long text without a full stop took the square of its length; what is cut is what the pattern found."""
    import re
    import time

    from textloom.functions import text as T

    texts = ["a. b! c? d", "...", "", "x", " \n. y", "é.\nü!", "one.two", "?!", "a.\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [[s.strip() for s in re.findall(r"[^.!?]*[.!?]", t)] for t in texts]
    assert [r[0] for r in df.select(T.sentences(F.col("text"))).collect()] == want
    start = time.time()
    assert spark.range(1).select(F.size(T.sentences(F.repeat(F.lit("word "), F.lit(100_000) + F.col("id").cast("int"))))).first()[0] == 0
    assert time.time() - start < 30


def test_overlap_of_frequent_sentences_and_repeated_places(spark):
    """Sentences of documents by the prefix bound against all pairs: frequent lines, lines said several times, copies, an id twice."""
    r = random.Random(11)
    lines = [f"this is sentence number {i} of all the lines" for i in range(12)]
    texts = [". ".join([r.choice(lines) for _ in range(r.randint(1, 7))]) + "." for _ in range(120)] + [". ".join([lines[0]] * k) + ". short." for k in range(1, 9)]
    rows = list(enumerate(texts + texts[:5] + ["", "no mark"]))
    s = {i: [x.strip(" .") for x in t.split(".") if x.strip()] if "." in t else [] for i, t in rows}
    seen, firsts = set(), []
    for i, _ in rows:
        if s[i] and tuple(s[i]) not in seen:
            seen.add(tuple(s[i]))
            firsts.append(i)
    want = set()
    for n, a in enumerate(firsts):
        for b in firsts[n + 1 :]:
            met = [(i, j) for i, x in enumerate(s[a]) for j, y in enumerate(s[b]) if x == y and len(x) >= 20]
            shared, fewest = len(met), min(len(s[a]), len(s[b]))
            same, cross = sum(i == j for i, j in met), sum((i - j) % 2 for i, j in met)
            if shared >= max(2, (3 * fewest + 4) // 5) and shared - same >= max(2, (shared + 3) // 4):
                want.add((a, b, shared, same, cross, shared - same - cross, fewest))
    got = sim.sentence_overlap(spark.createDataFrame(rows, "id long, text string")).drop("type").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 100
