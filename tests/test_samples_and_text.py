"""Renderings, encodings, text functions, classifiers and page analyses."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import classify as C
from textloom.functions import documents as D
from textloom.functions import text as T
from textloom.operators import samples as SM

CHAT = [(1, 0, "user", "Szia"), (1, 1, "assistant", "Helló!"), (1, 2, "user", "Mi az?"), (1, 3, "assistant", "x" * 200), (1, 4, "user", "És?"), (1, 5, "assistant", "Vége.")]


@pytest.fixture(scope="module")
def chat(spark):
    return spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_samples(chat):
    got = sorted(tuple(r) for r in SM.samples(chat).collect())
    assert got == [(1, 1, "Szia", "Helló!", ""), (1, 3, "Mi az?", "x" * 200, "User: Szia\nAI: Helló!"), (1, 5, "És?", "Vége.", "User: Mi az?\nAI: " + "x" * 200)]


def test_renderings(chat):
    for r in SM.full_history(chat).collect():
        assert r["rendered"][r["target_start"] : r["target_end"]] == CHAT[r["turn"]][3]
    last = {r["turn"]: r for r in SM.last_exchange(chat).collect()}
    assert last[1]["rendered"] == "User: Szia\nAI: Helló!" and not last[1]["has_context"]
    assert last[5]["rendered"] == "User: Mi az?\nAI: " + "x" * 117 + "...\n\nUser: És?\nAI: Vége."
    assert last[5]["lost_chars"] == 80 and not last[5]["lossless"]


BLOCKS = [("i", "", "o", []), ("i", "n", "o\nAI: p", ["role_label_at_line_start:output"]), ("", "", "o", ["empty_instruction"]), ("a\nb", "", "o", ["multiline_instruction"]), ("i", " ", "o", ["whitespace_only_input"]), ("i", "a\n\nb", "o", ["blank_line:input"]), ("i", "", "o\r", ["carriage_return:output"]), ("i", "", "o\n", ["edge_newline:output"]), (None, "", "o", ["field_not_string:instruction"])]


def test_blocks(spark):
    df = spark.createDataFrame([b[:3] for b in BLOCKS], "i string, n string, o string")
    c = [F.col(x) for x in "ino"]
    for r, want in zip(df.select(*c, SM.block_reasons(*c).alias("w")).collect(), BLOCKS, strict=True):
        assert r["w"] == want[3]
    back = df.limit(1).unionByName(spark.createDataFrame([("a", "b\nc", "d\ne")], "i string, n string, o string")).select(*c, SM.parse_block(SM.render_block(*c)).alias("p")).collect()
    assert all((r["i"], r["n"], r["o"]) == tuple(r["p"]) for r in back)


def test_encoding(spark):
    df = spark.createDataFrame([("abca",), ("zab",)], "t string")
    vocabulary = SM.char_vocabulary(df.limit(1), "t")
    assert sorted(map(tuple, vocabulary.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    m = F.create_map(*[F.lit(x) for x in ("a", 0, "b", 1, "c", 2)])
    assert [r[0] for r in df.select(SM.encode(F.col("t"), m, 9)).collect()] == [[0, 1, 2, 0], [9, 0, 1]]
    assert spark.range(1).select(SM.target_mask(F.lit(5), F.lit(2), F.lit(4))).first()[0] == [0, 1, 1, 0]


def test_percentiles_and_batches(spark):
    df = spark.createDataFrame([(k, k * k % 37) for k in range(50)], "id long, n long")
    v = sorted(k * k % 37 for k in range(50))
    r = SM.floor_rank_percentiles(df, "n").first()
    assert (r["n"], r["min"], r["max"], r["p90"], r["p99"], r["median"]) == (50, v[0], v[-1], v[int(0.9 * 49)], v[int(0.99 * 49)], (v[24] + v[25]) / 2)
    b = sorted(map(tuple, SM.batches(df, ["id"], "n", 16).collect()))
    groups = [[k * k % 37 for k in range(s, min(s + 16, 50))] for s in range(0, 50, 16)]
    assert b == [(k, len(g), max(g), max(g) * len(g) - sum(g)) for k, g in enumerate(groups)]


@pytest.mark.parametrize("text, want", [("/help", "command"), ("Írj 5 mondatot az őszről", "sentence_request"), ("mondj három mondatot", "sentence_request"), ("Szia!", "greeting"), ("Szia, ki vagy?", "general_chat"), ("Viszlát", "goodbye"), ("", "general_chat"), (None, "general_chat")])
def test_intent(spark, text, want):
    assert one(spark, text, C.intent) == want


@pytest.mark.parametrize("text, want", [("Írj 5 mondatot", 5), ("írj tizenkét mondatot", None), ("4 mondatban", 4), ("99 mondat", 10), ("0 mondat", 1), ("123456 mondat", 10), ("két mondat", 2), ("semmi", None)])
def test_requested_sentences(spark, text, want):
    assert one(spark, text, C.requested_sentences) == want


def test_other_classifiers(spark):
    assert one(spark, "Folytasd kérlek", C.follow_up) == "explicit_backreference"
    assert one(spark, "És az?", C.follow_up) == "short_deictic_followup"
    assert one(spark, "Magyarázd el, hogyan működik a motor", C.response_type) == "explanation"
    assert one(spark, "Mi a neved", C.response_type) == "short_answer"
    assert one(spark, "Hány éves vagy?", C.guard_category) == "age"
    assert one(spark, "A nevem Éva", C.memory_candidate) == "user_fact"
    assert one(spark, "Jegyezd meg, hogy szeretem a teát!", C.explicit_save) == "szeretem a teát"
    assert one(spark, "Keress rá a Balaton vizére.", C.search_query) == "a Balaton vizére"


def test_text_functions(spark):
    assert one(spark, " Árvíztűrő  ÖRÖM ", T.fold) == "arvizturo orom"
    assert one(spark, "1. Alma, „körte” – és…", T.normalise) == "alma körte és"
    assert one(spark, "Egy. Kettő! farok", T.sentences) == ["Egy.", "Kettő!"]
    assert one(spark, "abcdefghij", lambda c: T.trim_to(c, 6)) == "abc..."


def test_rewriters(spark):
    assert one(spark, "szia .  ez jó!!! igen..nem", D.tidy) == "Szia. Ez jó! Igen. Nem."
    assert one(spark, "Alma. alma. Körte.", D.drop_repeated_sentences) == "Alma. Körte."
    assert tuple(one(spark, "nm tudom, hgy mi az", D.correct_typos)) == ("nem tudom, hogy mi az", 0.9, 2)
    assert tuple(one(spark, "f(nm)", D.correct_typos)) == ("f(nm)", 1.0, 0)
    s = F.array(F.lit("a"), F.lit("b"))
    assert spark.range(1).select(D.exactly(s, F.lit(5), F.lit("x"))).first()[0] == ["a", "b", "a", "b", "a"]


def test_documents(spark):
    page = "<title>A  <b>B</b></title><h1>X</h1><script>no</script><nav>no</nav><p>yes &amp; so<form >"
    assert one(spark, page, D.page_title) == "A B"
    assert one(spark, page, D.page_headings) == ["X"]
    assert one(spark, page, D.page_features) == ["script", "form", "nav"]
    assert one(spark, page, D.page_text) == "A B X yes & so"
    assert one(spark, "lásd https://a.hu/x, és https://a.hu/x).", D.urls) == ["https://a.hu/x"]
    assert one(spark, "https://u@h.org:80/p?q", D.domain) == "h.org:80"
    assert one(spark, '{"a": 1, "b": [2]}', D.analyse_json).asDict() == {"valid": True, "kind": "object", "keys": ["a", "b"], "count": 2}
    assert one(spark, "{", D.analyse_json)["valid"] is False
    assert one(spark, "import os\nclass A:\n  def f(self):", D.analyse_python)["functions"] == ["f"]
    assert one(spark, ".a{color: red} @media x{}", D.analyse_css)["has_media"]
    assert one(spark, "# T\n## U", D.analyse_markdown)["headings"] == ["T", "U"]
    assert one(spark, "function f(){} const g = (x) => 1; fetch('u')", D.analyse_js)["functions"] == ["f", "g"]


def test_composition(spark):
    import unicodedata

    odd = ["Cafe\u0301 u\u0308t", "\u212b \u2126 \u1112\u1161\u11ab \uac00", "q\u0307\u0323", "\u2000a", "plain", "árvíz – „x”…", "", None, "a" * 70000 + "e\u0301", "😀\u0915\u093c"]
    df = spark.createDataFrame(list(enumerate(odd)), "k long, t string")
    got = {r["k"]: r["c"] for r in df.select("k", T.composed(F.col("t")).alias("c")).collect()}
    assert got == {k: None if t is None else unicodedata.normalize("NFC", t) for k, t in enumerate(odd)}
    same = spark.createDataFrame([("1. Cafe\u0301!", "Café")], "a string, b string")
    assert same.where(T.normalise(F.col("a")) == T.normalise(F.col("b"))).count() == 1


def test_masks_of_runs(spark):
    """Masks from runs are those place by place, whatever the limits; long ones are made and checked in no time."""
    import time


    cases = [(n, a, b) for n in range(6) for a in range(-1, 7) for b in range(-1, 8)]
    df = spark.createDataFrame(cases, "n int, a int, b int").withColumn("m", SM.target_mask(F.col("n"), F.col("a"), F.col("b")))
    for r in df.withColumn("s", SM.mask_sum(F.col("m"))).collect():
        assert r["m"] == [int(r["a"] <= i + 1 < r["b"]) for i in range(r["n"] - 1)] and r["s"] == sum(r["m"])
    assert spark.range(1).select(SM.mask_sum(F.array(F.lit(3), F.lit(-1), F.lit(1)))).first()[0] == 3
    n = F.lit(2000) + F.col("id").cast("int") % 2
    mask = SM.target_mask(n, n - 900, n)
    start = time.time()
    assert spark.range(4000).select(SM.mask_is_right(mask, n - 900, n, n).alias("r")).where("r").count() == 4000
    assert time.time() - start < 60
