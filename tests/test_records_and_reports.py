"""Conversation records, reports, guards, edits and samples with dependencies, on small fixtures."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import documents as D
from textloom.operators import names, records, reports, rules
from textloom.operators import samples as SM
from textloom.operators import similarity as sim
from textloom.sources import readers, writers
from textloom.streaming import state


def record(k=1, **changes):
    turns = []
    for i in range(3):
        turns += [{"role": "user", "text": f"Melyik a legjobb recept erre {i}?"}, {"role": "assistant", "text": f"Szerintem a leves a legjobb recept {i}."}]
    out = {
        "id": f"multiturn_{k:04d}",
        "category": "multiturn",
        "instruction": turns[0]["text"],
        "input": "",
        "output": turns[-1]["text"],
        "tags": ["magyar", "instruction_core", "tobbfordulos", "visszautalas"],
        "difficulty": "easy",
        "quality_notes": "Rendben van.",
        "source": "kézi",
        "turns": turns,
        "meta": {"family": "F2", "skills": ["visszautalas"], "n_exchanges": 3, "split_group": "g0001", "persona": "p001", "persona_names": [], "domain": "fozes", "depends": [{"turn": 3, "on": [1], "depth": 1}]},
    }
    for path, value in changes.items():
        at, *rest = path.split("__")
        if rest:
            out[at] = {**out[at], rest[0]: value}
        else:
            out[at] = value
    return out


CASES = {
    "bad_category": record(category="other"),
    "bad_type:quality_notes": record(quality_notes=5),
    "bad_type:source": record(source=" "),
    "unknown_field:extra": record(extra=1),
    "meta_unknown_key:more": record(meta__more=1),
    "meta_register_invalid": record(meta__register="x"),
    "meta_flag_invalid:user_typos": record(meta__user_typos="yes"),
    "meta_not_object": record(meta=3),
    "turn_keys": record(turns=[{**t, "x": 1} for t in record()["turns"]]),
    "bad_id": record(9999, id="multi_1"),
    "unknown_persona_name": record(meta__persona_names=["Zorka"]),
}


def lines(spark, rows):
    return spark.createDataFrame([("f", i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows, 1)], "source_file string, line_no long, raw string")


def test_one_mutation_for_each_rule(spark):
    missing = record(7)
    del missing["meta"]["persona"]
    gone = record(8)
    del gone["turns"]
    rows = [record(1), *({**r, "id": r["id"] if c == "bad_id" else f"multiturn_{k:04d}"} for k, (c, r) in enumerate(CASES.items(), 100)), missing, gone, record(1), "{broken", "[1]"]
    got = parse = records.parse_records(lines(spark, rows), bank={"approved": ["Anna"]}).orderBy("line_no").collect()
    assert got[0]["errors"] == [] and got[0]["turns_validated"] and got[0]["legacy_compatible"] and got[0]["warnings"] == []
    for r, code in zip(got[1:], CASES, strict=False):
        assert code in r["errors"], (code, r["errors"])
    rest = got[1 + len(CASES) :]
    assert rest[0]["errors"] == ["meta_missing:persona"] or "meta_missing:persona" in rest[0]["errors"]
    assert rest[1]["errors"] == ["missing_field:turns"] and rest[1]["legacy_compatible"]
    assert rest[2]["errors"] == ["duplicate_id"]
    assert rest[3]["errors"] == ["invalid_json"] and rest[4]["errors"] == ["not_object"]
    assert not rest[3]["legacy_compatible"] and parse


def test_loader_stops_on_errors(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text("\n".join(json.dumps(record(k)) for k in (1, 2)) + "\n")
    bad.write_text(json.dumps(record(3, category="x")) + "\n")
    assert records.load_conversations(spark, str(good)).count() == 2
    with pytest.raises(ValueError, match="bad.jsonl:1 bad_category"):
        records.load_conversations(spark, str(tmp_path))


def test_unused_names(spark):
    r = record(1, meta__persona_names=["Anna", "Bence"])
    r["turns"][0]["text"] = "Láttam Annát tegnap."
    parsed = records.parse_records(lines(spark, [r]))
    known = names.forms(spark, {"approved": ["Anna", "Bence"], "blocked_given": [], "surname": [], "allowed": []})
    assert [tuple(x) for x in records.unused_names(parsed, known).collect()] == [("multiturn_0001", "Bence")]


def test_masked_findings_need_names_and_no_decision(spark):
    q = "hogyan lehet egyszerűen megfőzni egy nagyon finom levest {} kedvére este otthon"
    a = "vegyél két répát egy hagymát és főzd lassan sós vízben {} szerint egy órán át"
    long = ["Anna", "Bartholomeusz"]
    rows = [(1, 1, q.format(long[0]), a.format(long[0]), ""), (2, 2, q.format(long[1] * 3), a.format(long[1] * 3), ""), (3, 3, "egészen más kérdés", "egészen más válasz", "")]
    schema = "id long, owner long, question string, answer string, context string"
    plain = spark.createDataFrame(rows, schema)
    masked = spark.createDataFrame([(i, o, q.format("NÉV") if i < 3 else x, a.format("NÉV") if i < 3 else y, c) for i, o, x, y, c in rows], schema)
    named = spark.createDataFrame([(1,), (2,)], "id long")
    decided = sim.sample_findings(plain)
    got = [tuple(r)[:4] for r in sim.masked_findings(plain, masked, named, decided).collect()]
    assert got == [(1, 2, "sample_name_swapped", "review")]
    assert sim.masked_findings(plain, masked, named.limit(0), decided).count() == 0
    done = spark.createDataFrame([(1, 2, "reject")], "a long, b long, status string")
    assert sim.masked_findings(plain, masked, named, done).count() == 0


def test_near_conversations_equal_all_pairs(spark):
    r = random.Random(5)
    words = [f"{x}{y}szó" for x in "abcdef" for y in "ghijkl"]
    base = [[" ".join(r.choices(words, k=8)) for _ in range(4)] for _ in range(6)]
    convs = {}
    for k in range(18):
        convs[k] = [" ".join(w if r.random() > 0.08 * (k // 6) else r.choice(words) for w in t.split()) for t in base[k % 6]]
    rows = [(k, i, "user" if i % 2 == 0 else "assistant", t) for k, m in convs.items() for i, t in enumerate(m)]
    from difflib import SequenceMatcher

    want = {}
    for x in convs:
        for y in convs:
            if x < y:
                met = sum(sum(m.size for m in SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks()) for p, q in zip(convs[x], convs[y], strict=True))
                score = 2 * met / sum(map(len, convs[x] + convs[y]))
                if score >= 0.8:
                    want[x, y] = round(score, 9)
    assert want
    got = sim.near_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(g["a"], g["b"]): round(g["score"], 9) for g in got} == want


def test_read_lines_over_splits(spark, tmp_path):
    r = random.Random(1)
    want = {}
    for name in ("a.jsonl", "b.jsonl"):
        rows = ["".join(r.choices("abc é", k=r.randint(0, 40))) + ("\r" if k % 7 == 0 else "") for k in range(500)]
        (tmp_path / name).write_bytes(("\n".join(rows) + "\n").encode())
        want |= {(name, k): (x.removesuffix("\r"), x.endswith("\r")) for k, x in enumerate(rows, 1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = readers.read_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 8
        assert {(x["source_file"], x["line_no"]): (x["raw"], x["crlf"]) for x in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stores_banks_and_folders(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id": 1}, {"id": ')
    assert readers.read_store(spark, str(tmp_path / "bad.json"), "id long").collect() == []
    (tmp_path / "good.json").write_text('[{"id": 1}, {"id": 2}]')
    assert readers.read_store(spark, str(tmp_path / "good.json"), "id long").count() == 2
    bank = {"approved": ["Anna"], "blocked_given": [], "surname": ["Kovács"], "allowed": []}
    (tmp_path / "bank.json").write_text(json.dumps(bank))
    assert readers.read_names(spark, str(tmp_path / "bank.json")) == bank
    (tmp_path / "short.json").write_text(json.dumps({"approved": ["Anna"]}))
    with pytest.raises(ValueError):
        readers.read_names(spark, str(tmp_path / "short.json"))
    (tmp_path / "clean").mkdir()
    with pytest.raises(ValueError, match="no files"):
        readers.require_clean_folder(str(tmp_path / "clean"), spark)
    (tmp_path / "clean" / "x.jsonl").write_text("{}")
    readers.require_clean_folder(str(tmp_path / "clean"), spark)


def test_export_is_read_back_and_checked(spark, tmp_path):
    rows = lines(spark, [{"id": f"r{k}"} for k in range(5)]).withColumn("id", F.get_json_object("raw", "$.id"))
    writers.write_export(rows, str(tmp_path / "e"))
    good = {"status": "ok", "training_ready": False, "content_verified": False, "rows_exported": 5, "rows_read": 6, "rows_excluded": 1}
    assert sorted(r["id"] for r in readers.read_export(spark, str(tmp_path / "e"), good).collect()) == [f"r{k}" for k in range(5)]
    for change in ({"status": "failed"}, {"rows_read": 9}, {"rows_exported": 4, "rows_read": 5}, {"training_ready": True}):
        with pytest.raises(ValueError):
            readers.read_export(spark, str(tmp_path / "e"), good | change)
    other = rows.withColumn("raw", F.when(F.col("id") == "r3", F.lit('{"id": "r3", "x": 1}')).otherwise(F.col("raw")))
    other.select(F.col("raw").alias("value")).write.mode("overwrite").text(str(tmp_path / "e/rows"))
    with pytest.raises(ValueError, match="differ"):
        readers.read_export(spark, str(tmp_path / "e"), good)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "c", "f", 1, "{}", "Kérdés?", "", "Válasz."), ("b", "c", "f", 2, "{}", "Kér\n\ndés?", "", "Válasz.")], "id string, category string, source_file string, source_line long, raw string, instruction string, input string, output string")
    writers.write_block_export(rows, str(tmp_path / "b"), ["source_line"])
    assert "".join(p.read_text() for p in (tmp_path / "b/blocks").glob("part*")) == "User: Kérdés?\nAI: Válasz.\n\n"
    held = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "b/withheld")).collect()
    assert [(r["id"], r["reasons"]) for r in held] == [("b", "blank_line:instruction,multiline_instruction")]
    writers.write_summary(spark.range(1).select(F.lit("é").alias("x")), str(tmp_path / "s"))
    assert [json.loads(p.read_text()) for p in (tmp_path / "s").glob("part*")] == [{"x": "é"}]
    with pytest.raises(ValueError):
        writers.write_summary(spark.range(2), str(tmp_path / "t"))
    a = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    writers.write_split_outputs(a, a, a, a, a, str(tmp_path / "o"), "id")
    assert {(r["value"], r["split"]) for r in spark.read.text(str(tmp_path / "o/ids")).collect()} == {("1", "train"), ("2", "test")}
    s = spark.createDataFrame([("1#R2#1", 1, "train", "R2", "abc"), ("1#R2#3", 1, "train", "R2", "d")], "sample_id string, conv_id long, split string, mode string, rendered string")
    writers.write_samples(s, a, str(tmp_path / "m"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "m/conversation_index")).first()["samples"] == "2"
    assert spark.read.json(str(tmp_path / "m/samples")).where("split = 'train' AND mode = 'R2'").count() == 2


def test_numbers_states_and_summary(spark):
    f = spark.createDataFrame([(1, 2, "info", "x"), (1, 3, "reject", "y"), (2, 3, "review", "x")], "a long, b long, status string, type string")
    got = {(r["a"], r["b"]): r["finding_id"] for r in reports.number_findings(f, ["type", "a", "b"]).collect()}
    assert got == {(1, 3): "f0001", (2, 3): "f0002", (1, 2): "f0003"}
    r = spark.createDataFrame([(k,) for k in range(1, 6)], "id long")
    assert {x["id"]: x["n_blocking"] for x in reports.record_states(r, f, "id").collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 0}
    g = spark.createDataFrame([(1, "g1"), (2, "g1"), (3, "g1"), (4, "g4"), (5, "g5")], "id long, group_id string")
    s = reports.dedupe_summary(r, f, g, "id").first()
    assert (s["records"], s["blocked_records"], s["groups"], s["largest_group"], s["variant_share"], s["variant_share_over_plan"]) == (5, 3, 3, 3, 0.6, True)
    assert reports.dedupe_summary(r.limit(0), f.limit(0), g.limit(0), "id").first()["variant_share"] == 0.0
    merged = {x["id"]: x["unit"] for x in reports.merge_units(g, spark.createDataFrame([(1, 5)], "a long, b long"), "id").collect()}
    assert merged == {1: "g1", 2: "g1", 3: "g1", 4: "g4", 5: "g1"}


def test_required_splits_conflict_and_pend(spark):
    found = spark.createDataFrame([("r1", 1, "sample_near"), ("r1", 2, "sample_near"), ("r2", 3, "sample_exact"), ("r2", 4, "other"), ("r3", 9, "sample_near")], "row string, record long, type string")
    assigned = spark.createDataFrame([(1, "train", 1), (2, "test", 2), (3, "test", 3), (4, "train", 4)], "id long, split string, unit long")
    got = {r["row"]: tuple(r)[1:] for r in reports.required_splits(reports.export_links(found, assigned, "id", "unit")).collect()}
    assert got == {"r1": (2, None, True, 0), "r2": (2, "test", False, 0), "r3": (1, None, False, 1)}


def test_piecewise_checksum(spark, monkeypatch):
    monkeypatch.setattr(reports, "PIECE_ROWS", 3)
    df = spark.createDataFrame([("g", k) for k in range(8)] + [("h", 1)], "s string, k long").repartition(4)
    got = {r["s"]: r["checksum"] for r in reports.piecewise_checksum(df, "s", "k", F.col("k").cast("string")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {"g": sha("\n".join(map(sha, ["0\n1\n2", "3\n4\n5", "6\n7"]))), "h": sha(sha("1"))}


def test_edits_and_diff(spark):
    rows = [("a b a", "find_replace", "a", "x", 1), ("a b a", "find_replace", "a", "x", None), ("a.b", "find_replace", ".", "$1", None), ("abc", "find_replace", "z", "x", None), ("abc", "append", None, "d", None), ("", "append", None, "d", None), ("x", "replace_all", None, "", None), ("x", "move", None, "", None), ("x", "find_replace", "x", "y", 0)]
    df = spark.createDataFrame(rows, "t string, k string, f string, r string, n int")
    got = [tuple(x["e"]) for x in df.select(D.edited(F.col("t"), F.col("k"), F.col("f"), F.col("r"), F.col("n")).alias("e")).collect()]
    assert got == [("x b a", None, 1), ("x b x", None, 2), ("a$1b", None, 1), (None, "find_not_found", None), ("abc\nd", None, None), ("d", None, None), ("", None, None), (None, "unknown_operation", None), (None, "invalid_operation", None)]
    d = spark.createDataFrame([("a\nb", "a\nc", "f")], "o string, n string, name string").select(D.unified_diff(F.col("o"), F.col("n"), F.col("name")).alias("d")).first()["d"]
    assert d["diff"].splitlines()[-3:] == [" a", "-b", "+c"] and not d["truncated"]


def test_tidy_cases(spark):
    cases = {"szia .  ez jó!!! igen..nem": "Szia. Ez jó! Igen. Nem.", "": "", "  a ,b": "A, b.", "vár...rá": "Vár... Rá.", "egy\nkettő. három": "Egy\nkettő. Három.", "3.14": "3. 14.", "oké?!": "Oké?!", ". a": ". A."}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", D.tidy(F.col("t")).alias("x")).collect()} == cases


def test_style_chain_softens_short_texts(spark):
    df = spark.createDataFrame([("szia szia",), ("",), ("ez egy elég hosszú mondat. ez egy elég hosszú mondat.",)], "t string")
    got = [tuple(r["s"]) for r in df.select(D.styled(F.col("t"), ("Szólj bátran.", "Kérdezz még.")).alias("s")).collect()]
    assert got[0][0] in ("Szia szia. Szólj bátran.", "Szia szia. Kérdezz még.") and got[0][1]
    assert got[1] == ("", False, None, 0) and got[2][0] == "Ez egy elég hosszú mondat."
    kinds = spark.createDataFrame([(".PY",), (".b",), (None,)], "n string").select(D.file_type(F.col("n"))).collect()
    assert [r[0] for r in kinds] == [D.FILE_TYPES[".py"], D.ANY_FILE, D.ANY_FILE]


def test_hard_conversations_and_masks(spark):
    df = spark.createDataFrame([("F4", None), ("F1", [(3, [1], 1)]), ("F1", [(5, [0], 2)]), (None, None)], "f string, d array<struct<turn:int,on:array<int>,depth:int>>")
    assert [r[0] for r in df.select(SM.is_hard(F.col("f"), F.col("d"))).collect()] == [True, False, True, False]
    made = spark.createDataFrame([(10, 4, 9), (10, 0, 10), (1, 0, 1), (5, 5, 5)], "n int, s int, e int")
    n, s, e = F.col("n"), F.col("s"), F.col("e")
    assert all(r[0] for r in made.select(SM.mask_is_right(SM.target_mask(n, s, e), s, e, n)).collect())
    assert not any(r[0] for r in made.where("n = 10").select(SM.mask_is_right(SM.target_mask(n, s + 1, e), s + F.when(s == 0, 3).otherwise(0), e, n)).collect())


def test_streams_keep_the_last(spark, tmp_path):
    spark.createDataFrame([(1, f"m{k}") for k in range(5)] + [(2, "x")], "conv_id long, text string").coalesce(1).write.json(str(tmp_path / "in"))
    got = state.stream_recent(state.read_log(spark, str(tmp_path / "in"), "conv_id long, text string"), "conv_id", "text")
    q = got.writeStream.outputMode("update").format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["conv_id"], tuple(r["recent"])) for r in spark.table("kept").collect()} == {(1, ("m3", "m4")), (2, ("x",))}


def test_stratified_split_has_even_features(spark):
    from textloom.operators import split_plan

    rows = [(k, k // 2 if k < 200 else k, "abcd"[(k // 2) % 4] if k % 5 else "d", "xy"[k % 3 == 0]) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, unit long, lang string, source string")
    plain, even = split_plan.assign(df, "unit"), split_plan.assign(df, "unit", features=["lang", "source"])
    count = lambda d: {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    assert count(plain) == count(even) == {"train": 480, "validation": 60, "test": 60}
    assert even.groupBy("unit").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    loss = lambda d: split_plan.stratification_loss(d, ["lang", "source"]).first()["loss"]
    assert loss(even) < loss(plain) / 2


def test_rules_module_knows_its_fields():
    assert set(rules.REQUIRED) < set(records.FIELDS)
