"""One mutation of a valid row or conversation for each rule code."""

import json

import pytest

from textloom.functions import score as S
from textloom.operators import rules as R

ROW = {
    "id": "r1",
    "category": "qa",
    "instruction": "Miért kék az ég?",
    "input": "",
    "output": "Mert a levegő szórja a kék fényt.",
    "tags": ["magyar"],
    "difficulty": "easy",
    "quality_notes": "",
    "source": "kézi",
}


def changed(**values):
    return json.dumps({**ROW, **values}, ensure_ascii=False)


def without(key):
    return json.dumps({k: v for k, v in ROW.items() if k != key}, ensure_ascii=False)


LINES = [
    (changed(), []),
    (changed(id="r2", category="simple_qa").replace("simple_qa", "simple\\_qa"), ["invalid_escape"]),
    ('{"id": "r3"', ["invalid_json"]),
    ("[1, 2]", ["not_an_object"]),
    (without("source"), ["missing_fields"]),
    (changed(id=" "), ["empty_id"]),
    (changed(id=7), ["empty_id"]),
    (changed(), ["duplicate_id"]),
    (changed(id="c1", category=""), ["empty_category"]),
    (changed(id="c2", instruction=" "), ["empty_instruction"]),
    (changed(id="c3", output=""), ["empty_output"]),
    (changed(id="c4", source=None), ["empty_source"]),
    (changed(id="c5", tags="magyar"), ["tags_not_list"]),
    (changed(id="c6", difficulty="extreme"), ["invalid_difficulty"]),
    (changed(id="c7", output="Igen, persze."), ["output_too_short"]),
    (changed(id="c8", output="egy szó itt " * 130), ["output_too_long"]),
    (changed(id="c9", output="Ez nagyooooon jó volt."), ["repeated_char_run"]),
    (changed(id="d1", output="Ez egy xkcdfgh szó itt."), ["garbled_output"]),
    (changed(id="d2", output="Ez the legjobb válasz erre."), ["english_mixing"]),
    (changed(id="d3", output="Én mindent tudok erről a dologról."), ["overclaiming"]),
    (changed(id="d4", instruction="Írj neki: valaki@pelda.hu"), ["personal_data_suspected"]),
    (changed(id="d5", output="Itt van: password = titok123 neked."), ["dangerous_content_suspected"]),
]


def test_rows(spark):
    lines = spark.createDataFrame([("a.jsonl", k + 1, raw) for k, (raw, _) in enumerate(LINES)], "source_file string, line_no long, raw string").repartition(3)
    got = {r["line_no"]: r["issues"] for r in R.parse_rows(lines).collect()}
    for k, (raw, want) in enumerate(LINES):
        assert got[k + 1] == want, raw


def test_reject_report(spark):
    lines = spark.createDataFrame([("a", 1, changed(tags="x", output="Ez the jó válasz erre."))], "source_file string, line_no long, raw string")
    got = [tuple(r) for r in R.reject_report(R.parse_rows(lines), "line_no").collect()]
    assert got == [(1, "tags_not_list", True, False), (1, "english_mixing", True, False)]


def record(**meta):
    turns = [{"role": r, "text": f"{t} szöveg van itt."} for t, r in zip("ABCDEF", ["user", "assistant"] * 3, strict=True)]
    base = {"family": "F3", "skills": ["pontositas"], "n_exchanges": 3, "split_group": "g0001", "persona": "p001", "persona_names": [], "domain": "munka", "depends": [{"turn": 3, "on": [1], "depth": 1}], "fixture": False}
    return {
        "line_no": 1, "id": "multiturn_0001", "category": "x", "instruction": turns[0]["text"], "input": "", "output": turns[-1]["text"], "tags": ["magyar", "instruction_core", "tobbfordulos", "pontositas"],
        "difficulty": "easy", "quality_notes": "", "source": "s", "turns": turns, "meta": {**base, **meta},
    }


MUTATIONS = [
    ({}, {}, []),
    ({"id": "x"}, {}, ["bad_id"]),
    ({"input": "y"}, {}, ["derived_input_nonempty"]),
    ({"difficulty": None}, {}, ["bad_difficulty"]),
    ({"instruction": "más"}, {}, ["derived_instruction_mismatch"]),
    ({"output": "más"}, {}, ["derived_output_mismatch"]),
    ({"tags": ["magyar"]}, {}, ["bad_tags"]),
    ({}, {"family": "F99"}, ["bad_family", "family_not_in_skills", "bad_tags"]),
    ({}, {"skills": ["pontositas", "pontositas"]}, ["bad_skills"]),
    ({}, {"split_group": "h1"}, ["bad_split_group"]),
    ({}, {"persona": "p1"}, ["bad_persona"]),
    ({}, {"domain": "ur"}, ["bad_domain"]),
    ({}, {"fixture": True}, ["fixture_mode_mismatch"]),
    ({}, {"n_exchanges": 4}, ["n_exchanges_mismatch"]),
    ({}, {"depends": [{"turn": 2, "on": [1], "depth": 1}]}, ["bad_depends"]),
    ({}, {"depends": [{"turn": 3, "on": [1], "depth": 2}]}, ["bad_depends"]),
    ({}, {"persona_names": ["Nincs"]}, ["unknown_persona_name"]),
]


@pytest.mark.parametrize("top, meta, want", MUTATIONS)
def test_records(spark, top, meta, want):
    df = spark.createDataFrame([{**record(**meta), **top}], "line_no long, " + R.CONVERSATION)
    got = R.validate_records(df, names=["Anna"]).first()
    assert got["errors"] == want and got["turns_validated"] == (not want) and got["warnings"] == []


def test_row_scores(spark):
    cases = [("Ez egy teljes mondat.", 100), ("", 0), (None, 0), ("Jó.", 75), ("Erről nem tudok többet mondani", 80), ("A xkcdfgh nagyooooo", 30)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "o string").withColumn("f", S.row_flags(S.F.col("o")))
    got = {r["o"]: r["s"] for r in df.select("o", S.row_score(S.F.col("f")).alias("s")).collect()}
    assert got == dict(cases)
