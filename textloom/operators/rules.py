"""Validation rules of instruction rows and conversations, as issue arrays.

Each rule is one condition of a narrow projection; a row or record is valid if
it has no (error) issue. Tables of issues come from exploding the arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import score as S
from textloom.functions import text as T

REQUIRED = ("id", "category", "instruction", "input", "output", "tags", "difficulty", "quality_notes", "source")
DIFFICULTIES = ("easy", "medium", "hard")
AUTO_FIXABLE = ("invalid_escape", "tags_not_list", "english_mixing")

# Limits, vocabularies and forms of conversation records.
USER_MAX, ASSISTANT_MAX = 300, 600
MIN_EXCHANGES, MAX_EXCHANGES = 3, 8
FAMILIES = {
    "F1": "elozmeny_koveteles",
    "F2": "visszautalas",
    "F3": "pontositas",
    "F4": "felhasznaloi_javitas",
    "F5": "valtozo_keres",
    "F6": "temavaltas",
    "F7": "temavaltas_visszateres",
    "F8": "tobblepeses_feladat",
    "F9": "bizonytalansag_tobbfordulo",
}
DOMAINS = "vasarlas utazas fozes tanulas munka otthon egeszseg_sport technologia szabadido ugyintezes".split()
META_REQUIRED = ("family", "skills", "n_exchanges", "split_group", "persona", "persona_names", "domain", "depends")
META_OPTIONAL = ("register", "user_typos", "sensitive_area", "fixture")
TAG_PREFIX = ("magyar", "instruction_core", "tobbfordulos")
EXPECT_DEPENDS = ("F1", "F2", "F4", "F5", "F7", "F8")
ID_FORMS = {"dataset": r"^multiturn_[0-9]{4}$", "fixture": r"^mtfx_[a-z0-9_]+$"}
LABEL = r"(?i)(?:^|[^a-z0-9])(user|ai)\s*:"
URL = r"(?i)(https?://|www\.|(^|[^\p{L}\p{N}_])[a-z0-9-]+\.(hu|com|org|net|eu|io|info)($|[^\p{L}\p{N}_]))"
LONG_DIGITS = r"\p{Nd}{8,}"
CONTROL = r"[\p{Cc}  ]"


def invalid_escapes(raw: Column) -> Column:
    """Escapes of a raw JSON line that JSON doesn't know, read in pairs from the left."""
    return F.filter(F.regexp_extract_all(raw, F.lit(r"\\(.)"), F.lit(1)), lambda x: ~x.isin(*'"\\/bfnrtu'))



def parse_rows(lines: DataFrame) -> DataFrame:
    """``raw`` lines with issue codes and the parsed row.

    ``lines`` has source_file, line_no and raw. A bad escape, broken JSON, a
    value that isn't an object, or missing fields each stop further checks.
    """
    schema = ", ".join(f"{f} string" for f in REQUIRED)
    kind = lambda f: F.expr(f"coalesce(schema_of_variant(variant_get(v, '$.{f}')), '')")
    out = lines.withColumn("v", F.expr("try_parse_json(raw)")).withColumn("row", F.from_json("raw", schema))
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    head = (
        F.when(F.size(invalid_escapes(F.col("raw"))) > 0, "invalid_escape")
        .when(F.col("v").isNull(), "invalid_json")
        .when(~F.expr("schema_of_variant(v)").startswith("OBJECT"), "not_an_object")
        .when(F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)) > 0, "missing_fields")
    )
    out = out.withColumn("stop", head)
    text = lambda f: F.when(kind(f) == "STRING", F.col(f"row.{f}"))
    for f in ("id", "category", "instruction", "input", "output", "source", "difficulty"):
        out = out.withColumn(f, F.when(F.col("stop").isNull(), text(f)))
    has_id = F.col("id").isNotNull() & ~T.blank("id")
    # rows without id are no copies of each other: each is a partition of its own
    order = Window.partitionBy("id", F.when(~has_id, F.xxhash64("source_file", "line_no"))).orderBy("source_file", "line_no")
    missing = lambda f: F.col(f).isNull() | T.blank(F.col(f))
    rules = [
        *((f"empty_{f}", missing(f)) for f in ("category", "instruction", "output", "source")),
        ("tags_not_list", ~kind("tags").startswith("ARRAY")),
        ("invalid_difficulty", ~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False))),
        *content_rules(F.col("output"), [F.col(f) for f in ("instruction", "input", "output")]),
    ]
    # rules of single rows come before rows of one id meet, so that no parsed text is shuffled for them
    out = out.withColumn("__rest", F.when(F.col("stop").isNull(), T.flags(rules))).drop("v", "row")
    out = out.withColumn("__again", has_id & (F.row_number().over(order) > 1))
    issues = F.when(F.col("stop").isNotNull(), F.array("stop")).otherwise(F.concat(T.flags([("empty_id", ~has_id), ("duplicate_id", F.col("__again"))]), "__rest"))
    return out.withColumn("issues", issues).drop("stop", "__again", "__rest")


def content_rules(output: Column, scanned: list[Column], known: dict[str, Column] | None = None) -> list[tuple[str, Column]]:
    """Rules over an answer, and over all fields that are scanned for data that must not be there.

    ``known`` are the answer's measures where they are columns already.
    """
    m = known or S.measures(output)
    has = m["answer"] != ""
    held = lambda patterns: F.coalesce(*[S.first_label(F.coalesce(c, F.lit("")), patterns) for c in scanned]).isNotNull()
    return [
        ("output_too_short", has & (m["n_words"] < S.MIN_WORDS)),
        ("output_too_long", has & m["too_long"]),
        ("repeated_char_run", has & m["repeated"]),
        ("garbled_output", has & m["garbled"]),
        ("english_mixing", has & m["english"]),
        ("overclaiming", has & m["overclaims"]),
        ("personal_data_suspected", held(S.PERSONAL_PATTERNS)),
        ("dangerous_content_suspected", held(S.DANGER_PATTERNS)),
    ]


def text_issues(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``issues``: the content rules over one text column."""
    text = F.col(text_col)
    measured = df.withColumns({f"__{name}": c for name, c in S.measures(text).items()})
    known = {name: F.col(f"__{name}") for name in S.MEASURES}
    return measured.withColumn("issues", T.flags(content_rules(text, [text], known))).select(*df.columns, "issues")


def text_issues_and_flags(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, with issues and the scorer's flags of one text column; what both ask is evaluated once."""
    text = F.col(text_col)
    measured = df.select(*keep, text.alias("__text"), *[c.alias(f"__{name}") for name, c in S.measures(text).items()])
    known = {name: F.col(f"__{name}") for name in S.MEASURES}
    scanned = F.col("__text")
    return measured.select(*keep, T.flags(content_rules(scanned, [scanned], known)).alias("issues"), S.row_flags(scanned, known=known).alias("flags"))


def reject_report(df: DataFrame, id_col: str) -> DataFrame:
    """One row for each issue: id, reason_code, auto_fixable, needs_manual_review."""
    fixable = F.col("reason_code").isin(*AUTO_FIXABLE)
    # the outer form: the inner one would evaluate all rules once more, to leave out empty arrays beforehand
    each = df.select(F.col(id_col), F.explode_outer("issues").alias("reason_code")).where("reason_code IS NOT NULL")
    return each.select(id_col, "reason_code", fixable.alias("auto_fixable"), (~fixable).alias("needs_manual_review"))


def turn_rules(role: Column, text: Column, place: Column) -> list[tuple[str, Column]]:
    """Rules of one message at its place (from 0) in the conversation."""
    x = F.coalesce(text, F.lit(""))
    expected = F.when(place % 2 == 0, "user").otherwise("assistant")
    return [
        ("bad_role", ~F.coalesce(role.isin("user", "assistant"), F.lit(False))),
        ("bad_alternation", ~role.eqNullSafe(expected)),
        ("empty_text", T.blank(x)),
        ("untrimmed_text", T.strip(x) != x),
        ("newline_in_text", x.contains("\n")),
        ("control_character", F.regexp_replace(x, "\n", "").rlike(CONTROL)),
        ("user_too_long", (role == "user") & (F.length(x) > USER_MAX)),
        ("assistant_too_long", (role == "assistant") & (F.length(x) > ASSISTANT_MAX)),
        ("role_label", x.rlike(LABEL)),
        ("url", x.rlike(URL)),
        ("long_digits", x.rlike(LONG_DIGITS)),
        ("assistant_too_short", (role == "assistant") & (F.size(T.words(x)) < S.MIN_WORDS)),
        ("repeated_char_run", S.repeated_run(x)),
        ("garbled_output", S.garbled(x)),
        ("english_mixing", S.english(x)),
        ("overclaiming", S.overclaims(x)),
        ("personal_data_suspected", S.first_label(x, S.PERSONAL_PATTERNS).isNotNull()),
        ("dangerous_content_suspected", S.first_label(x, S.DANGER_PATTERNS).isNotNull()),
    ]


def message_issues(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, code) of all issues of exploded messages."""
    issues = T.flags(turn_rules(F.col("role"), F.col("text"), F.col("turn")))
    return messages.select("conv_id", "turn", F.explode(issues).alias("code"))


def conversation_issues(messages: DataFrame) -> DataFrame:
    """(conv_id, code) of issues of whole conversations."""
    shape = messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("role", "turn").alias("first"), F.max_by("role", "turn").alias("last"), F.min("turn").alias("low"), F.max("turn").alias("high")
    )
    n = F.col("n")
    rules = [
        ("first_not_user", ~F.col("first").eqNullSafe("user")),
        ("last_not_assistant", ~F.col("last").eqNullSafe("assistant")),
        ("odd_message_count", n % 2 != 0),
        ("bad_exchange_count", (F.floor(n / 2) < MIN_EXCHANGES) | (F.floor(n / 2) > MAX_EXCHANGES)),
        ("turn_gap", F.col("high") - F.col("low") + 1 != n),
    ]
    return shape.select("conv_id", F.explode(T.flags(rules)).alias("code"))


def validate_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turns_validated): conversations without any issue are validated."""
    bad = message_issues(messages).select("conv_id").union(conversation_issues(messages).select("conv_id")).distinct().withColumn("bad", F.lit(True))
    every = messages.select("conv_id").distinct()
    return every.join(bad, "conv_id", "left").select("conv_id", F.col("bad").isNull().alias("turns_validated"))


def record_rules(mode: str = "dataset", names: list[str] | None = None, identity: str | None = None) -> list[tuple[str, Column]]:
    """Rules over nested conversation records with columns as in ``CONVERSATION``.

    ``names`` is the approved name bank, ``identity`` a pattern of names that
    must not be mentioned; both are configuration.
    """
    m = lambda f: F.col(f"meta.{f}")
    turns, n = F.col("turns"), F.size("turns")
    slug = F.coalesce(*[F.when(m("family") == k, F.lit(v)) for k, v in FAMILIES.items()])
    depends = F.coalesce(m("depends"), F.array().cast("array<struct<turn:int,on:array<int>,depth:int>>"))
    bad_edge = F.exists(
        depends,
        lambda d: (d["turn"] % 2 != 1)
        | (d["turn"] >= n)
        | (F.size(d["on"]) == 0)
        | (F.size(F.array_distinct(d["on"])) != F.size(d["on"]))
        | F.exists(d["on"], lambda o: (o >= d["turn"]) | (o < 0))
        | (d["depth"] < 1)
        | (d["depth"] != F.floor(d["turn"] / 2) - F.floor(F.array_min(d["on"]) / 2)),
    )
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = [
        ("bad_id", no(F.col("id").rlike(ID_FORMS[mode]))),
        ("derived_input_nonempty", F.col("input") != ""),
        ("bad_difficulty", no(F.col("difficulty").isin(*DIFFICULTIES))),
        ("bad_family", no(m("family").isin(*FAMILIES))),
        ("bad_skills", no((F.size(m("skills")) > 0) & (F.size(F.array_distinct(m("skills"))) == F.size(m("skills"))) & (F.size(F.array_except(m("skills"), F.array(*map(F.lit, FAMILIES.values())))) == 0))),
        ("family_not_in_skills", no(F.array_contains(m("skills"), slug))),
        ("bad_split_group", no(m("split_group").rlike(r"^g[0-9]{4}$"))),
        ("bad_persona", no(m("persona").rlike(r"^p[0-9]{3}$"))),
        ("bad_domain", no(m("domain").isin(*DOMAINS))),
        ("fixture_mode_mismatch", F.coalesce(m("fixture"), F.lit(False)) != F.lit(mode == "fixture")),
        ("bad_tags", no(F.forall("tags", lambda x: x.rlike("^[a-z0-9_]+$")) & (F.slice("tags", 1, 3) == F.array(*map(F.lit, TAG_PREFIX))) & (F.get("tags", F.lit(3)) == slug))),
        ("bad_roles", F.exists(F.transform(turns, lambda x, i: F.struct(x["role"].alias("r"), i.alias("i"))), lambda x: ~x["r"].eqNullSafe(F.when(x["i"] % 2 == 0, "user").otherwise("assistant")))),
        ("bad_text", F.exists(turns, lambda x: T.blank(F.coalesce(x["text"], F.lit(""))) | (T.strip(x["text"]) != x["text"]) | x["text"].rlike(CONTROL))),
        ("text_too_long", F.exists(turns, lambda x: F.length(x["text"]) > F.when(x["role"] == "user", USER_MAX).otherwise(ASSISTANT_MAX))),
        ("bad_exchange_count", (n % 2 != 0) | (F.floor(n / 2) < MIN_EXCHANGES) | (F.floor(n / 2) > MAX_EXCHANGES)),
        ("n_exchanges_mismatch", no(m("n_exchanges") * 2 == n)),
        ("derived_instruction_mismatch", no(F.col("instruction") == F.get(turns, F.lit(0))["text"])),
        ("derived_output_mismatch", no(F.col("output") == F.get(turns, n - 1)["text"])),
        ("bad_depends", F.coalesce(bad_edge, F.lit(True)) | (F.size(F.array_distinct(F.transform(depends, lambda d: d["turn"]))) != F.size(depends))),
    ]
    if names is not None:
        rules.append(("unknown_persona_name", F.size(F.array_except(m("persona_names"), F.array(*map(F.lit, names)))) > 0))
    if identity is not None:
        rules.append(("identity_mention", F.exists(turns, lambda x: x["text"].rlike(identity))))
    return rules


def record_warnings() -> list[tuple[str, Column]]:
    answers = F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"])
    depends = F.col("meta.depends")
    return [
        ("duplicate_assistant_message", F.size(F.array_distinct(answers)) != F.size(answers)),
        ("family_expects_depends", F.col("meta.family").isin(*EXPECT_DEPENDS) & (F.coalesce(F.size(depends), F.lit(0)) == 0)),
        ("f7_needs_depth", (F.col("meta.family") == "F7") & ~F.coalesce(F.exists(depends, lambda d: d["depth"] >= 2), F.lit(False))),
    ]


def validate_records(records: DataFrame, mode: str = "dataset", names: list[str] | None = None, identity: str | None = None) -> DataFrame:
    """``records`` with errors, warnings and turns_validated; of equal ids the first line is remembered."""
    again = F.row_number().over(Window.partitionBy("id").orderBy("line_no")) > 1
    out = records.withColumn("__again", again)
    out = out.withColumn("errors", T.flags([("duplicate_id", F.col("__again")), *record_rules(mode, names, identity)]))
    return out.withColumn("warnings", T.flags(record_warnings())).withColumn("turns_validated", F.size("errors") == 0).drop("__again")


CONVERSATION = (
    "id string, category string, instruction string, input string, output string, tags array<string>, difficulty string, quality_notes string, source string, "
    "turns array<struct<role:string,text:string>>, meta struct<family:string,skills:array<string>,n_exchanges:int,split_group:string,persona:string,persona_names:array<string>,"
    "domain:string,depends:array<struct<turn:int,on:array<int>,depth:int>>,register:string,user_typos:boolean,sensitive_area:boolean,fixture:boolean>"
)
