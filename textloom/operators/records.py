"""Conversation records as JSON lines: structure rules, both validity states, a loader that stops on errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import rules

#: Top-level fields of a record; all must be there and no other.
FIELDS = (*rules.REQUIRED, "turns", "meta")


def _kind(path: str) -> Column:
    return F.expr(f"coalesce(schema_of_variant(variant_get(v, '$.{path}')), 'MISSING')")


def _coded(code: str, names: Column) -> Column:
    """``code:name`` for each name."""
    return F.transform(F.sort_array(names), lambda x: F.concat(F.lit(f"{code}:"), x))


def field_issues(raw: Column, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """Issues of the keys of one JSON object: ``not_object``, ``unknown_field:name`` and ``missing_field:name``."""
    known = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    keys = F.json_object_keys(raw)
    found = F.concat(_coded("unknown_field", F.array_except(keys, known(required + optional))), _coded("missing_field", F.array_except(known(required), keys)))
    return F.when(keys.isNull(), F.array(F.lit("not_object"))).otherwise(found)


def parse_records(lines: DataFrame, mode: str = "dataset", bank: dict[str, list[str]] | None = None, identity: str | None = None) -> DataFrame:
    """``lines`` (source_file, line_no, raw) with the record's columns, errors, warnings and both states.

    Broken JSON has ``invalid_json`` alone; a value that isn't an object, or a
    record that lacks a field, has no other errors than those. Of equal ids the
    first line is remembered, whatever else is wrong with it.
    ``turns_validated`` is true without errors; ``legacy_compatible`` where the
    nine fields of an instruction row pass the rules of such rows.
    """
    names = (bank or {}).get("approved") if bank is not None else None
    base = lines.withColumn("v", F.expr("try_parse_json(raw)")).withColumns({f"__{k}": c for k, c in {"id": F.get_json_object("raw", "$.id")}.items()})
    meta_raw = F.get_json_object("raw", "$.meta")
    text = lambda f: _kind(f) == "STRING"
    blank = lambda f: ~text(f) | T.blank(F.coalesce(F.get_json_object("raw", f"$.{f}"), F.lit("")))
    has = F.json_object_keys(meta_raw)
    typed = [
        ("bad_category", ~F.coalesce(F.get_json_object("raw", "$.category") == "multiturn", F.lit(False))),
        *((f"bad_type:{f}", blank(f)) for f in ("instruction", "output", "quality_notes", "source")),
        ("meta_not_object", has.isNull()),
        ("meta_register_invalid", F.coalesce(F.array_contains(has, "register"), F.lit(False)) & ~F.coalesce(F.get_json_object("raw", "$.meta.register").isin("tegezo", "magazo"), F.lit(False))),
        *((f"meta_flag_invalid:{k}", ~_kind(f"meta.{k}").isin("BOOLEAN", "MISSING")) for k in ("user_typos", "sensitive_area", "fixture")),
        ("turns_not_list", ~_kind("turns").startswith("ARRAY")),
        ("turn_keys", F.coalesce(F.exists(F.from_json(F.get_json_object("raw", "$.turns"), "array<string>"), lambda t: ~F.coalesce(F.sort_array(F.json_object_keys(t)) == F.array(F.lit("role"), F.lit("text")), F.lit(False))), F.lit(False))),
    ]
    meta_keys = F.when(
        has.isNotNull(),
        F.concat(
            _coded("meta_unknown_key", F.array_except(has, F.array(*map(F.lit, rules.META_REQUIRED + rules.META_OPTIONAL)))),
            _coded("meta_missing", F.array_except(F.array(*map(F.lit, rules.META_REQUIRED)), has)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    structure = field_issues(F.col("raw"), FIELDS)
    out = base.withColumn("structure", F.when(F.col("v").isNull(), F.array(F.lit("invalid_json"))).otherwise(structure))
    out = out.withColumn("rec", F.from_json("raw", rules.CONVERSATION)).select(*lines.columns, "v", "__id", "structure", "rec.*")
    has_id = (_kind("id") == "STRING") & F.col("v").isNotNull()
    # records without id are no copies of each other: each is a partition of its own
    order = rules.Window.partitionBy("__id", F.when(~has_id, F.xxhash64("source_file", "line_no"))).orderBy("source_file", "line_no")
    again = F.when(has_id, F.row_number().over(order)) > 1
    stopped = F.exists("structure", lambda x: x.startswith("missing_field") | x.isin("not_object", "invalid_json"))
    legacy = rules.parse_rows(lines.select("source_file", "line_no", F.col("raw"))).select("source_file", "line_no", F.array_except("issues", F.array(F.lit("duplicate_id"))).alias("__legacy"))
    out = out.withColumn("__again", F.coalesce(again, F.lit(False)))
    content = T.flags([*typed, *rules.record_rules(mode, names, identity)])
    errors = F.concat(F.col("structure"), F.when(stopped, F.array().cast("array<string>")).otherwise(F.concat(content, meta_keys)), T.flags([("duplicate_id", F.col("__again"))]))
    out = out.withColumn("errors", errors).withColumn("warnings", F.when(stopped, F.array().cast("array<string>")).otherwise(T.flags(rules.record_warnings())))
    out = out.join(legacy, ["source_file", "line_no"], "left")
    return out.withColumns({"turns_validated": F.size("errors") == 0, "legacy_compatible": F.coalesce(F.size("__legacy") == 0, F.lit(False))}).drop("v", "__id", "__again", "__legacy", "structure")


def unused_names(records: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name): declared names that no message of the record has in any form."""
    from textloom.operators.names import _named

    declared = records.select("id", F.explode("meta.persona_names").alias("name")).distinct()
    said = records.select("id", F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))), "\n").alias("text"))
    used = _named(said, known, "id", "text").where("name IS NOT NULL").select("id", "name").distinct()
    return declared.join(used, ["id", "name"], "left_anti")


def load_conversations(spark: SparkSession, path: str, mode: str = "dataset", bank: dict[str, list[str]] | None = None) -> DataFrame:
    """Validated records of many files; any error stops the run, naming the first ten."""
    from textloom.sources.readers import read_lines

    out = parse_records(read_lines(spark, path).where("NOT blank").select("source_file", "line_no", "raw"), mode, bank)
    bad = out.where("NOT turns_validated").orderBy("source_file", "line_no").select("source_file", "line_no", F.get("errors", F.lit(0)).alias("e")).limit(10).collect()
    if bad:
        raise ValueError("bad records: " + "; ".join(f"{r['source_file']}:{r['line_no']} {r['e']}" for r in bad))
    return out
