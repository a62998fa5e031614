"""Files in and out, publication, and streams that equal their batch."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import joins
from textloom.sources import readers, stores, writers
from textloom.streaming import state


def test_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_bytes(b'{"id":"x"}\r\n\n{"id":"y"}\n')
    (tmp_path / "a.jsonl").write_bytes(b'{"id":"z"}')
    got = sorted(tuple(r) for r in readers.number_lines(readers.read_lines(spark, str(tmp_path))).select("row_number", "source_file", "line_no", "raw", "crlf", "blank").collect())
    assert got == [(1, "a.jsonl", 1, '{"id":"z"}', False, False), (2, "b.jsonl", 1, '{"id":"x"}', True, False), (3, "b.jsonl", 2, "", False, True), (4, "b.jsonl", 3, '{"id":"y"}', False, False)]
    assert sorted(r["id"] for r in readers.read_strict(spark, str(tmp_path)).collect()) == ["x", "y", "z"]
    (tmp_path / "c.jsonl").write_text("[]\n")
    with pytest.raises(Exception, match="bad line"):
        readers.read_strict(spark, str(tmp_path)).collect()


def test_exclusion_list(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("﻿# comment\na1 | copy | me\n\nb2 | wrong | you | too\n", "utf-8")
    assert sorted(tuple(r) for r in readers.read_exclusions(spark, str(good)).collect()) == [("a1", "copy", "me"), ("b2", "wrong", "you | too")]
    for text in ("a | r | v\na | r | v\n", "a b | r | v\n", "a | | v\n", "# none\n"):
        bad.write_text(text)
        with pytest.raises(ValueError):
            readers.read_exclusions(spark, str(bad))


def test_stores_blocks_uploads(spark, tmp_path):
    assert readers.read_store(spark, str(tmp_path / "none.json"), "id long").collect() == []
    (tmp_path / "s.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert readers.read_store(spark, str(tmp_path / "s.json"), "id long").count() == 2
    (tmp_path / "t.txt").write_text("a\nb\n\n \n\nc")
    assert [r[0] for r in readers.read_blocks(spark, str(tmp_path / "t.txt")).collect()] == ["a\nb", "c"]
    files = spark.createDataFrame([("a.txt", b"x"), ("a.exe", b"x"), ("a.txt", b"x\0"), ("a.md", b"\xff"), ("b.txt", b"x" * 200_001)], "name string, content binary")
    assert [r["error_code"] for r in readers.check_uploads(files).collect()] == [None, "unsupported_type", "binary_not_supported", "binary_not_supported", "file_too_large"]
    odd = [("..\\\\x/.a\t.txt", b"x", "a.txt", None), ("my secret.txt", b"x", "my secret.txt", "blocked_filename"), ("a.txt", b"", "a.txt", "empty_file"), (None, b"x", "feltoltott_fajl", "unsupported_type"), (".env", b"x", "env", "unsupported_type")]
    files = spark.createDataFrame([(n, c) for n, c, _, _ in odd], "name string, content binary")
    assert [(r["display_name"], r["error_code"]) for r in readers.check_uploads(files).collect()] == [(d, e) for _, _, d, e in odd]
    readers.require_clean_folder("/x/clean/")
    with pytest.raises(ValueError):
        readers.require_clean_folder("/x/raw")


def test_publication(spark, tmp_path):
    df = spark.range(10).withColumn("t", F.lit("é"))
    manifest = writers.publish(spark, df, str(tmp_path), "run1")
    assert manifest["rows"] == 10 and json.loads((tmp_path / "run1/manifest.json").read_text())["rows"] == 10
    with pytest.raises(FileExistsError):
        writers.publish(spark, df, str(tmp_path), "run1")
    with pytest.raises(ValueError):
        writers.publish(spark, df, str(tmp_path), "../x")
    with pytest.raises(Exception):
        writers.publish(spark, df.withColumn("bad", F.raise_error(F.lit("stop")).cast("string")), str(tmp_path), "run2")
    assert (tmp_path / "run2.partial/FAILED.txt").exists() and not (tmp_path / "run2").exists()


def test_export_and_store(spark, tmp_path):
    rows = spark.createDataFrame([("i2", "f", 2, "zwei"), ("i1", "f", 1, "é")], "id string, source_file string, line_no long, raw string")
    writers.write_export(rows, str(tmp_path / "e"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "e/rows")).collect()] == ["é", "zwei"]
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "e/index")).count() == 2
    writers.write_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    target = writers.replace_store(spark, rows, str(tmp_path / "s"), 1)
    assert (tmp_path / "s/CURRENT").read_text() == target
    assert writers.append_log(rows, str(tmp_path / "log")) and writers.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_publication_of_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "`a.b` long, c string")
    assert writers.publish(spark, empty, str(tmp_path), "none")["rows"] == 0
    odd = spark.createDataFrame([(1, None), (1, None), (None, "x")], "`a.b` long, c string")
    assert writers.publish(spark, odd, str(tmp_path), "odd")["rows"] == 3
    evaluated = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            evaluated.add(b.num_rows)
            yield b

    plain = odd.toDF("a", "c")
    writers.publish(spark, plain.mapInArrow(seen, plain.schema), str(tmp_path), "once")
    assert evaluated.value == 3


def test_store_deletions(spark, tmp_path):
    schema, path = "id long, active boolean, updated_at string, note string", str(tmp_path / "s")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    state = lambda: sorted(((r["id"], r["active"], r["updated_at"]) for r in stores.read_current(spark, path, schema).collect()), key=repr)
    assert state() == [] and not stores.delete(spark, path, schema, ids(1), "id", F.lit("t2"))
    rows = spark.createDataFrame([(1, True, "t1", None), (2, True, "t1", "é"), (2, True, "t1", "é"), (None, True, "t1", "x")], schema)
    first = writers.replace_store(spark, rows, path, 1)
    assert not stores.delete(spark, path, schema, ids(7, None), "id", F.lit("t2")) and stores.current_version(spark, path) == (1, first)
    assert stores.delete(spark, path, schema, ids(2, 2), "id", F.lit("t2"))
    assert state() == [(1, True, "t1"), (2, False, "t2"), (2, False, "t2"), (None, True, "t1")]
    assert stores.delete(spark, path, schema, ids(1, 2), "id", F.lit("t3"), hard=True)
    assert state() == [(None, True, "t1")] and stores.current_version(spark, path)[0] == 3
    assert spark.read.schema(schema).json(first).count() == 4
    (tmp_path / "s/v00000009").write_text("{broken\n")
    (tmp_path / "s/CURRENT").write_text(str(tmp_path / "s/v00000009"))
    (tmp_path / "s/.CURRENT.crc").unlink(missing_ok=True)
    assert state() == []
    assert not stores.delete(spark, path, schema, ids(1), "id", F.lit("t4"))


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    assert joins.multiset_difference(a, a.union(a.limit(1))) == 1
    assert [r[0] for r in joins.stale(a, a.withColumn("v", F.when(F.col("k") == "x", 9).otherwise(F.col("v"))), ["k"], "v").collect()] == ["x"]
    f = spark.createDataFrame([(1, 2, "near", "review"), (3, 4, "sample_exact", "reject"), (5, 6, "near", "review")], "a long, b long, type string, status string")
    e = spark.createDataFrame([(2, 1, ["near"]), (3, 4, ["*"])], "a long, b long, waive array<string>")
    assert {(r["a"], r["waived"]) for r in joins.waive(f, e).collect()} == {(1, True), (3, False), (5, False)}
    split = spark.createDataFrame([(1, "train"), (2, "test"), (5, "train"), (6, "train")], "id long, split string")
    assert [(r["a"], r["b"]) for r in joins.crossing(f.select("a", "b"), split, "a", "b", "id", "split").collect()] == [(1, 2)]


CHAT = [(1, 0, "user", "A célom futni. Írj tervet?"), (1, 1, "assistant", "Itt a terv."), (1, 2, "user", "Mi az idő?"), (2, 0, "user", "Hány óra?"), (2, 1, "user", "Köszönöm, rendben"), (2, 2, "user", "Folytasd az előző dolgot")]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_conversation_state(spark):
    got = {r["conv_id"]: r for r in state.conversation_state(spark.createDataFrame(CHAT, SCHEMA)).collect()}
    assert got[1]["goal"] == "A célom futni. Írj tervet?" and got[1]["decision"] == "Itt a terv."
    assert got[1]["questions"] == "A célom futni. Írj tervet? | Mi az idő?" and got[1]["tasks"] == "A célom futni. Írj tervet?"
    assert got[2]["questions"] == "" and got[2]["topic"] == "Köszönöm, rendben"


def test_streamed_state_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in (CHAT[:2] + CHAT[3:5], [CHAT[2], CHAT[5]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = state.stream_conversation_state(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = sorted(spark.table("states").collect(), key=lambda r: r["turn"])
    last = {r["conv_id"]: tuple(r) for r in rows}
    assert last == {r["conv_id"]: tuple(r) for r in state.conversation_state(spark.createDataFrame(CHAT, SCHEMA)).select(*rows[0].asDict()).collect()}


def test_streamed_windows(spark, tmp_path):
    events = spark.createDataFrame([(1, 7, "a", 1.0, "2024-01-01 00:10:00"), (2, 7, "a", 2.0, "2024-01-01 00:20:00"), (2, 7, "a", 2.0, "2024-01-01 00:20:00"), (3, 7, "b", 3.0, "2024-01-01 02:00:00")], "event_id long, user_id long, event_type string, value double, t string")
    events = events.withColumn("ts", F.to_timestamp("t")).drop("t")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.tumbling(state.once(stream), late=None).writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
    assert sorted(r["n"] for r in state.sessions(events).collect()) == [1, 3]
