"""Links are dear to find and few: they are found once, however often groups are read."""

from pyspark.sql import functions as F

from textloom.operators import grouping, similarity
from textloom.plans import queries


def test_groups_find_their_links_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    n = 40
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).mapInArrow(counted, "a long, b long")
    g = grouping.groups(spark.range(n + 1).withColumnRenamed("id", "doc_id"), links, "doc_id")
    assert g.select("group_id").distinct().count() == 1
    assert g.join(g.select("group_id").distinct(), "group_id").count() == n + 1
    assert seen.value == n


def test_summary_finds_overlaps_once(spark, tmp_path, monkeypatch):
    calls = []
    found = similarity.sentence_overlap
    monkeypatch.setattr(similarity, "sentence_overlap", lambda *a: calls.append(1) or found(*a))
    lines = [f"This is the sentence with number {i} of all." for i in range(6)]
    texts = [" ".join(lines), " ".join(reversed(lines)), "Another text.", "Another text."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = queries.QUERIES["dedupe_summary"](spark, str(tmp_path)).first()
    assert (r["records"], r["findings_total"], r["groups"], r["largest_group"]) == (4, 2, 2, 2)
    assert len(calls) == 1


def test_overlaps_keep_digests_of_first_copies_alone_and_no_longer_than_needed(spark, monkeypatch):
    written, gone = [], []
    write, remove = similarity.materialise, similarity.discard

    def counted(df, name, *a):
        out = write(df, name, *a)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(similarity, "materialise", counted)
    monkeypatch.setattr(similarity, "discard", lambda df: gone.append(len(df.inputFiles())) or remove(df))
    lines = [f"This is the sentence with number {i} of all." for i in range(6)]
    texts = [" ".join(lines), " ".join(reversed(lines)), *[" ".join(lines)] * 5]
    found = similarity.sentence_overlap(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert [(r["a"], r["b"]) for r in found] == [(0, 1)]
    assert dict(written)["digests"] == 2
    assert gone and gone[0] > 0
