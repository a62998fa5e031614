"""Sinks: JSON lines, indexed pass-through exports, blocks, partitions, atomic publication."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUN_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def row_index(rows: DataFrame) -> DataFrame:
    """(id, source_file, source_line, row_sha256) of rows that are passed through unchanged."""
    return rows.select("id", "source_file", F.col("line_no").alias("source_line"), F.sha2("raw", 256).alias("row_sha256"))


def write_export(rows: DataFrame, path: str) -> None:
    """Raw lines in order of file and line, and their index as tab-separated text."""
    ordered = rows.repartitionByRange("source_file", "line_no").sortWithinPartitions("source_file", "line_no")
    ordered.select(F.col("raw").alias("value")).write.text(f"{path}/rows")
    row_index(ordered).write.option("sep", "\t").option("header", True).csv(f"{path}/index")


def write_blocks(blocks: DataFrame, path: str, order: list[str]) -> None:
    """Text blocks, an empty line after each, in order."""
    ordered = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.concat("block", F.lit("\n")).alias("value")).write.text(path)


def write_split(samples: DataFrame, path: str) -> None:
    samples.write.partitionBy("split", "mode").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of one row as one JSON object."""
    rows = df.limit(2).count()
    if rows != 1:
        raise ValueError(f"a summary has one row, not {rows}")
    write_jsonl(df.coalesce(1), path)


def write_block_export(rows: DataFrame, path: str, order: list[str]) -> None:
    """Blocks of rows (id, category, source_file, source_line, raw, instruction, input, output), their index, and the rows withheld with their reasons."""
    from textloom.operators import samples as SM

    parts = [F.col(c) for c in ("instruction", "input", "output")]
    base = rows.withColumn("reasons", SM.block_reasons(*parts)).withColumn("row_sha256", F.sha2("raw", 256))
    kept = base.where(F.size("reasons") == 0).withColumn("block", SM.render_block(*parts))
    write_blocks(kept, f"{path}/blocks", order)
    about = ["id", "category", "source_file", "source_line", "row_sha256"]
    tsv = lambda d, name: d.write.option("sep", "\t").option("header", True).csv(f"{path}/{name}")
    flags = F.array_join(SM.block_flags(*parts), ",").alias("flags")
    tsv(kept.select(*about, F.sha2("block", 256).alias("block_sha256"), F.length("block").alias("block_chars"), flags), "index")
    tsv(base.where(F.size("reasons") > 0).select(*about, F.array_join("reasons", ",").alias("reasons")), "withheld")


def write_split_outputs(assigned: DataFrame, held: DataFrame, groups: DataFrame, links: DataFrame, overlaps: DataFrame, path: str, key: str) -> None:
    """The tables of a split: assignment, held_back, groups, ids of each part, overlaps and links."""
    write_jsonl(assigned, f"{path}/assignment")
    write_jsonl(held, f"{path}/held_back")
    write_jsonl(groups, f"{path}/groups")
    assigned.select(F.col(key).cast("string").alias("id"), "split").write.partitionBy("split").text(f"{path}/ids")
    write_jsonl(overlaps, f"{path}/overlaps")
    write_jsonl(links, f"{path}/links")


def write_samples(samples: DataFrame, held: DataFrame, path: str) -> None:
    """Samples by split and mode, an index of them, an index of conversations, and what is withheld.

    ``samples`` has sample_id, conv_id, split, mode and rendered.
    """
    write_split(samples, f"{path}/samples")
    tsv = lambda d, name: d.write.option("sep", "\t").option("header", True).csv(f"{path}/{name}")
    tsv(samples.select("sample_id", "conv_id", "split", "mode", F.length("rendered").alias("chars"), F.sha2("rendered", 256).alias("sha256")), "sample_index")
    tsv(samples.groupBy("conv_id", "split").agg(F.count(F.lit(1)).alias("samples")), "conversation_index")
    write_jsonl(held, f"{path}/withheld")


def append_log(df: DataFrame, path: str) -> bool:
    """Append events as JSON lines; a failing log never fails its caller."""
    try:
        df.write.mode("append").json(path)
        return True
    except Exception:
        return False


class _Files:
    """The few file operations of a publication, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"can't rename {a}")

    def write(self, p: str, text: str) -> None:
        out = self.fs.create(self.path(p), True)
        out.write(text.encode())
        out.close()


def publish(spark: SparkSession, df: DataFrame, folder: str, run: str, protected: tuple[str, ...] = ()) -> dict:
    """Write, read back, compare, then rename; the manifest comes last.

    Rows and digest of what is written are taken while it is written, so that
    ``df`` is evaluated once. A run's folder is never overwritten. Whatever fails before the rename leaves
    the partial folder with FAILED.txt in it and no folder of that run.
    """
    if not RUN_NAME.match(run):
        raise ValueError(f"bad run name {run!r}")
    if any(folder.rstrip("/") == p.rstrip("/") for p in protected):
        raise ValueError(f"protected folder {folder}")
    final, partial = f"{folder}/{run}", f"{folder}/{run}.partial"
    files = _Files(spark, folder)
    if files.exists(final) or files.exists(partial):
        raise FileExistsError(final)
    hashed = F.xxhash64(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])
    sums = F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(hashed), F.lit(0)).alias("digest")
    seen = Observation()
    try:
        df.observe(seen, *sums).write.mode("errorifexists").parquet(f"{partial}/data")
        wrote, kept = seen.get, spark.read.parquet(f"{partial}/data").agg(*sums).first().asDict()
        if wrote != kept:
            raise RuntimeError(f"read back {kept}, wrote {wrote}")
    except Exception as e:
        files.write(f"{partial}/FAILED.txt", str(e)[:2000])
        raise
    files.rename(partial, final)
    manifest = {"run": run, **kept, "columns": df.columns, "training_ready": False, "content_verified": False, "split_approved": False}
    files.write(f"{final}/manifest.json", json.dumps(manifest))
    return manifest


def replace_store(spark: SparkSession, df: DataFrame, path: str, version: int) -> str:
    """Write a new version of a store beside the old ones and point CURRENT to it."""
    target = f"{path}/v{version:08d}"
    df.write.mode("errorifexists").json(target)
    _Files(spark, path).write(f"{path}/CURRENT", target)
    return target
