"""Versioned stores: reads through the pointer, deletions that write the next version."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

from textloom.operators.retrieval import deactivate, remove
from textloom.sources.readers import read_store
from textloom.sources.writers import replace_store

VERSION = re.compile(r"/v([0-9]{8,})$")


def current_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of the version that CURRENT names; (0, None) where there is no pointer, or it names none."""
    target = _pointer(spark, path)
    found = VERSION.search(target) if target else None
    return (int(found[1]), target) if found else (0, None)


def _pointer(spark: SparkSession, path: str) -> str | None:
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    row = spark.read.text(f"{path}/CURRENT").first()
    return row[0].strip() if row else None


def read_current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of the store's present version. A store never written, or with a broken version, is empty."""
    target = current_version(spark, path)[1]
    return spark.createDataFrame([], schema) if target is None else read_store(spark, target, schema, array=False)


def delete(spark: SparkSession, path: str, schema: str, ids: DataFrame, key: str, now: Column, hard: bool = False) -> bool:
    """Whether any listed record was there; if so the next version has it inactive, or (``hard``) no more.

    Nothing is written where no record is listed. Versions before stay as they
    are. A broken version reads as an empty store, so nothing is deleted from it.
    """
    version, target = current_version(spark, path)
    records = read_current(spark, path, schema)
    if target is None or records.join(ids.select(key).distinct(), key, "left_semi").isEmpty():
        return False
    left = remove(records, ids, key) if hard else deactivate(records, ids, key, now).select(records.columns)
    replace_store(spark, left, path, version + 1)
    return True
