"""Line-preserving scans, configuration lists, block texts and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

ID = r"^[A-Za-z0-9_.-]+$"
MAX_UPLOAD = 200_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, raw, crlf, blank) of text files, byte for byte but for line ends.

    Lines are numbered within their file. Files of any size are read in splits:
    a line's number is its place in the split after the lines of the splits
    before, of which there is one row for each 128 MB or so.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("__start"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("__place"))
    splits = lines.groupBy("source_file", "__start").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("source_file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = lines.join(F.broadcast(splits.withColumn("__before", before).drop("__n")), ["source_file", "__start"])
    raw = F.regexp_replace("line", r"\r\z", "")
    return out.select("source_file", (F.col("__before") + F.col("__place") - F.col("__first") + 1).alias("line_no"), raw.alias("raw"), F.col("line").endswith("\r").alias("crlf"), (F.trim(raw) == "").alias("blank"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, bytes, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their digest and id; a line that isn't an object with an id stops the job."""
    lines = read_lines(spark, path).where("NOT blank")
    ident = F.get_json_object("raw", "$.id")
    good = F.try_parse_json("raw").isNotNull() & F.col("raw").rlike(r"^\s*\{") & ident.isNotNull()
    stop = F.raise_error(F.concat_ws(":", F.lit("bad line"), "source_file", F.col("line_no").cast("string"))).cast("string")
    return lines.withColumn("id", F.when(good, ident).otherwise(stop)).withColumn("row_sha256", F.sha2("raw", 256))


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed rows; lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines of a directory with numbers that run on from file to file, in the order of file names."""
    count = lines.groupBy("source_file").agg(F.max("line_no").alias("__n"))
    # one row for each file
    before = F.coalesce(F.sum("__n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(count.select("source_file", before.alias("__before")), "source_file").withColumn("row_number", F.col("__before") + F.col("line_no")).drop("__before")


def require_clean_folder(path: str, spark: SparkSession | None = None, ending: str = ".jsonl") -> None:
    """Only folders named clean are sources of exports; with ``spark``, there must be a file in it."""
    if path.rstrip("/").rsplit("/", 1)[-1] != "clean":
        raise ValueError(f"not a clean folder: {path}")
    if spark is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not any(f.isFile() and f.getPath().getName().endswith(ending) for f in fs.listStatus(p)):
            raise ValueError(f"no files in {path}")


def read_exclusions(spark: SparkSession, path: str, allow_empty: bool = False, id_form: str = ID) -> DataFrame:
    """(id, reason, review) of lines ``id | reason | review``; # starts a comment line."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v")).where("trim(v) <> '' AND NOT startswith(trim(v), '#')")
    p = F.split("v", r"\|", 3)
    out = lines.select(*[F.trim(F.coalesce(F.get(p, F.lit(k)), F.lit(""))).alias(n) for k, n in enumerate(("id", "reason", "review"))])
    found = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"), F.count_if(~F.col("id").rlike(id_form)).alias("bad"), F.count_if((F.col("reason") == "") | (F.col("review") == "")).alias("open")).first()
    if found["bad"] or found["open"] or found["d"] != found["n"] or (not found["n"] and not allow_empty):
        raise ValueError(f"bad exclusion list {path}: {found.asDict()}")
    return out


def read_store(spark: SparkSession, path: str, schema: str, array: bool = True) -> DataFrame:
    """Records of a JSON array, or of JSON lines; a missing or broken file is an empty store."""
    try:
        out = spark.read.schema(schema).option("multiLine", array).option("mode", "FAILFAST").json(path)
        out.agg(F.bit_xor(F.xxhash64(*out.columns))).first()
        return out
    except Exception as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "does not exist", "MALFORMED", "Malformed")):
            return spark.createDataFrame([], schema)
        raise


def read_names(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A name bank: a JSON object of four lists of names; anything else is an error. A bank is configuration."""
    fields = ("approved", "blocked_given", "surname", "allowed")
    row = spark.read.schema(", ".join(f"{f} array<string>" for f in fields)).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
    if row is None or any(row[f] is None or any(not (n or "").strip() for n in row[f]) for f in fields):
        raise ValueError(f"bad name bank {path}")
    return row.asDict()


def read_export(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """(id, raw, row_sha256, source_file, source_line) of an indexed export, checked against its index and manifest.

    ``manifest`` has status, rows_exported, rows_read, rows_excluded and the two
    flags of approval, which an export can't have. Rows and index must agree line
    by line, ids must be unique; any mismatch is an error.
    """
    m = manifest
    if m.get("status") != "ok" or m.get("training_ready") is not False or m.get("content_verified") is not False:
        raise ValueError("the manifest is not that of a finished export")
    if m["rows_read"] != m["rows_exported"] + m["rows_excluded"]:
        raise ValueError("counts of the manifest don't balance")
    rows = read_lines(spark, f"{path}/rows").where("NOT blank").select(F.get_json_object("raw", "$.id").alias("id"), "raw", F.sha2("raw", 256).alias("row_sha256"))
    index = spark.read.option("sep", "\t").option("header", True).schema("id string, source_file string, source_line long, row_sha256 string").csv(f"{path}/index")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"), F.count_if(F.col("id").isNull()).alias("none")).first()
    if n["none"] or n["d"] != n["n"] or n["n"] != m["rows_exported"]:
        raise ValueError(f"bad rows of the export: {n.asDict()}")
    joined = rows.join(index.withColumnRenamed("row_sha256", "indexed"), "id", "full_outer")
    if joined.where(~F.col("row_sha256").eqNullSafe(F.col("indexed"))).limit(1).count():
        raise ValueError("rows and index differ")
    return joined.drop("indexed")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a text, which empty lines part; blank blocks are left out."""
    return spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''").select(F.col("value").alias("block"))


# Endings that are taken, and what a name must not hold once all but letters, digits and dots are gone.
ENDINGS = ".txt .md .json .jsonl .csv .py .js .html .css .log".split()
BLOCKED_NAMES = "env secret titok kulcs token jelszo password credential private_key id_rsa .git wallet apikey api_key".split()
UNNAMED = "feltoltott_fajl"


def display_name(name: Column) -> Column:
    """A file's name without folders, unprintable characters and dots before it, of 150 characters at most."""
    base = F.element_at(F.split(F.replace(T.strip(F.coalesce(name, F.lit(""))), F.lit("\\"), F.lit("/")), "/"), -1)
    plain = T.strip(F.regexp_replace(base, r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}", ""))
    cut = F.substring(F.regexp_replace(plain, r"^\.+", ""), 1, 150)
    return F.when(cut == "", UNNAMED).otherwise(cut)


def check_uploads(files: DataFrame) -> DataFrame:
    """``files`` (name, content) with display_name and error_code, null if the file is taken.

    Codes, the first that applies: empty_file, file_too_large, unsupported_type,
    blocked_filename, binary_not_supported (a NUL byte or broken UTF-8).
    """
    out = files.withColumn("display_name", display_name(F.col("name")))
    shown = F.col("display_name")
    ending = F.lower(F.regexp_extract(shown, r"^.+(\.[^.]*)$", 1))
    letters = F.regexp_replace(T.fold(shown), r"[^a-z0-9.]+", "")
    body = F.col("content").cast("string")
    code = (
        F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty_file")
        .when(F.octet_length("content") > MAX_UPLOAD, "file_too_large")
        .when(~ending.isin(*ENDINGS), "unsupported_type")
        .when(T.contains_any(letters, BLOCKED_NAMES), "blocked_filename")
        .when(body.contains("\x00") | F.try_validate_utf8(body).isNull(), "binary_not_supported")
    )
    return out.withColumn("error_code", code)
