"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over one text, so the scan, the metrics
and the verdict are a single narrow stage without user functions or shuffles.

Words are runs of characters other than space and U+0009 to U+000D. A word
counts as repeated when it lies in a window of eight words that the text holds
twice or more; windows are compared by 64-bit hashes built by doubling (pairs,
fours, eights).

Stop words count each time they stand in a text; their share of all words is
the stop-word ratio.

Defined results: null and empty texts have no words, fail the base rules and
are not kept; texts of fewer than eight words have no repeated words; ratios of
texts without words count as 0; texts are read whole; each row is judged alone,
so repeated rows get equal results; an empty table gives an empty table. Only
the named id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for on with as was be by this are or an from at not have "
    "le la les de des du et en un une est que qui dans pour par sur au avec ne pas "
    "der die das und ist ein eine nicht von zu den mit dem im auf sich für es "
    "el los las del y que en un una por con para se su al lo como más no"
).split()

#: Small letters, or a capital and small letters.
STOP_FORMS = sorted(set(STOP_WORDS) | {w.capitalize() for w in STOP_WORDS})


@dataclass(frozen=True)
class Rule:
    """A text is kept if ``low <= metric <= high`` (None: open)."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("exclamation_ratio", None, 0.3),
    Rule("upper_ratio", None, 0.3),
    Rule("non_letter_ratio", None, 0.4),
    Rule("dup_line_ratio", None, 0.4),
    Rule("ellipsis_line_ratio", None, 0.3),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("stop_word_ratio", 0.03, None),
)


def _pairs(a: str, gap: int) -> Column:
    """Hashes of elements ``gap`` apart, a[i] and a[i + gap], of column ``a``."""
    n = F.greatest(F.size(a) - F.lit(gap), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + gap), n), lambda x, y: F.xxhash64(x, y))


def _starts(at: str) -> Column:
    """Places, in order, of the sorted (hash, place) pairs in column ``at`` whose hash occurs twice or more."""
    h = lambda i: F.get(F.col(at), i)["h"]
    twice = F.filter(F.col(at), lambda e, i: F.coalesce(h(i - 1) == e["h"], F.lit(False)) | F.coalesce(h(i + 1) == e["h"], F.lit(False)))
    return F.sort_array(F.transform(twice, lambda e: e["i"]))


def _covered(starts: str) -> Column:
    """Words in the windows that start at the places in column ``starts``."""
    n = F.size(starts) - 1
    gaps = F.zip_with(F.slice(starts, F.lit(1), n), F.slice(starts, F.lit(2), n), lambda a, b: F.least(F.lit(WINDOW), b - a))
    return F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and every metric of the threshold table."""
    text = F.col("t")
    out = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = out.select(
        id_col,
        text,
        F.array_remove(F.split(text, SPACES), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        # what one pass over the text leaves to count in: all but lower-case letters and spaces
        F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", "").alias("rest"),
    )
    words = F.col("w")
    out = out.select(
        id_col,
        "w",
        "lines",
        "rest",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.transform(words, lambda x: F.xxhash64(x)).alias("h"),
    )
    for gap in (1, 2, 4):  # a column each, as an expression used thrice would be evaluated thrice
        out = out.withColumn("h", _pairs("h", gap))
    # only texts with equal windows sort them
    equal = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("at", F.when(equal, F.sort_array(pairs)))
    out = out.withColumn("starts", F.when(F.col("at").isNotNull(), _starts("at")))
    count = lambda pattern: F.regexp_count("rest", F.lit(pattern)).cast("long")
    lines, n_lines = F.col("lines"), F.size("lines")
    matching = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    out = out.select(
        id_col,
        "n_words",
        "word_chars",
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col("starts").isNull(), F.lit(0)).otherwise(_covered("starts")).cast("long").alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        count("!").alias("n_exclamations"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[^\p{L}\x20\x09-\x0D]").alias("n_non_letters"),
        matching(r"(\.\.\.|…)[\x20\x09-\x0D]*$").alias("n_ellipsis_lines"),
        matching(r"^[\x20\x09-\x0D]*[-*•]").alias("n_bullet_lines"),
        F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_exclamations", "n_words").alias("exclamation_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_non_letters", "word_chars").alias("non_letter_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
        ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression of the whole table."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict &= F.col(r.metric) >= F.lit(r.low)
        if r.high is not None:
            verdict &= F.col(r.metric) <= F.lit(r.high)
    return verdict


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All metrics of every whole text with ``base_failed`` and ``kept``."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = measure(df, id_col, text_col)
    return measured.select("*", base_failed.alias("base_failed"), (~base_failed & compile_rules(rules)).alias("kept"))


def oracle_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    n = lambda pattern: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"
    rules = " AND ".join(
        f"{r.metric} {op} CAST({v} AS DOUBLE)" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None
    )
    ratio = lambda a, b, name: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END AS {name}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM a WHERE len(w) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, sum(CASE WHEN nxt IS NULL THEN 8 ELSE least(8, nxt - i) END) AS c
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_append(w, ''), 'string_agg', '')) AS BIGINT) AS word_chars,
      CAST({n('[#*$%&|<>]')} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(cov.c, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, {n('!')} AS n_exclamations, {n(chr(92) + 'p{Lu}')} AS n_upper,
      {n('[^' + chr(92) + 'p{L}' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]')} AS n_non_letters,
      len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
      len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines,
      len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words
      FROM a LEFT JOIN cov ON a.doc_id = cov.doc_id),
r AS (SELECT *, {ratio('word_chars', 'n_words', 'mean_word_chars')}, {ratio('n_symbols', 'n_words', 'symbol_ratio')},
      {ratio('n_exclamations', 'n_words', 'exclamation_ratio')}, {ratio('n_upper', 'word_chars', 'upper_ratio')},
      {ratio('n_non_letters', 'word_chars', 'non_letter_ratio')}, {ratio('n_dup_lines', 'n_lines', 'dup_line_ratio')},
      {ratio('n_ellipsis_lines', 'n_lines', 'ellipsis_line_ratio')}, {ratio('n_bullet_lines', 'n_lines', 'bullet_line_ratio')},
      {ratio('n_stop_words', 'n_words', 'stop_word_ratio')},
      n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM r"""
