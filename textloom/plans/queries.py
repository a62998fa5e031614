"""Named queries over the driver's tables, each beside DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import classify as C
from textloom.functions import documents as D
from textloom.functions import score as S
from textloom.functions import text as T
from textloom.operators import grouping, joins, names, records, reports, retrieval, rules, similarity, split_plan, text_pairs, typed_links, windows
from textloom.operators import samples as SM
from textloom.plans import sql as Q
from textloom.session import dealt, table
from textloom.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def chats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


# rows: rules, scores, reports

STRIPPED = f"WITH s AS (SELECT doc_id, source, coalesce(text, '') AS raw, {Q.strip('''coalesce(text, '')''')} AS o FROM documents)"
ISSUES = f"{STRIPPED}, i AS (SELECT doc_id, source, {Q.flags(Q.content_flags('raw', 'o'))} AS issues FROM s)"
SCORED = f"{STRIPPED}, f AS (SELECT doc_id, source, {Q.row_flags('o')} AS flags FROM s), c AS (SELECT *, CASE WHEN list_contains(flags, 'empty_output') THEN 0 ELSE {Q.penalised('flags', S.ROW_PENALTIES)} END AS score FROM f)"


@query(f"{ISSUES} SELECT doc_id, array_to_string(issues, ',') AS issues FROM i")
def doc_rule_flags(spark, d):
    return rules.text_issues(dealt(docs(spark, d).select("doc_id", "text"))).select("doc_id", F.array_join("issues", ",").alias("issues"))


@query(f"{SCORED} SELECT doc_id, score, array_to_string(flags, ',') AS flags FROM c")
def doc_quality_score(spark, d):
    f = rules.text_issues_and_flags(dealt(docs(spark, d).select("doc_id", "text")), ["doc_id"]).select("doc_id", F.col("flags").alias("f"))
    return f.select("doc_id", S.row_score(F.col("f")).alias("score"), F.array_join("f", ",").alias("flags"))


@query(
    f"""{SCORED}, i AS (SELECT doc_id, {Q.flags(Q.content_flags('raw', 'o'))} AS issues FROM s)
SELECT source, count(*) AS n_rows, count(*) FILTER (len(issues) = 0) AS accepted, count(*) FILTER (len(issues) > 0) AS rejected,
       CAST(sum(score) AS BIGINT) AS score_sum, CAST(sum(score) AS DOUBLE) / count(*) AS mean_score, CAST(sum(len(flags)) AS BIGINT) AS n_flags
FROM c JOIN i USING (doc_id) GROUP BY source"""
)
def source_quality_summary(spark, d):
    f = rules.text_issues_and_flags(dealt(docs(spark, d).select("source", "text")), ["source"]).withColumnRenamed("flags", "f")
    f = f.select("source", "issues", "f", S.row_score(F.col("f")).alias("score"))
    return f.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.size("issues") == 0).alias("accepted"),
        F.count_if(F.size("issues") > 0).alias("rejected"),
        F.sum("score").alias("score_sum"),
        (F.sum("score").cast("double") / F.count(F.lit(1))).alias("mean_score"),
        F.sum(F.size("f")).alias("n_flags"),
    )


@query(
    f"""{ISSUES} SELECT doc_id, reason_code, reason_code IN ({Q.listed(rules.AUTO_FIXABLE)}) AS auto_fixable, reason_code NOT IN ({Q.listed(rules.AUTO_FIXABLE)}) AS needs_manual_review
FROM (SELECT doc_id, unnest(issues) AS reason_code FROM i)"""
)
def reject_report(spark, d):
    return rules.reject_report(rules.text_issues(dealt(docs(spark, d).select("doc_id", "text"))), "doc_id")


@query("SELECT doc_id AS id, first AS kept_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first")
def exact_duplicates(spark, d):
    return similarity.exact_duplicates(docs(spark, d).select(F.col("doc_id").alias("id"), "text"))


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_occurrence(spark, d):
    return windows.first_by(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query("SELECT coalesce(source, '(none)') AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts(spark, d):
    return docs(spark, d).groupBy(F.coalesce("source", F.lit("(none)")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _tags(df: DataFrame) -> DataFrame:
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    return df.select(F.explode(F.array(F.concat(F.lit("lang_"), "lang"), F.concat(F.lit("src_"), "source"), size)).alias("tag"))


@query(
    """WITH t AS (SELECT unnest(['lang_' || lang, 'src_' || source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END]) AS tag FROM documents)
SELECT tag, n, share FROM (SELECT tag, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) AS share FROM t GROUP BY tag) WHERE share > 0.08"""
)
def topic_overrepresentation(spark, d):
    total = docs(spark, d).agg(F.count(F.lit(1)).alias("total"))
    counts = _tags(docs(spark, d)).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1))
    share = F.col("n").cast("double") / F.col("total")
    return counts.join(F.broadcast(total.withColumn("k", F.lit(1))), "k").select("tag", "n", share.alias("share")).where("share > 0.08")


KEYWORDS = ("the", "tion", "http", "copyright", "password", "que")


@query(f"SELECT k AS keyword, count(*) AS n FROM (SELECT text, unnest([{Q.listed(KEYWORDS)}]) AS k FROM documents) WHERE contains(lower(text), k) GROUP BY k")
def keyword_watch(spark, d):
    held = F.array_compact(F.array(*[F.when(F.lower("text").contains(k), F.lit(k)) for k in KEYWORDS]))
    return docs(spark, d).select(F.explode(held).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


# exclusion and lineage


def _listed(spark, d):
    return table(spark, d, "labels").where("quality = 0").select("doc_id")


@query("SELECT doc_id, source, sha256(text) AS row_sha256 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def export_after_exclusion(spark, d):
    return joins.exclude(docs(spark, d), _listed(spark, d), "doc_id").select("doc_id", "source", F.sha2("text", 256).alias("row_sha256"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def excluded_rows(spark, d):
    return joins.excluded(docs(spark, d).select("doc_id", "source"), _listed(spark, d), "doc_id")


@query("SELECT l.doc_id, count(x.doc_id) AS hits FROM (SELECT doc_id FROM labels WHERE quality = 0) l LEFT JOIN documents x ON l.doc_id = x.doc_id GROUP BY l.doc_id")
def exclusion_cardinality(spark, d):
    return joins.cardinality(docs(spark, d), _listed(spark, d), "doc_id")


@query(
    """SELECT doc_id, 'error' AS issue FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT doc_id, 'warning' FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def exclusion_consistency(spark, d):
    return joins.consistency(table(spark, d, "labels").where("toxic = 1").select("doc_id"), _listed(spark, d), "doc_id")


@query("SELECT doc_id AS id, source AS source_file, doc_id AS source_line, sha256(text) AS row_sha256 FROM documents")
def row_hash_index(spark, d):
    from textloom.sources.writers import row_index

    return row_index(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("source_file"), F.col("doc_id").alias("line_no"), F.col("text").alias("raw")))


@query("SELECT source, count(*) FILTER (quality IS DISTINCT FROM 0) AS exported, count(*) FILTER (quality = 0) AS excluded FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def export_counts(spark, d):
    x = docs(spark, d).select("doc_id", "source").join(_listed(spark, d).withColumn("l", F.lit(True)), "doc_id", "left")
    return x.groupBy("source").agg(F.count_if(F.col("l").isNull()).alias("exported"), F.count_if("l").alias("excluded"))


@query("SELECT 'documents_only' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def id_set_overlap(spark, d):
    a, b = docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id")
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return n(a.subtract(b), "documents_only").union(n(a.intersect(b), "both"))


# conversations: rules, samples, renderings

M = "SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations"
X = Q.strip("x")
MESSAGE_RULES = [
    ("bad_role", "role IS NULL OR role NOT IN ('user', 'assistant')"),
    ("bad_alternation", "role IS DISTINCT FROM CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END"),
    ("empty_text", f"{X} = ''"),
    ("untrimmed_text", f"{X} <> x"),
    ("newline_in_text", "contains(x, chr(10))"),
    ("control_character", "regexp_matches(replace(x, chr(10), ''), '[\\p{Cc}\\x{2028}\\x{2029}]')"),
    ("user_too_long", "role = 'user' AND length(x) > 300"),
    ("assistant_too_long", "role = 'assistant' AND length(x) > 600"),
    ("role_label", Q.match("x", rules.LABEL)),
    ("url", Q.match("x", rules.URL)),
    ("long_digits", Q.match("x", rules.LONG_DIGITS)),
    ("assistant_too_short", f"role = 'assistant' AND len({Q.words('x')}) < 3"),
    ("repeated_char_run", Q.repeated_run("x")),
    ("garbled_output", Q.garbled("x")),
    ("english_mixing", Q.english("x")),
    ("overclaiming", Q.any_of("lower(x)", S.OVERCLAIMS)),
    ("personal_data_suspected", Q.personal("x")),
    ("dangerous_content_suspected", Q.dangerous("x")),
]
MESSAGE_ISSUES = f"mi AS (SELECT conv_id, turn, unnest({Q.flags(MESSAGE_RULES)}) AS code FROM ({M}))"
SHAPE_ISSUES = """sh AS (SELECT conv_id, count(*) AS n, arg_min(role, turn) AS f, arg_max(role, turn) AS l, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY conv_id),
si AS (SELECT conv_id, unnest(list_filter([CASE WHEN f IS DISTINCT FROM 'user' THEN 'first_not_user' END, CASE WHEN l IS DISTINCT FROM 'assistant' THEN 'last_not_assistant' END,
  CASE WHEN n % 2 <> 0 THEN 'odd_message_count' END, CASE WHEN n // 2 < 3 OR n // 2 > 8 THEN 'bad_exchange_count' END, CASE WHEN hi - lo + 1 <> n THEN 'turn_gap' END], lambda x: x IS NOT NULL)) AS code FROM sh)"""


@query(f"WITH {MESSAGE_ISSUES} SELECT conv_id, turn, code FROM mi")
def conv_issues(spark, d):
    return rules.message_issues(chats(spark, d))


@query(f"WITH {SHAPE_ISSUES} SELECT conv_id, code FROM si")
def conv_shape_issues(spark, d):
    return rules.conversation_issues(chats(spark, d))


@query(f"WITH {MESSAGE_ISSUES}, {SHAPE_ISSUES} SELECT DISTINCT conv_id, conv_id NOT IN (SELECT conv_id FROM mi UNION ALL SELECT conv_id FROM si) AS turns_validated FROM conversations")
def conv_validated(spark, d):
    return rules.validate_conversations(chats(spark, d))


@query(
    """SELECT count(*) AS conversations, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(a) AS BIGINT) AS exchanges, CAST(sum(greatest(a - 1, 0)) AS BIGINT) AS history_dependent
FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)"""
)
def conv_summary(spark, d):
    c = chats(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "assistant").alias("a"))
    return c.agg(F.count(F.lit(1)).alias("conversations"), F.sum("n").alias("messages"), F.sum("a").alias("exchanges"), F.sum(F.greatest(F.col("a") - 1, F.lit(0))).alias("history_dependent"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') WHERE r > 1")
def repeated_assistant_msgs(spark, d):
    w = SM.Window.partitionBy("conv_id", "text").orderBy("turn")
    return chats(spark, d).where("role = 'assistant'").withColumn("r", F.row_number().over(w)).where("r > 1").select("conv_id", "turn")


LAGGED = """l AS (SELECT *, lag(role, 1) OVER w AS r1, lag(role, 2) OVER w AS r2, lag(role, 3) OVER w AS r3, lag(text, 1) OVER w AS t1, lag(text, 2) OVER w AS t2, lag(text, 3) OVER w AS t3
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT * FROM l WHERE role = 'assistant' AND r1 = 'user')"""
SAMPLES = f"{LAGGED}, s AS (SELECT conv_id, turn, t1 AS question, text AS answer, CASE WHEN r3 = 'user' AND r2 = 'assistant' THEN 'User: ' || t3 || chr(10) || 'AI: ' || t2 ELSE '' END AS context FROM p)"


@query(f"WITH {SAMPLES} SELECT conv_id, turn, question, answer, context FROM s")
def train_samples(spark, d):
    return SM.samples(chats(spark, d))


@query(
    """WITH h AS (SELECT conv_id, turn, role, text, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'AI: ' ELSE upper(role[1]) || lower(role[2:]) || ': ' END || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) AS rendered FROM conversations)
SELECT conv_id, turn, rendered, CAST(length(rendered) - length(text) AS INTEGER) AS target_start, CAST(length(rendered) AS INTEGER) AS target_end FROM h WHERE role = 'assistant'"""
)
def render_full_history(spark, d):
    return SM.full_history(chats(spark, d))


LAST = f"""{LAGGED}, u AS (SELECT *, {Q.trim_to('t3', 80)} AS u, {Q.trim_to('t2', 120)} AS a FROM p),
e AS (SELECT *, coalesce(r3 = 'user' AND r2 = 'assistant' AND u <> '' AND a <> '', false) AS has_context FROM u),
q AS (SELECT conv_id, turn, has_context, CASE WHEN has_context THEN 'User: ' || u || chr(10) || 'AI: ' || a || chr(10) || chr(10) ELSE '' END || 'User: ' || t1 || chr(10) || 'AI: ' || text AS rendered,
CAST(CASE WHEN has_context THEN greatest(length({Q.strip('t3')}) - 80, 0) + greatest(length({Q.strip('t2')}) - 120, 0) ELSE 0 END AS BIGINT) AS lost_chars FROM e)"""


@query(f"WITH {LAST} SELECT conv_id, turn, rendered, has_context, lost_chars, lost_chars = 0 AS lossless FROM q")
def render_last_exchange(spark, d):
    return SM.last_exchange(chats(spark, d))


@query(f"WITH {LAST} SELECT count(*) AS total, count(*) FILTER (NOT has_context) AS first_turn, count(*) FILTER (lost_chars = 0) AS lossless, count(*) FILTER (lost_chars > 0) AS truncated, CAST(sum(lost_chars) AS BIGINT) AS chars_lost FROM q")
def sample_stats(spark, d):
    return SM.last_exchange(chats(spark, d)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("has_context")).alias("first_turn"), F.count_if("lossless").alias("lossless"), F.count_if(F.col("lost_chars") > 0).alias("truncated"), F.sum("lost_chars").alias("chars_lost")
    )


def _blocks(spark, d):
    s = SM.samples(chats(spark, d))
    return s.select("conv_id", "turn", F.col("question").alias("i"), F.lit("").alias("n"), F.col("answer").alias("o"))


_F = {"instruction": "i", "input": "n", "output": "o"}
_CTRL = "[\\p{Cc}\\x{2028}\\x{2029}]"
BLOCK_RULES = [
    *((f"field_not_string:{k}", f"{v} IS NULL") for k, v in _F.items()),
    ("empty_instruction", f"{Q.strip('i')} = ''"),
    ("empty_output", f"{Q.strip('o')} = ''"),
    ("whitespace_only_input", f"n <> '' AND {Q.strip('n')} = ''"),
    *(
        rule
        for k, v in _F.items()
        for rule in [
            (f"carriage_return:{k}", f"contains({v}, chr(13))"),
            (f"control_character:{k}", f"regexp_matches(regexp_replace({v}, '[\\n\\t\\r]', '', 'g'), '{_CTRL}')"),
            (f"blank_line:{k}", f"contains({v}, chr(10) || chr(10))"),
            (f"edge_newline:{k}", f"starts_with({v}, chr(10)) OR ends_with({v}, chr(10))"),
        ]
    ),
    ("multiline_instruction", "contains(i, chr(10))"),
    ("role_label_at_line_start:input", "regexp_matches(n, '(?i)(^|\\n)\\s*(user|ai)\\s*:')"),
    ("role_label_at_line_start:output", "regexp_matches(o, '(?i)\\n\\s*(user|ai)\\s*:')"),
]
BLOCKS = f"{SAMPLES}, b AS (SELECT conv_id, turn, question AS i, '' AS n, answer AS o FROM s), r AS (SELECT *, {Q.flags(BLOCK_RULES)} AS reasons FROM b)"


@query(f"WITH {BLOCKS} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason")
def block_withheld_reasons(spark, d):
    r = SM.block_reasons(F.col("i"), F.col("n"), F.col("o"))
    return _blocks(spark, d).select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BLOCKS} SELECT conv_id, turn, sha256('User: ' || i || chr(10) || 'AI: ' || o) AS block_sha256, length('User: ' || i || chr(10) || 'AI: ' || o) AS block_chars FROM r WHERE len(reasons) = 0")
def block_index(spark, d):
    b = _blocks(spark, d).where(F.size(SM.block_reasons(F.col("i"), F.col("n"), F.col("o"))) == 0)
    block = SM.render_block(F.col("i"), F.col("n"), F.col("o"))
    return b.select("conv_id", "turn", F.sha2(block, 256).alias("block_sha256"), F.length(block).cast("long").alias("block_chars"))


# splits

SEED = "s1"
UNIFORM = "CAST(('0x' || substr(sha256('s1|' || doc_id), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"


@query(f"SELECT doc_id, {UNIFORM} AS u, CASE WHEN {UNIFORM} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM documents")
def hash_split(spark, d):
    u = windows.uniform(SEED, F.col("doc_id"))
    return docs(spark, d).select("doc_id", u.alias("u"), F.when(u < 0.1, "validation").otherwise("train").alias("split"))


STRATIFIED = """k AS (SELECT doc_id, source, lang, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY sha256('s1|order|' || doc_id), doc_id) AS r FROM documents),
a AS (SELECT doc_id, source, lang, CASE WHEN n >= 2 AND r <= least(greatest(1, round_even(n * 0.1, 0)), n - 1) THEN 'eval' ELSE 'train' END AS split FROM k)"""


@query(f"WITH {STRATIFIED} SELECT doc_id, source, split FROM a")
def stratified_split(spark, d):
    return windows.stratified_split(docs(spark, d).select("doc_id", "source"), "doc_id", "source", 0.1, SEED)


@query(f"WITH {STRATIFIED} SELECT split, source, lang, count(*) AS n FROM a GROUP BY GROUPING SETS ((split), (split, source), (split, lang))")
def split_stats(spark, d):
    a = windows.stratified_split(docs(spark, d).select("doc_id", "source", "lang"), "doc_id", "source", 0.1, SEED)
    return a.groupingSets([["split"], ["split", "source"], ["split", "lang"]], "split", "source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {STRATIFIED}, p AS (SELECT source, doc_id, split, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {reports.PIECE_ROWS} AS piece FROM a),
h AS (SELECT source, piece, sha256(string_agg(doc_id || chr(9) || split, chr(10) ORDER BY doc_id)) AS digest, count(*) AS c FROM p GROUP BY source, piece)
SELECT source, sha256(string_agg(digest, chr(10) ORDER BY piece)) AS checksum, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY source"""
)
def assignment_checksum(spark, d):
    """Checksum of each source's assignments in order, from the digests of pieces."""
    a = windows.stratified_split(docs(spark, d).select("doc_id", "source"), "doc_id", "source", 0.1, SEED)
    return reports.piecewise_checksum(a, "source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\t"), "split"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS row_number FROM documents")
def global_row_numbers(spark, d):
    return windows.numbered(docs(spark, d).select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "row_number")


# classifiers

F_TEXT = Q.fold("text")
PLAIN = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
ASK = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])([0-9]+|{'|'.join(C.NUMERALS)})\s*mondat"
_S = Q.strip("coalesce(text, '')")
_J = f"array_to_string({Q.words(PLAIN.format(f'lower({_S})'))}, ' ')"
_N = f"len({Q.words(PLAIN.format(f'lower({_S})'))})"


@query(
    f"""SELECT role, intent, count(*) AS n FROM (SELECT role, CASE WHEN {_S} = '' THEN 'general_chat' WHEN starts_with({_S}, '/') THEN 'command' WHEN {Q.match(_S, ASK)} THEN 'sentence_request'
WHEN {_N} <= 2 AND {Q.any_of(_J, C.GOODBYES)} THEN 'goodbye' WHEN {_N} <= 2 AND {Q.any_of(_J, C.GREETINGS)} THEN 'greeting' ELSE 'general_chat' END AS intent FROM conversations) GROUP BY role, intent"""
)
def intent_counts(spark, d):
    return chats(spark, d).groupBy("role", C.intent(F.col("text")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


_W = Q.words(PLAIN.format(F_TEXT))


@query(
    f"""SELECT conv_id, turn, CASE WHEN {' OR '.join(Q.all_of(F_TEXT, g) for g in C.BACK_REFERENCES)} THEN 'explicit_backreference'
WHEN len({_W}) BETWEEN 1 AND 5 AND len(list_intersect(list_distinct({_W}), [{Q.listed(C.DEICTIC_WORDS)}])) > 0 THEN 'short_deictic_followup' END AS reason FROM conversations"""
)
def followup_flags(spark, d):
    return chats(spark, d).select("conv_id", "turn", C.follow_up(F.col("text")).alias("reason"))


_P = f"trim(regexp_replace({PLAIN.format(F_TEXT)}, '\\s+', ' ', 'g'))"


@query(
    f"""SELECT response_type, count(*) AS n FROM (SELECT CASE WHEN {F_TEXT} = '' THEN 'casual_chat' ELSE coalesce({Q.first_group(_P, C.RESPONSE_TYPES)},
CASE WHEN {Q.any_of(_P, C.CASUAL_HINTS)} THEN 'casual_chat' END, CASE WHEN len({Q.words(_P)}) <= 4 THEN 'short_answer' ELSE 'casual_chat' END) END AS response_type FROM conversations) GROUP BY 1"""
)
def response_types(spark, d):
    return dealt(chats(spark, d).select("text")).groupBy(C.response_type(F.col("text")).alias("response_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT conv_id, turn, {Q.first_group(F_TEXT, C.GUARD_CATEGORIES)} AS guard_category, {Q.first_group(F_TEXT, C.MEMORY_CANDIDATES)} AS memory_category FROM conversations")
def message_categories(spark, d):
    return chats(spark, d).select("conv_id", "turn", C.guard_category(F.col("text")).alias("guard_category"), C.memory_candidate(F.col("text")).alias("memory_category"))


@query(f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INTEGER) AS longest FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents)")
def sentence_stats(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


@query(f"SELECT conv_id, turn, {Q.penalised('f', S.REPLY_PENALTIES)} AS score, array_to_string(f, ',') AS flags FROM (SELECT conv_id, turn, {Q.reply_flags('text')} AS f FROM conversations WHERE role = 'assistant')")
def reply_eval(spark, d):
    f = chats(spark, d).where("role = 'assistant'").select("conv_id", "turn", S.reply_flags(F.col("text")).alias("f"))
    return f.select("conv_id", "turn", S.penalised(F.col("f"), S.REPLY_PENALTIES).alias("score"), F.array_join("f", ",").alias("flags"))


# retrieval


def _records(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("record_id"), "text")


def _questions(spark, d):
    return chats(spark, d).where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


_LONG = lambda x: f"list_filter({Q.words(Q.fold(x))}, lambda w: length(w) >= 3)"
TOPK = f"""q AS (SELECT query_id, unnest(w) AS qw, generate_subscripts(w, 1) AS i FROM (SELECT conv_id * 1000 + turn AS query_id, {_LONG('text')} AS w FROM conversations WHERE role = 'user')),
r AS (SELECT DISTINCT item_id AS record_id, unnest({_LONG('text')}) AS rw FROM benchmark),
m AS (SELECT DISTINCT query_id, i, record_id FROM q JOIN r ON left(qw, 3) = left(rw, 3) AND left(qw, least(4, length(qw), length(rw))) = left(rw, least(4, length(qw), length(rw)))),
k AS (SELECT query_id, record_id, count(*) AS overlap FROM m GROUP BY query_id, record_id),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, record_id) AS INTEGER) AS rank, record_id, overlap FROM k)"""


@query(f"WITH {TOPK} SELECT query_id, rank, record_id, overlap FROM t WHERE rank <= 5")
def knowledge_topk(spark, d):
    return retrieval.search(_questions(spark, d), _records(spark, d))


@query(
    f"""WITH {TOPK}, f AS (SELECT query_id, rank, {Q.trim_to('text', 60)} AS fact FROM t JOIN benchmark ON record_id = item_id WHERE rank <= 5),
j AS (SELECT query_id, string_agg(fact, '; ' ORDER BY rank) AS c FROM f WHERE fact <> '' GROUP BY query_id) SELECT query_id, {Q.trim_to('c', 220)} AS context FROM j"""
)
def context_block(spark, d):
    r = _records(spark, d)
    return retrieval.context_block(retrieval.search(_questions(spark, d), r), r)


@query(
    f"""WITH s AS (SELECT doc_id AS id, unnest({Q.sentences('text')}) AS s FROM documents), k AS (SELECT DISTINCT unnest({Q.sentences('text')}) AS line FROM benchmark)
SELECT id, count(*) AS sentences, count(line) AS copied, CAST(count(line) AS DOUBLE) / count(*) AS ratio FROM s LEFT JOIN k ON s.s = k.line GROUP BY id"""
)
def benchmark_contamination(spark, d):
    lines = table(spark, d, "benchmark").select(F.explode(T.sentences(F.col("text"))).alias("line"))
    return retrieval.copy_ratio(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), lines)


# similarity and groups


_ALPHABET = ", ".join(f"'{x}'" for x in T.COUNTED)


@query(
    f"""WITH c AS (SELECT text, min(doc_id) AS id FROM documents WHERE text <> '' GROUP BY text),
k AS (SELECT id, length(text) AS n, list_append(list_transform([{_ALPHABET}], lambda x: length(lower(text)) - length(replace(lower(text), x, ''))), length(translate(lower(text), '{T.COUNTED}', ''))) AS v FROM c)
SELECT a.id AS a_id, b.id AS b_id FROM k a JOIN k b ON a.id < b.id AND 2.0 * least(a.n, b.n) >= 0.9 * (a.n + b.n)
WHERE 2.0 * list_sum(list_transform(list_zip(a.v, b.v), lambda z: least(z[1], z[2]))) >= 0.9 * (a.n + b.n)"""
)
def near_dup_candidates(spark, d):
    """Pairs of different texts whose lengths and letters allow a ratio of 0.9; all texts, whole."""
    c = docs(spark, d).groupBy("text").agg(F.min("doc_id").alias("id"))
    return similarity.bounded_pairs(c, c, 0.9)


@query()
def near_dup_candidates_all(spark, d):
    """Of these candidates, those with a common subsequence that is long enough; too slow for SQL on whole tables."""
    c = docs(spark, d).groupBy("text").agg(F.min("doc_id").alias("id"))
    return text_pairs.close_pairs(c, c, 0.9).select("a_id", "b_id")


@query()
def near_dup_pairs(spark, d):
    return similarity.near_duplicates(docs(spark, d).select(F.col("doc_id").alias("id"), "text"))


def _overlaps(messages: str) -> str:
    """Conversation classes of a table m (conv_id, turn, role, t), and the pairs that share moved messages."""
    return f"""WITH m AS ({messages}),
w AS (SELECT conv_id, list([role, t] ORDER BY turn) AS h, count(*) AS n FROM m GROUP BY conv_id),
f AS (SELECT min(conv_id) AS conv_id, any_value(n) AS n FROM w GROUP BY h),
p AS (SELECT x.conv_id AS a, y.conv_id AS b, count(*) AS shared, count(*) FILTER (x.turn = y.turn AND x.role = y.role) AS same_pos,
count(*) FILTER (x.role <> y.role) AS cross_role, count(*) FILTER (x.role = y.role AND x.turn <> y.turn) AS moved
FROM m x JOIN m y ON x.t = y.t AND x.conv_id < y.conv_id WHERE length(x.t) >= 20 GROUP BY 1, 2)
SELECT a, b, shared, same_pos, cross_role, moved, CASE WHEN cross_role >= moved THEN 'roles_swapped_messages' ELSE 'messages_reordered' END AS type
FROM p JOIN f fa ON fa.conv_id = a JOIN f fb ON fb.conv_id = b
WHERE shared >= greatest(2, (3 * least(fa.n, fb.n) + 4) // 5) AND cross_role + moved >= greatest(2, (shared + 3) // 4)"""


_MOVED = _overlaps(f"SELECT conv_id, turn, coalesce(role, '') AS role, {Q.normalise('text')} AS t FROM conversations")


_STEMS = f"""w AS (SELECT conv_id, {Q.words(Q.normalise('text'))} AS w FROM conversations),
st AS (SELECT DISTINCT conv_id, CASE WHEN regexp_matches(x, '^\\p{{Nd}}+$') THEN x ELSE left(x, 4) END AS s FROM (SELECT conv_id, unnest(w) AS x FROM w)
 WHERE (length(x) >= 4 AND x NOT IN ({Q.listed(T.CONTENT_STOP)}))  OR regexp_matches(x, '^\\p{{Nd}}+$')
 UNION SELECT DISTINCT conv_id, left(x, 4) FROM (SELECT conv_id, unnest(w) AS x FROM w) WHERE length(x) >= 4 AND x NOT IN ({Q.listed(T.CONTENT_STOP)})),
sz AS (SELECT conv_id, count(*) AS n FROM st GROUP BY conv_id HAVING count(*) >= 15),
jo AS (SELECT x.conv_id AS a, y.conv_id AS b, count(*) AS c FROM st x JOIN st y ON x.s = y.s AND x.conv_id < y.conv_id GROUP BY 1, 2)"""


@query(
    f"""WITH {_STEMS}, ch AS (SELECT conv_id, min(conv_id) OVER (PARTITION BY h) AS class_id FROM (SELECT conv_id, list([coalesce(role, ''), {Q.normalise('text')}] ORDER BY turn) AS h FROM conversations GROUP BY conv_id)),
li AS (SELECT a, b FROM ({_MOVED}))
SELECT a, b, CAST(c AS DOUBLE) / (p.n + q.n - c) AS jaccard FROM jo JOIN sz p ON a = p.conv_id JOIN sz q ON b = q.conv_id
WHERE CAST(c AS DOUBLE) / (p.n + q.n - c) >= 0.35 AND a IN (SELECT class_id FROM ch) AND b IN (SELECT class_id FROM ch) AND NOT EXISTS (SELECT 1 FROM li WHERE li.a = jo.a AND li.b = jo.b)"""
)
def unlinked_paraphrases(spark, d):
    """Paraphrases between classes of conversations that neither copies nor moved messages link already."""
    m = chats(spark, d)
    classes = similarity.conversation_classes(m)
    return typed_links.unlinked(typed_links.paraphrases(m, classes), similarity.message_overlap(m), classes)


@query(f"WITH {_STEMS} SELECT a, b, CAST(c AS DOUBLE) / (p.n + q.n - c) AS jaccard FROM jo JOIN sz p ON a = p.conv_id JOIN sz q ON b = q.conv_id WHERE CAST(c AS DOUBLE) / (p.n + q.n - c) >= 0.35")
def paraphrase_pairs(spark, d):
    return similarity.stem_jaccard(chats(spark, d).select(F.col("conv_id").alias("id"), "text"))


@query(_overlaps(f"SELECT conv_id, turn, coalesce(role, '') AS role, {Q.normalise('text')} AS t FROM conversations"))
def message_overlap(spark, d):
    return similarity.message_overlap(chats(spark, d))


_SENTENCES = f"SELECT conv_id, i - 1 AS turn, CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, {Q.normalise('s')} AS t FROM (SELECT doc_id AS conv_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents))"


@query(_overlaps(_SENTENCES))
def sentence_overlap(spark, d):
    """Documents that share sentences in other places: the message overlap on a table where copies have been cut and moved."""
    return similarity.sentence_overlap(dealt(_whole(spark, d))).drop("fewest")


@query(
    f"""WITH w AS (SELECT conv_id, list([coalesce(role, ''), {Q.normalise('text')}] ORDER BY turn) AS h FROM conversations GROUP BY conv_id)
SELECT conv_id, min(conv_id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS class_size FROM w"""
)
def conversation_classes(spark, d):
    return similarity.conversation_classes(chats(spark, d))


@query()
def near_conversations(spark, d):
    return similarity.near_conversations(chats(spark, d))


def _samples(spark, d):
    s = SM.samples(chats(spark, d))
    return s.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("owner"), "question", "answer", "context")


@query()
def sample_findings(spark, d):
    return similarity.sample_findings(_samples(spark, d))


@query()
def shared_answers(spark, d):
    return similarity.shared_answers(_samples(spark, d))


BANK = {"approved": ["And", "The"], "blocked_given": ["Er"], "surname": ["Ist"], "allowed": []}


@query()
def masked_findings(spark, d):
    """Sample findings that only texts with masked names show."""
    known, plain = names.forms(spark, BANK), _samples(spark, d)
    masked, named = plain, None
    for c in ("question", "answer", "context"):
        m = names.mask(plain, known, "id", c).toDF("id", f"{c}_masked", f"{c}_has")
        masked = masked.join(m, "id").drop(c).withColumnRenamed(f"{c}_masked", c)
    named = masked.where("question_has OR answer_has").select("id")
    return similarity.masked_findings(plain, masked.select(plain.columns), named, similarity.sample_findings(plain))


_FORMS = ", ".join(f"({Q.lit(f)}, {Q.lit(k)}, {Q.lit(n)})" for f, (k, n) in names.inflected(BANK).items())
_GIVEN = "coalesce({} IN ('approved', 'blocked_given'), false)"
NAMED = f"""l AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(coalesce(text, ''), '\\p{{L}}+|[^\\p{{L}}]+') AS l FROM conversations),
p AS (SELECT *, length(piece) >= 2 AND regexp_matches(piece, '^\\p{{Lu}}') AND upper(piece) <> piece AS capital FROM (SELECT id, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS place FROM l)),
k AS (SELECT p.*, kind, name FROM p LEFT JOIN (VALUES {_FORMS}) b(form, kind, name) ON capital AND piece = form),
w AS (SELECT *, lead(piece, 1) OVER o AS gap, lead(piece, 2) OVER o AS next, lead(kind, 2) OVER o AS next_kind, coalesce(lead(capital, 2) OVER o, false) AS next_capital, lag(piece) OVER o AS before FROM k WINDOW o AS (PARTITION BY id ORDER BY place)),
v AS (SELECT *, before IS NULL OR regexp_matches(regexp_replace(before, '[{Q.WS}]+$', ''), '[.!?…:;„"”“(»«–—-]$') OR (place = 1 AND {Q.strip('before')} = '') AS initial FROM w)"""


@query(
    f"""WITH {NAMED} SELECT id, 'error' AS severity, 'name_not_declared' AS code, piece AS token FROM v WHERE kind = 'approved' AND name <> 'And'
UNION ALL SELECT id, 'error', 'name_not_approved', piece FROM v WHERE kind = 'blocked_given'
UNION ALL SELECT id, 'warning', 'capitalized_token_review', piece FROM v WHERE capital AND kind IS NULL AND NOT initial
UNION ALL SELECT id, 'error', 'full_name_pattern', piece || ' ' || next FROM v WHERE gap = ' ' AND next_capital
 AND (({_GIVEN.format('kind')} AND coalesce(next_kind = 'surname', false)) OR (coalesce(kind = 'surname', false) AND {_GIVEN.format('next_kind')}))"""
)
def name_issues(spark, d):
    known = names.forms(spark, BANK)
    m = chats(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.array(F.lit("And")).alias("declared"))
    return names.name_issues(m, known)


def _whole(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("id"), "text")


def _links(spark, d, overlaps=None):
    """Links over whole documents that SQL can say too: equal texts, and overlaps of sentences in other places."""
    exact = similarity.exact_duplicates(_whole(spark, d)).select(F.col("id").alias("a"), F.col("kept_id").alias("b"))
    return exact.union((overlaps or typed_links.overlap_links(_whole(spark, d))).select("a", "b"))


GROUPS = f"""ov AS MATERIALIZED (SELECT a, b FROM ({_overlaps(_SENTENCES)})),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY text) AS b FROM documents WHERE text IS NOT NULL UNION SELECT a, b FROM ov),
f AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
c(n, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT f.b, c.m FROM c JOIN f ON c.n = f.a),
g AS (SELECT n AS doc_id, min(m) AS root FROM c GROUP BY n)"""


@query(f"WITH RECURSIVE {GROUPS} SELECT doc_id, 'group_' || root AS group_id FROM g")
def similarity_groups(spark, d):
    return grouping.groups(docs(spark, d).select("doc_id"), _links(spark, d), "doc_id")


@query(f"WITH RECURSIVE {GROUPS}, s AS (SELECT root, count(*) AS n FROM g GROUP BY root) SELECT n AS size, count(*) AS n_groups FROM s GROUP BY n")
def group_size_histogram(spark, d):
    g = grouping.groups(docs(spark, d).select("doc_id"), _links(spark, d), "doc_id").groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return g.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


@query(
    f"""WITH RECURSIVE {GROUPS}, b AS (SELECT DISTINCT root FROM g JOIN labels USING (doc_id) WHERE toxic = 1), l AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT g.doc_id, 'group_' || g.root AS group_id, concat_ws(',', CASE WHEN b.root IS NOT NULL THEN 'blocked_unit' END, CASE WHEN l.doc_id IS NOT NULL THEN 'listed' END) AS reasons
FROM g LEFT JOIN b ON g.root = b.root LEFT JOIN l ON g.doc_id = l.doc_id"""
)
def held_back_records(spark, d):
    g = grouping.groups(docs(spark, d).select("doc_id"), _links(spark, d), "doc_id")
    out = grouping.held_back(g, table(spark, d, "labels").where("toxic = 1"), _listed(spark, d), "doc_id")
    return out.select("doc_id", "group_id", F.array_join("reasons", ",").alias("reasons"))


def _all_groups(spark, d):
    """Groups of documents over all links of whole texts: exact, near and overlap. Their forest gives the same groups."""
    return grouping.groups(docs(spark, d).select("doc_id"), typed_links.text_links(_whole(spark, d)), "doc_id")


def _forest(spark, d):
    return typed_links.spanning_forest(typed_links.text_links(_whole(spark, d)))


@query()
def link_forest(spark, d):
    """The strongest links that hold the groups of documents together, with their kinds."""
    return _forest(spark, d)


@query()
def group_split_plan(spark, d):
    return split_plan.assign(_all_groups(spark, d), "group_id")


@query()
def near_duplicate_groups(spark, d):
    """Groups over links that were found on whole texts: copies, near duplicates and overlaps of sentences."""
    return _all_groups(spark, d)


@query()
def stratified_group_split(spark, d):
    """A group-atomic split whose parts have languages and sources in equal shares."""
    g = _all_groups(spark, d).join(docs(spark, d).select("doc_id", "lang", "source"), "doc_id")
    return split_plan.assign(g, "group_id", features=["lang", "source"]).select("doc_id", "group_id", "split")


_SHARES = """r AS (SELECT * FROM (VALUES ('train', 0.8, 0), ('validation', 0.1, 1), ('test', 0.1, 2)) t(split, share, place)),
x AS (SELECT split, place, n * CAST(share AS DOUBLE) AS exact, n FROM r, (SELECT count(*) AS n FROM documents)),
y AS (SELECT split, CAST(floor(exact) AS BIGINT) AS low, row_number() OVER (ORDER BY floor(exact) - exact, place) AS k, n - sum(CAST(floor(exact) AS BIGINT)) OVER () AS missing FROM x)"""


@query(f"WITH {_SHARES} SELECT split, low + CASE WHEN k <= missing THEN 1 ELSE 0 END AS n FROM y")
def group_split_counts(spark, d):
    """Records of each part of the group-atomic split: the ideal counts, by largest remainders."""
    g = grouping.groups(docs(spark, d).select("doc_id"), _links(spark, d), "doc_id")
    return split_plan.assign(g, "group_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_VERIFIED = f"""r AS (SELECT doc_id, sha256(coalesce(text, '')) AS unit, {UNIFORM} AS u FROM documents),
h AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
a0 AS (SELECT r.doc_id, CASE WHEN t.doc_id IS NULL THEN unit ELSE 'moved' END AS unit, CASE WHEN u < 0.1 THEN 'validation' WHEN u < 0.2 THEN 'test' WHEN u >= 0.97 THEN 'spare' ELSE 'train' END AS split, u
 FROM r LEFT JOIN t USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM h)),
a AS (SELECT doc_id, unit, split FROM a0 UNION ALL SELECT doc_id, unit, 'train' FROM a0 WHERE u < 0.02 UNION ALL SELECT -1, 'none', 'train')"""


@query(
    f"""WITH {_VERIFIED}
SELECT 'unknown_split' AS "check", count(*) AS failures FROM a WHERE split NOT IN ('train', 'validation', 'test')
UNION ALL SELECT 'unit_in_several_parts', count(*) FROM (SELECT unit FROM a GROUP BY unit HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'record_assigned_twice', count(*) FROM (SELECT doc_id FROM a GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'record_missing', count(*) FROM r WHERE doc_id NOT IN (SELECT doc_id FROM a)
UNION ALL SELECT 'record_unknown', count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM r)
UNION ALL SELECT 'unit_changed', count(*) FROM (SELECT doc_id, unit FROM a EXCEPT ALL SELECT doc_id, unit FROM r)
UNION ALL SELECT 'blocked_assigned', count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM t)
UNION ALL SELECT 'member_of_blocked_unit_assigned', count(*) FROM a WHERE unit IN (SELECT unit FROM r WHERE doc_id IN (SELECT doc_id FROM t))
UNION ALL SELECT 'listed_assigned', count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM h)"""
)
def split_verification(spark, d):
    """Checks of a split that breaks most of them: rows dealt one by one, some twice, some moved, one unknown, those of poor quality missing."""
    u = windows.uniform(SEED, F.col("doc_id"))
    r = docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("unit"))
    poor, toxic = _listed(spark, d).distinct(), table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()
    moved = r.join(poor, "doc_id", "left_anti").join(toxic.withColumn("t", F.lit(True)), "doc_id", "left").withColumn("u", u)
    split = F.when(F.col("u") < 0.1, "validation").when(F.col("u") < 0.2, "test").when(F.col("u") >= 0.97, "spare").otherwise("train")
    a0 = moved.select("doc_id", F.when(F.col("t").isNull(), F.col("unit")).otherwise("moved").alias("unit"), split.alias("split"), "u")
    one = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("none").alias("unit"), F.lit("train").alias("split"))
    a = a0.drop("u").union(a0.where("u < 0.02").select("doc_id", "unit", F.lit("train"))).union(one)
    return split_plan.verify(r, a, "doc_id", "unit", blocked=toxic, listed=poor)


# loader


@query("SELECT ch, CAST(row_number() OVER (ORDER BY ch) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM conversations) WHERE ch <> ''")
def char_vocab(spark, d):
    return SM.char_vocabulary(chats(spark, d), "text")


@query(
    """WITH v AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM conversations),
c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')
SELECT doc_id, count(*) AS n_chars, count(*) FILTER (ch NOT IN (SELECT ch FROM v)) AS n_unknown FROM c GROUP BY doc_id"""
)
def unknown_chars(spark, d):
    vocabulary = SM.char_vocabulary(chats(spark, d), "text").agg(F.map_from_entries(F.collect_list(F.struct("ch", "id"))).alias("v"))
    known = F.broadcast(vocabulary.select(F.map_keys("v").alias("known"), F.lit(1).alias("k")))  # Unicode's size at most
    x = docs(spark, d).where("text <> ''").select("doc_id", "text", F.lit(1).alias("k")).join(known, "k")
    left = F.length(F.call_function("translate", "text", F.array_join("known", ""), F.lit("")))
    return x.select("doc_id", F.length("text").cast("long").alias("n_chars"), left.cast("long").alias("n_unknown"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(length(text) * 20 AS BIGINT) AS bytes, length(text) > 64 AS beyond_context, CASE WHEN length(text) > 4096 THEN 'too_long' WHEN length(text) < 2 THEN 'too_short' END AS withheld FROM documents")
def encoded_lengths(spark, d):
    n = F.length("text").cast("long")
    return docs(spark, d).select("doc_id", n.alias("n"), (n * SM.BYTES_PER_CHAR).alias("bytes"), (n > SM.CONTEXT).alias("beyond_context"), SM.length_class(n).alias("withheld"))


@query(
    """WITH r AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT CAST(max(n) AS BIGINT) AS n, CAST(min(v) AS BIGINT) AS min, CAST(max(v) AS BIGINT) AS max, CAST(sum(v) AS DOUBLE) / count(*) AS mean, CAST(median(v) AS DOUBLE) AS median,
CAST(min(v) FILTER (i = floor(0.9 * (n - 1))) AS BIGINT) AS p90, CAST(min(v) FILTER (i = floor(0.99 * (n - 1))) AS BIGINT) AS p99 FROM r"""
)
def length_percentiles(spark, d):
    return SM.floor_rank_percentiles(docs(spark, d).select(F.length("text").alias("n")), "n")


@query(
    """WITH r AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch, length(text) AS n FROM documents)
SELECT batch, count(*) AS rows, CAST(max(n) AS BIGINT) AS padded_to, CAST(max(n) * count(*) - sum(n) AS BIGINT) AS padding FROM r GROUP BY batch"""
)
def batch_padding(spark, d):
    return SM.batches(docs(spark, d).select("doc_id", F.length("text").alias("n")), ["doc_id"], "n", 16)


@query(f"WITH {SAMPLES} SELECT conv_id, turn, CAST(length(question) + length(answer) + 11 AS INTEGER) AS n, CAST(length(answer) AS INTEGER) AS ones FROM s WHERE length(question) + length(answer) > 0")
def target_masks(spark, d):
    s = SM.samples(chats(spark, d)).where(F.length("question") + F.length("answer") > 0)
    n = F.length("question") + F.length("answer") + 11
    mask = SM.target_mask(n, n - F.length("answer"), n)
    return s.select("conv_id", "turn", n.alias("n"), SM.mask_sum(mask).alias("ones"))


# pages

_TAGLESS = lambda x: Q.strip(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '[{Q.WS}]+', ' ', 'g')")


@query(f"SELECT page_id, nullif(substr({_TAGLESS('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, 1, 120), '') AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", D.page_title(F.col("html")).alias("title"))


@query(
    f"""SELECT page_id, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda h: {_TAGLESS('h')}), lambda h: h <> '')[1:5], lambda h: substr(h, 1, 80)), ' / ') AS headings FROM pages"""
)
def page_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(D.page_headings(F.col("html")), " / ").alias("headings"))


@query(f"SELECT page_id, array_to_string({Q.flags([(k, Q.match('html', p)) for k, p in D.FEATURES.items()])}, ',') AS features FROM pages")
def html_features(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(D.page_features(F.col("html")), ",").alias("features"))


@query("SELECT domain, count(*) AS n FROM (SELECT regexp_replace(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') AS domain FROM pages) GROUP BY domain")
def url_domains(spark, d):
    return table(spark, d, "pages").groupBy(D.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(len(u) AS INTEGER) AS n_urls, array_to_string(list_sort(u), ' ') AS urls FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)https?://[^\\s<>\"'']+'), lambda x: regexp_replace(x, '[.,;:!?)]+$', ''))) AS u FROM documents)")
def document_urls(spark, d):
    u = D.urls(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(u).alias("n_urls"), F.array_join(F.sort_array(u), " ").alias("urls"))


@query()
def page_texts(spark, d):
    return table(spark, d, "pages").select("page_id", D.page_text(F.col("html")).alias("text"))


@query()
def page_summaries(spark, d):
    p = table(spark, d, "pages").withColumn("body", D.page_text(F.col("html")))
    return p.select("page_id", D.source_summary(F.col("url"), F.col("html"), F.col("body")).alias("s")).select("page_id", "s.*")


_LETTER = "a-zA-ZáéíóöőúüűÁÉÍÓÖŐÚÜŰ"
_PIECES = f"regexp_extract_all(x, '[^{Q.WS}]+|[{Q.WS}]+')"
_SURE = "MAP {" + ", ".join(f"{Q.lit(w)}: {p}::DOUBLE" for w, (_, p) in D.TYPOS.items()) + "}"
_UNSAFE = r"[0-9@/\\\\_<>{}\[\]=;#]|https?:|www\."
_UNITS = lambda k: f"regexp_extract_all(t, '([^\\s{D.MARKS}]*)((?:\\s*[{D.MARKS}])*)(\\s*)', {k})"
TIDIED = f"""r AS (SELECT conv_id, turn, text AS x, {Q.strip("coalesce(text, '')")} AS t FROM conversations WHERE role = 'assistant'),
u AS (SELECT *, list_zip({_UNITS(1)}, {_UNITS(2)}, {_UNITS(3)}, list_prepend('.', {_UNITS(2)})) AS z FROM r),
j AS (SELECT conv_id, turn, x, t, {Q.strip("""array_to_string(list_transform(list_filter(z, lambda e: e[1] IS NOT NULL AND (e[1] <> '' OR e[2] <> '')), lambda e:
 (CASE WHEN regexp_matches(e[4], '[.!?]\\s*$') AND regexp_matches(e[1], '^[a-záéíóöőúüű]') THEN upper(e[1][1]) || e[1][2:] ELSE e[1] END)
 || array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(e[2], '\\s', '', 'g'), '!+', '!', 'g'), '\\?+', '?', 'g'), '\\.+|[^.]'), lambda m: CASE WHEN m = '..' THEN '.' ELSE m END), '')
 || (CASE WHEN e[3] <> '' THEN regexp_replace(e[3], '[ \\t]+', ' ', 'g') WHEN e[2] <> '' THEN ' ' ELSE '' END)), '')""")} AS o FROM u),
d AS (SELECT *, CASE WHEN t = '' OR regexp_matches(o, '[.!?…]$') THEN o ELSE o || '.' END AS tidy FROM j),
n AS (SELECT *, {Q.sentences('tidy')} AS s FROM d),
f AS (SELECT *, list_filter(s, lambda y, i: list_position(list_transform(s, lambda q: lower(q)), lower(y)) = i) AS kept FROM n),
h AS (SELECT *, regexp_matches(coalesce(x, ''), '[(){{}}\\[\\];]|==|!=|->|=>|::') OR t = '' AS code,
 list_filter(list_transform({_PIECES}, lambda w: CASE WHEN NOT regexp_matches(w, '{_UNSAFE}') THEN {_SURE}[regexp_replace(w, '^[^{_LETTER}]+|[^{_LETTER}]+$', '', 'g')] END), lambda v: v IS NOT NULL) AS hits FROM f)"""


@query(
    f"""WITH {TIDIED} SELECT conv_id, turn, CASE WHEN len(kept) = len(s) THEN tidy ELSE array_to_string(kept, ' ') END AS text,
CASE WHEN code THEN 1.0::DOUBLE ELSE coalesce(list_min(hits), 1.0::DOUBLE) END AS confidence, CAST(CASE WHEN code THEN 0 ELSE len(hits) END AS INTEGER) AS n_typos FROM h"""
)
def tidied_replies(spark, d):
    t = dealt(chats(spark, d).where("role = 'assistant'").select("conv_id", "turn", "text")).select("conv_id", "turn", D.tidy(F.col("text")).alias("text"), D.typo_hits(F.col("text")).alias("h"))
    return t.select("conv_id", "turn", D.drop_repeated_sentences(F.col("text")).alias("text"), *D.typo_counts(F.col("h")))


# state and events


_PLAIN_WORDS = Q.words(PLAIN.format(F_TEXT))
_FOLLOWS = f"({' OR '.join(Q.all_of(F_TEXT, g) for g in C.CONTEXT_REFERENCES)} OR (len({_PLAIN_WORDS}) BETWEEN 1 AND 5 AND len(list_intersect(list_distinct({_PLAIN_WORDS}), [{Q.listed(C.DEICTIC_WORDS)}])) > 0))"
# conversations of the sample tables are too short for a question to be put out and asked again
STATE = f"""m AS (SELECT conv_id, turn, role, {Q.trim_to('text', state.FIELD)} AS field, {Q.strip("coalesce(text, '')")} AS s, {F_TEXT} AS f, {_FOLLOWS} AS follows FROM conversations),
k AS (SELECT *, role = 'user' AND NOT follows AND s <> '' AS new_topic, role = 'user' AND {Q.any_of('f', state.GOALS)} AS goal, role = 'user' AND {Q.any_of('f', state.CLOSURES)} AS closes,
 role = 'user' AND ends_with(s, '?') AS asks, role = 'user' AND {Q.any_of('f', state.TASKS)} AS task, role = 'assistant' AND s <> '' AS decides FROM m),
c AS (SELECT conv_id, max(turn) AS turn, arg_max(field, turn) FILTER (new_topic) AS topic, arg_max(field, turn) FILTER (goal) AS goal, arg_max(field, turn) FILTER (decides) AS decision, coalesce(max(turn) FILTER (closes), -1) AS closed FROM k GROUP BY conv_id),
q AS (SELECT conv_id, list(field ORDER BY first)[-3:] AS v FROM (SELECT k.conv_id, field, min(k.turn) AS first FROM k JOIN c USING (conv_id) WHERE asks AND k.turn > closed GROUP BY 1, 2) GROUP BY conv_id),
w AS (SELECT conv_id, list(field ORDER BY first)[-3:] AS v FROM (SELECT k.conv_id, field, min(k.turn) AS first FROM k JOIN c USING (conv_id) WHERE task AND k.turn > closed GROUP BY 1, 2) GROUP BY conv_id)"""


@query(
    f"""WITH {STATE} SELECT c.conv_id, c.turn, c.topic, c.goal, coalesce(array_to_string(q.v, ' | '), '') AS questions, coalesce(array_to_string(w.v, ' | '), '') AS tasks, c.decision
FROM c LEFT JOIN q USING (conv_id) LEFT JOIN w USING (conv_id)"""
)
def conv_state(spark, d):
    return state.conversation_state(chats(spark, d))


@query(
    """SELECT conv_id, turn, string_agg(text, ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS history FROM conversations"""
)
def last_two_exchanges(spark, d):
    w = SM.by_turn().rowsBetween(-4, -1)
    h = F.collect_list("text").over(w)
    return chats(spark, d).select("conv_id", "turn", F.when(F.size(h) > 0, F.array_join(h, " / ")).alias("history"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return state.tumbling(table(spark, d, "events"))


@query("SELECT window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS window_start FROM events) GROUP BY 1")
def events_sliding(spark, d):
    return state.sliding(table(spark, d, "events"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_sessions(spark, d):
    return state.sessions(table(spark, d, "events"))


# records, reports and guards

_PROP_KEYS = ("device", "page")


@query(
    """WITH k AS (SELECT event_id, json_keys(props) AS k FROM events),
i AS (SELECT event_id, list_concat(list_transform(list_sort(list_filter(k, lambda x: x NOT IN ('device', 'page'))), lambda x: 'unknown_field:' || x),
 list_transform(list_filter(['device', 'page'], lambda x: NOT list_contains(k, x)), lambda x: 'missing_field:' || x)) AS issues FROM k)
SELECT event_id, array_to_string(issues, ',') AS issues FROM i WHERE len(issues) > 0"""
)
def record_field_issues(spark, d):
    """Unknown and missing keys of the events' properties."""
    e = table(spark, d, "events").select("event_id", records.field_issues(F.col("props"), _PROP_KEYS).alias("i"))
    return e.where(F.size("i") > 0).select("event_id", F.array_join("i", ",").alias("issues"))


_EXACT = "SELECT doc_id AS b, first AS a FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first"
FINDINGS = f"""ox AS MATERIALIZED (SELECT a, b FROM ({_overlaps(_SENTENCES)})),
fi AS (SELECT a, b, 'exact_text' AS type, 'reject' AS status FROM ({_EXACT})
UNION ALL SELECT a, b, 'sentence_overlap', CASE WHEN b % 3 = 0 THEN 'info' ELSE 'review' END FROM ox)"""


def _findings(spark, d, overlaps=None):
    """Findings of documents: copies, and texts that share sentences in other places (a third of them information)."""
    exact = similarity.exact_duplicates(_whole(spark, d).where("text IS NOT NULL")).select(F.col("kept_id").alias("a"), F.col("id").alias("b"))
    other = (overlaps or typed_links.overlap_links(_whole(spark, d))).select("a", "b", F.lit("sentence_overlap").alias("type"), F.when(F.col("b") % 3 == 0, "info").otherwise("review").alias("status"))
    return exact.select("a", "b", F.lit("exact_text").alias("type"), F.lit("reject").alias("status")).union(other)


@query(
    f"""WITH {FINDINGS}, o AS (SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'reject' THEN 0 WHEN 'review' THEN 1 ELSE 3 END, type, a, b) AS n FROM fi)
SELECT a, b, type, status, 'f' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS finding_id FROM o"""
)
def finding_ids(spark, d):
    return reports.number_findings(_findings(spark, d), ["type", "a", "b"])


@query(
    f"""WITH {FINDINGS}, e AS (SELECT unnest([a, b]) AS doc_id FROM fi WHERE status IN ('reject', 'review')), c AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN 'clear_of_duplicate_findings' ELSE 'blocked' END AS progression, coalesce(n, 0) AS n_blocking FROM documents LEFT JOIN c USING (doc_id)"""
)
def record_states(spark, d):
    return reports.record_states(docs(spark, d), _findings(spark, d), "doc_id")


@query(f"WITH {FINDINGS} SELECT status, type, count(*) AS n FROM fi GROUP BY GROUPING SETS ((status, type), (status), ())")
def findings_summary(spark, d):
    return reports.findings_summary(_findings(spark, d))


@query(
    f"""WITH RECURSIVE {GROUPS}, {FINDINGS}, s AS (SELECT root, count(*) AS n FROM g GROUP BY root), e AS (SELECT DISTINCT unnest([a, b]) AS doc_id FROM fi WHERE status IN ('reject', 'review')),
x AS (SELECT (SELECT count(*) FROM documents) AS records, (SELECT count(*) FROM fi) AS findings_total, (SELECT count(*) FROM e) AS blocked_records, count(*) AS groups,
 count(*) FILTER (n >= 2) AS groups_with_2_or_more, max(n) AS largest_group, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS in_groups FROM s)
SELECT records, findings_total, blocked_records, records - blocked_records AS clear_records, groups, groups_with_2_or_more, largest_group, in_groups,
round_even(CAST(in_groups AS DOUBLE) / records, 4) AS variant_share, CAST(in_groups AS DOUBLE) / records > {reports.MAX_VARIANT_SHARE} AS variant_share_over_plan FROM x""".replace("e AS (SELECT DISTINCT", "ends AS (SELECT DISTINCT").replace("FROM e) AS blocked", "FROM ends) AS blocked")
)
def dedupe_summary(spark, d):
    overlaps = typed_links.overlap_links(_whole(spark, d))
    g = grouping.groups(docs(spark, d).select("doc_id"), _links(spark, d, overlaps), "doc_id")
    return reports.dedupe_summary(docs(spark, d), _findings(spark, d, overlaps), g, "doc_id")


@query(f"WITH RECURSIVE {GROUPS} SELECT 'group_' || root AS group_id, f AS feature, count(*) AS n FROM (SELECT root, unnest(['lang=' || coalesce(lang, '(none)'), 'source=' || coalesce(source, '(none)')]) AS f FROM g JOIN documents USING (doc_id)) GROUP BY 1, 2")
def unit_features(spark, d):
    g = grouping.groups(docs(spark, d).select("doc_id"), _links(spark, d), "doc_id").join(docs(spark, d).select("doc_id", "lang", "source"), "doc_id")
    return reports.unit_features(g, "group_id", ["lang", "source"])


@query(f"WITH RECURSIVE {GROUPS} SELECT lang || '/' || source AS persona, count(*) AS n, count(DISTINCT root) AS n_groups, count(*) > 3 AS over, count(DISTINCT root) > 1 AS merged FROM g JOIN documents USING (doc_id) WHERE lang || '/' || source IS NOT NULL GROUP BY 1")
def label_limits(spark, d):
    g = grouping.groups(docs(spark, d).select("doc_id"), _links(spark, d), "doc_id").join(docs(spark, d).select("doc_id", F.concat("lang", F.lit("/"), "source").alias("persona")), "doc_id")
    return reports.label_limits(g, "persona")


MERGED = """wp AS (SELECT x.root AS a, y.root AS b FROM labels l JOIN g x ON x.doc_id = l.doc_id JOIN g y ON y.doc_id = l.doc_id + 1 WHERE l.toxic = 1),
we AS (SELECT a, b FROM wp UNION SELECT b, a FROM wp), wc(n, m) AS (SELECT root, root FROM g UNION SELECT we.b, wc.m FROM wc JOIN we ON wc.n = we.a), wg AS (SELECT n AS root, min('group_' || m) AS unit FROM wc GROUP BY n)"""


@query(f"WITH RECURSIVE {GROUPS}, {MERGED} SELECT doc_id, unit FROM g JOIN wg USING (root)")
def merged_units(spark, d):
    """Groups that waived pairs join: here toxic documents and the ones after them."""
    g = grouping.groups(docs(spark, d).select("doc_id"), _links(spark, d), "doc_id")
    pairs = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return reports.merge_units(g, pairs, "doc_id")


_HITS = f"""bl AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest({Q.sentences('text')}) AS s FROM benchmark)), dl AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest({Q.sentences('text')}) AS s FROM documents)),
hi AS (SELECT item_id AS row, doc_id AS record, count(*) AS c FROM bl JOIN dl USING (s) GROUP BY 1, 2),
li AS (SELECT row, record, CASE WHEN c > 1 THEN 'sample_near' ELSE 'same_sentence' END AS type, CASE WHEN c > 1 THEN 'duplicate_like' ELSE 'partial_overlap' END AS strength, x.doc_id AS unit, coalesce(x.split, 'held_back') AS split
 FROM hi LEFT JOIN (SELECT doc_id, CASE WHEN {UNIFORM} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) x ON record = x.doc_id)"""


def _export_links(spark, d):
    # repeats within a row go in the row; of documents only sentences that a benchmark row has are exchanged
    digests = F.array_distinct(F.transform(T.sentences(F.col("text")), lambda s: F.unhex(F.md5(s))))
    lines = lambda t, k: dealt(table(spark, d, t).select(k, "text")).select(k, F.explode(digests).alias("h"))
    hits = lines("documents", "doc_id").join(lines("benchmark", "item_id").distinct(), "h").groupBy(F.col("item_id").alias("row"), F.col("doc_id").alias("record")).agg(F.count_distinct("h").alias("c"))
    assigned = joins.exclude(hash_split(spark, d), _listed(spark, d), "doc_id").withColumn("unit", F.col("doc_id"))
    return reports.export_links(hits.withColumn("type", F.when(F.col("c") > 1, "sample_near").otherwise("same_sentence")), assigned, "doc_id", "unit")


@query(f"WITH {_HITS} SELECT * FROM li")
def export_links(spark, d):
    """Documents that hold sentences of benchmark rows, with their parts; two sentences or more are like a duplicate."""
    return _export_links(spark, d)


@query(
    f"""WITH {_HITS}, q AS (SELECT row, count(*) AS links, list_distinct(list(split) FILTER (strength = 'duplicate_like' AND split <> 'held_back')) AS parts, count(DISTINCT record) FILTER (strength = 'duplicate_like' AND split = 'held_back') AS pending_units FROM li GROUP BY row)
SELECT row, links, CASE WHEN len(parts) = 1 THEN parts[1] END AS required_split, coalesce(len(parts) > 1, false) AS conflict, pending_units FROM q"""
)
def export_required_splits(spark, d):
    return reports.required_splits(_export_links(spark, d))


@query(
    f"""WITH x AS (SELECT {Q.strip('text')} AS t, min(doc_id) AS owner FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND {Q.strip('text')} <> '' GROUP BY 1)
SELECT doc_id, owner, 'text' AS field FROM documents JOIN x ON {Q.strip('text')} = t WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"""
)
def excluded_text_hits(spark, d):
    """Rows that stay although their text is that of an excluded row."""
    out = joins.excluded(docs(spark, d), _listed(spark, d), "doc_id").select(F.col("doc_id").alias("id"), "text")
    return reports.excluded_texts(joins.exclude(docs(spark, d), _listed(spark, d), "doc_id"), out, ["text"], "doc_id")


@query("SELECT 'documents' AS corpus, CAST(doc_id AS VARCHAR) AS id, sha256(text) AS text_sha256 FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), sha256(text) FROM benchmark UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), sha256(html) FROM pages")
def corpora_concatenated(spark, d):
    parts = {"documents": ("doc_id", "text"), "benchmark": ("item_id", "text"), "pages": ("page_id", "html")}
    return reports.concatenated({t: table(spark, d, t).select(F.col(k).alias("id"), F.col(x).alias("text")) for t, (k, x) in parts.items()}).select("corpus", "id", F.sha2("text", 256).alias("text_sha256"))


@query(
    f"""WITH e AS (SELECT b AS id, 'exact' AS c FROM ({_EXACT}) UNION ALL SELECT b, 'overlap' FROM ({_overlaps(_SENTENCES)}) UNION ALL SELECT doc_id, 'length' FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS r FROM documents) WHERE r > 1)
SELECT id, string_agg(DISTINCT c, ',' ORDER BY c) AS criteria FROM e GROUP BY id"""
)
def duplicate_union(spark, d):
    """Rows that one of three criteria calls a duplicate: an equal text, sentences of an earlier one, or an equal length in one source."""
    x = docs(spark, d)
    exact = similarity.exact_duplicates(x.select(F.col("doc_id").alias("id"), "text"))
    overlap = typed_links.overlap_links(_whole(spark, d)).select(F.col("b").alias("id"))
    first = x.groupBy("source", "n_chars").agg(F.min("doc_id").alias("first"))
    size = x.join(first, x.source.eqNullSafe(first.source) & x.n_chars.eqNullSafe(first.n_chars)).where("doc_id <> first").select(F.col("doc_id").alias("id"))
    return reports.union_of_duplicates({"exact": exact, "overlap": overlap, "length": size})


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('s1|order|' || doc_id), doc_id) AS n, count(*) OVER () AS total FROM documents) SELECT doc_id, CASE WHEN n <= greatest(1, CAST(floor(total * CAST(0.1 AS DOUBLE)) AS BIGINT)) THEN 'validation' ELSE 'train' END AS split FROM r")
def block_split(spark, d):
    return reports.block_split(docs(spark, d).select("doc_id"), "doc_id", 0.1, SEED)


# samples and edits


@query(f"WITH {SAMPLES} SELECT conv_id, turn, {Q.strip('question')} || ' || ' || {Q.strip('context')} AS task FROM s")
def task_texts(spark, d):
    return SM.samples(chats(spark, d)).select("conv_id", "turn", SM.task_text(F.col("question"), F.col("context")).alias("task"))


@query(f"WITH {SAMPLES} SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn AS owner, question || CASE WHEN context <> '' THEN ' ' || context ELSE '' END AS question, answer, '' AS context FROM s")
def pseudo_samples(spark, d):
    s = SM.samples(chats(spark, d)).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("question").alias("instruction"), F.col("context").alias("input"), F.col("answer").alias("output"))
    return SM.pseudo_samples(s)


@query(
    f"""WITH {LAST}, b AS (SELECT conv_id, turn, string_split(rendered, chr(10) || chr(10)) AS blocks FROM q),
g AS (SELECT *, len(list_filter(blocks, lambda b: len(string_split(b, chr(10))) <> 2 OR NOT starts_with(string_split(b, chr(10))[1], 'User: ') OR NOT starts_with(string_split(b, chr(10))[2], 'AI: '))) = 0 AS good FROM b)
SELECT conv_id, turn, CASE WHEN good THEN CAST(2 * len(blocks) AS INTEGER) END AS n_messages, CASE WHEN good THEN substr(string_split(blocks[-1], chr(10))[1], 7) END AS question, CASE WHEN good THEN substr(string_split(blocks[-1], chr(10))[2], 5) END AS answer FROM g"""
)
def rendered_messages(spark, d):
    """What the renderings of last exchanges say when they are read back; null where texts have line ends of their own."""
    m = SM.last_exchange(chats(spark, d)).select("conv_id", "turn", SM.parse_rendered(F.col("rendered")).alias("m"))
    n = F.when(F.col("m").isNotNull(), F.size("m"))
    return m.select("conv_id", "turn", n.alias("n_messages"), F.get("m", F.size("m") - 2)["text"].alias("question"), F.get("m", F.size("m") - 1)["text"].alias("answer"))


_DEPENDS = "dp AS (SELECT conv_id, turn, [turn - 3, greatest(turn - 5, 0)] AS o FROM conversations WHERE role = 'assistant' AND turn >= 5)"


@query(
    f"""WITH {LAST}, {_DEPENDS}, y AS (SELECT q.*, e.t3, e.t2, o FROM q JOIN e USING (conv_id, turn) LEFT JOIN dp USING (conv_id, turn)),
z AS (SELECT *, CASE WHEN o IS NOT NULL THEN list_sort(list_filter(list_distinct(o), lambda x: NOT (x = turn - 1 OR (has_context AND (x = turn - 2 OR x = turn - 3))))) END AS missing,
 CASE WHEN has_context THEN greatest(length({Q.strip('t3')}) - 80, 0) ELSE 0 END AS lu, CASE WHEN has_context THEN greatest(length({Q.strip('t2')}) - 120, 0) ELSE 0 END AS la FROM y)
SELECT conv_id || '#R2#' || turn AS sample_id, len(missing) = 0 AS covered, array_to_string(missing, ',') AS missing, CAST(CASE WHEN lu > 0 THEN 1 ELSE 0 END + CASE WHEN la > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_truncated,
lu = 0 AND la = 0 AND coalesce(len(missing) = 0, true) AS lossless FROM z"""
)
def assembled_samples(spark, d):
    """Samples with dependencies declared on the exchange before and the one before that."""
    m = chats(spark, d)
    depends = m.where("role = 'assistant' AND turn >= 5").select("conv_id", "turn", F.array(F.col("turn") - 3, F.greatest(F.col("turn") - 5, F.lit(0))).alias("on"), F.lit(2).alias("depth"))
    a = SM.assemble(m, depends)
    return a.select("sample_id", "covered", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), F.size("history_truncation").alias("n_truncated"), "lossless")


@query(
    f"""WITH {SAMPLES}, {_DEPENDS}, wt AS (SELECT conv_id, turn, unnest([turn - 3, turn - 2]) AS at FROM s UNION SELECT dp.conv_id, dp.turn, unnest(o) FROM dp JOIN s USING (conv_id, turn)),
cx AS (SELECT w.conv_id, w.turn, string_agg(CASE c.role WHEN 'user' THEN 'User: ' ELSE 'AI: ' END || coalesce(c.text, ''), chr(10) ORDER BY w.at) AS context FROM wt w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.at WHERE w.at <> w.turn - 1 GROUP BY 1, 2)
SELECT s.conv_id, s.turn, s.question, s.answer, coalesce(cx.context, '') AS context FROM s LEFT JOIN cx USING (conv_id, turn)"""
)
def samples_with_depends(spark, d):
    m = chats(spark, d)
    depends = m.where("role = 'assistant' AND turn >= 5").select("conv_id", "turn", F.array(F.col("turn") - 3, F.greatest(F.col("turn") - 5, F.lit(0))).alias("on"))
    return SM.with_depends(m, depends)


@query(
    """SELECT conv_id, count(*) FILTER (role = 'assistant') AS exchanges, CASE WHEN count(*) FILTER (role = 'assistant') BETWEEN 3 AND 4 THEN '3-4' WHEN count(*) FILTER (role = 'assistant') BETWEEN 5 AND 6 THEN '5-6'
WHEN count(*) FILTER (role = 'assistant') BETWEEN 7 AND 8 THEN '7-8' ELSE 'other' END AS length_band FROM conversations GROUP BY conv_id"""
)
def conversation_bands(spark, d):
    c = chats(spark, d).groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("exchanges"))
    return c.withColumn("length_band", SM.length_band(F.col("exchanges")))


@query(f"WITH {SAMPLES} SELECT conv_id, turn, true AS right_mask, length(answer) = 0 AS wrong_mask FROM s WHERE length(question) + length(answer) > 0")
def mask_checks(spark, d):
    """The check of target masks, on the masks made for samples and on masks of nothing."""
    s = SM.samples(chats(spark, d)).where(F.length("question") + F.length("answer") > 0)
    n = F.length("question") + F.length("answer") + 11
    start = n - F.length("answer")
    made, empty = SM.target_mask(n, start, n), SM.target_mask(n, n, n)
    return s.select("conv_id", "turn", SM.mask_is_right(made, start, n, n).alias("right_mask"), SM.mask_is_right(empty, start, n, n).alias("wrong_mask"))


@query(f"SELECT conv_id, turn, {Q.any_of(F_TEXT, D.FILE_MENTIONS)} AND {Q.any_of(F_TEXT, D.FILE_QUESTIONS)} AS asks_file FROM conversations")
def file_questions(spark, d):
    return chats(spark, d).select("conv_id", "turn", D.is_file_question(F.col("text")).alias("asks_file"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256('new') WHEN doc_id % 3 = 1 THEN sha256(coalesce(text, '') || CASE WHEN coalesce(text, '') = '' OR ends_with(text, chr(10)) THEN '' ELSE chr(10) END || 'new')
WHEN contains(coalesce(text, ''), 'the') THEN sha256(replace(text, 'the', 'new')) END AS text_sha256,
CASE WHEN doc_id % 3 = 2 AND NOT contains(coalesce(text, ''), 'the') THEN 'find_not_found' END AS error FROM documents"""
)
def edited_texts(spark, d):
    """Each document edited: a third replaced, a third appended to, in a third one word is replaced."""
    k = F.col("doc_id") % 3
    kind = F.when(k == 0, "replace_all").when(k == 1, "append").otherwise("find_replace")
    e = docs(spark, d).select("doc_id", D.edited(F.col("text"), kind, F.lit("the"), F.lit("new"), F.lit(None).cast("int")).alias("e"))
    return e.select("doc_id", F.sha2("e.text", 256).alias("text_sha256"), "e.error")


@query(
    """WITH p AS (SELECT doc_id AS file_id, coalesce(text, '') AS t, doc_id % 4 AS k FROM documents)
SELECT file_id, sha256(CASE WHEN k = 1 THEN t || '!' ELSE t END) AS content_sha256, k = 1 AS has_undo, k = 2 AS refused FROM p"""
)
def applied_edits(spark, d):
    """Previewed edits: a quarter fits the content, a quarter was made from another."""
    files = docs(spark, d).select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("content"))
    k = F.col("file_id") % 4
    plans = files.where(k.isin(1, 2)).select("file_id", F.sha2(F.when(k == 1, F.col("content")).otherwise("other"), 256).alias("old_sha256"), F.concat("content", F.lit("!")).alias("new_content"))
    a = D.apply_edits(files, plans)
    return a.select("file_id", F.sha2("content", 256).alias("content_sha256"), F.col("undo").isNotNull().alias("has_undo"), "refused")


@query("SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def recent_events(spark, d):
    return state.recent(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter(string_split(event_type || ',' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END || ',magyar', ','), lambda t: t <> 'magyar')) AS tag FROM events) GROUP BY tag")
def tag_counts(spark, d):
    """Every occurrence of tags in arrays, but for the one that all rows have."""
    tags = F.array(F.col("event_type"), F.when(F.col("value") > 50, "high").otherwise("low"), F.lit("magyar"))
    e = table(spark, d, "events").select(F.explode(F.filter(tags, lambda t: t != "magyar")).alias("tag"))
    return e.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
