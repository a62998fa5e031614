"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import (
    additive_quantisation,
    ctw,
    html_layout,
    quality_fm,
    quality_rules,
    sentencepiece_bpe,
    shingle_join,
    simhash,
    soft_mixing,
    toxicity,
    vp_tree,
    warc_archive,
    whitening,
)
from textloom.llm.labelled import remainder
from textloom.session import scratch_path, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    out = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of ``embeddings``, by cosine, of every row whose id is divisible by 50.

    Vectors that are null, zero, of an odd length or hold null or non-finite
    components take no part; ties go to the smaller id; an id that repeats comes
    once; an empty table gives an empty one.
    """
    return additive_quantisation.search(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from labelled rows outside the held-out fold.

    Null and empty texts get the score of no words; repeated rows are scored
    alike; rows without id aren't held out and can't be labelled.
    """
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score_column(model, F.col("text")), toxicity.THRESHOLD)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole text of ``documents``; a null text has no words and fails."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; null and empty texts share the fingerprint zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of ``documents``; null and empty texts have no tokens."""
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written to an archive and put together again, with size and digest of the record."""
    path = scratch_path(spark, "warc")
    warc_archive.write_archive(table(spark, sf_dir, "pages"), path)
    records = warc_archive.read_archive(spark, path, with_payload=True)
    whole = warc_archive.warc_bytes(records, ("payload_bytes", "payload_digest", "record_type", "refers_to"))
    return whole.withColumn("record_bytes", F.octet_length("record").cast("long")).withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are languages, learned from the documents that the labels table lists."""
    docs = table(spark, sf_dir, "documents")
    return soft_mixing.rate_documents(docs, labelled_languages(docs, table(spark, sf_dir, "labels")))


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: the labelled table of the mixing stage."""
    listed = labels.select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(listed, "doc_id", "left_semi")


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and unigram log10 probabilities of every whole text of ``documents``; null and empty texts are one end."""
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every row of ``pages`` with its characters and lines; null and empty pages have neither."""
    out = html_layout.extract(table(spark, sf_dir, "pages"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"), "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learned from labelled rows outside the held-out fold.

    Null and empty texts get the score of a text without words; repeated rows are
    scored alike; rows without id aren't held out and can't be labelled.
    """
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, quality_fm.score_column(machine, F.col("text")), quality_fm.THRESHOLD)


def op11_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` whose sets of five-word shingles have a Jaccard similarity of 0.8."""
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first negatives in the score window of every anchor and positive, over all rows of ``embeddings``."""
    return vp_tree.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector of ``embeddings`` on its four leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_ctw": op8_ctw,
    "op9_html": op9_html,
    "op10_quality": op10_quality,
    "op11_near_groups": op11_near_groups,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

OP6_SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, url, b, octet_length(b) AS n, sha256(b) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM k),
r AS (SELECT *, n >= 100 AND page_id <> first AS again FROM f),
w AS (SELECT *, encode(concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END,
    'WARC-Record-ID: <{warc_archive.NAME}' || page_id || '>', 'WARC-Date: {warc_archive.DATE}',
    'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g'), 'WARC-Payload-Digest: sha256:' || d,
    CASE WHEN again THEN 'WARC-Refers-To: <{warc_archive.NAME}' || first || '>' || chr(13) || chr(10) || 'WARC-Profile: {warc_archive.PROFILE}' END,
    'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END, '', ''))
    || CASE WHEN again THEN ''::BLOB ELSE b END || encode(chr(13) || chr(10) || chr(13) || chr(10)) AS record FROM r)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to,
       CAST(octet_length(record) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256
FROM w"""

OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

OP12_SQL = """
WITH r AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.id AS aid, b.id AS bid, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, bid) <= 5),
n AS (SELECT p.aid AS anchor_id, p.bid AS positive_id, s.bid AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.aid = s.aid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank,
    negative_id, positive_score, negative_score
FROM n QUALIFY rank <= 5"""

ORACLE_SQL: dict[str, str] = {
    "op6_warc": OP6_SQL,
    "op11_near_groups": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op3_quality_rules": quality_rules.oracle_sql(),
}
