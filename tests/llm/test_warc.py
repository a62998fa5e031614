"""Round trips of the archive, byte for byte."""

import hashlib

import pytest

from textloom.llm import warc_archive as w
from textloom.session import scratch_path

LONG, OTHER = "<p>" + "ä" * 60 + "</p>", "<p>" + "b" * 100 + "</p>"
PAGES = [(3, "http://a/1", LONG), (1, "http://a/2", LONG), (2, "http://b/\r\nX: y", OTHER), (4, None, "tiny"), (5, "http://c", "tiny"), (6, "u", None), (7, "u", ""), (None, "http://n", LONG), (9, "z", "x" * 300_000), (9, "z", "x" * 300_000)]


def archive(spark, rows=PAGES):
    path = scratch_path(spark, "test")
    w.write_archive(spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string").repartition(3), path)
    return path


def test_records(spark):
    got = w.read_archive(spark, archive(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = []
    for k, _, html in PAGES:
        b = (html or "").encode()
        first = min((p for p, _, h in PAGES if p is not None and (h or "").encode() == b), default=None)
        again = len(b) >= 100 and k != first
        want.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bytes(spark):
    path = archive(spark)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    html = {k: h for k, _, h in PAGES}
    for r in w.warc_bytes(w.read_archive(spark, path, with_payload=True)).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and rest.endswith(b"\r\n\r\n")
        body = rest[:-4]
        assert len(body) == int(fields["Content-Length"])
        if fields["WARC-Type"] == "response":
            assert body == (html[r["page_id"]] or "").encode()
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        else:
            assert body == b"" and "WARC-Refers-To" in fields
        assert "X" not in fields


def test_damage_is_found(spark):
    path = archive(spark, [(1, "u", LONG)])
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('changed' as binary) as payload", "first").collect()
    spark.createDataFrame(bad, "digest string, payload binary, first long").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        w.read_archive(spark, path).collect()


def test_empty(spark):
    assert w.read_archive(spark, archive(spark, [])).collect() == []
