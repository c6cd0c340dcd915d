import gzip
import hashlib
import io

import pytest

from hazardspark.llm import warc


def test_write_and_read(spark, tmp_path):
    long = "é" * 700
    html = [long, "small", long, None, "", long + "x", "small", long, "z" * 300_000]
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate(html)] + [(7, None, long), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS size", "2 AS digest").repartition(3)
    folder = str(tmp_path / "w")
    files = spark.createDataFrame(warc.write(pages, folder).collect(), "path string, records long")
    got = warc.read(files, folder).collect()
    assert len(got) == len(rows) == sum(r.records for r in files.collect())
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = h == long and i != 7
        want.append((i is None, i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert sorted((r.page_id is None, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: (x[:5], str(x[5])))
    for r in got:
        assert r.payload is None or hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    path = files.first().path
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")
    assert warc.read(spark.createDataFrame(warc.write(pages.limit(0), folder + "e").collect(), "path string, records long"), folder).count() == 0


def test_reader_refuses_damage():
    whole = warc.record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), 4, None)
    assert [warc.parse(x)[1][-4:] for x in warc.members(io.BytesIO(whole * 3), 7)] == [b"body"] * 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(whole[:-9])))
    content = next(warc.members(io.BytesIO(whole)))
    with pytest.raises(ValueError):
        warc.parse(content.replace(b"body", b"bodx"))
    with pytest.raises(ValueError):
        warc.parse(content[:-1])


def test_reads_archives_of_others(spark, tmp_path):
    def foreign(headers: str, block: bytes) -> bytes:
        return gzip.compress(f"WARC/1.0\r\n{headers}content-length:{len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi</p>"
    sha = hashlib.sha1(b"<p>hi</p>").hexdigest()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nhi\r\n0\r\n\r\n"
    records = [
        foreign("WARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\n", b"software: x\r\n"),
        foreign("WARC-Type: request\r\nContent-Type: application/http; msgtype=request\r\nWARC-Target-URI: <http://a/>\r\n", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        foreign(f"WARC-Type:response\r\nContent-Type: application/http;msgtype=response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:{sha}\r\n", page),
        foreign("WARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:" + "A" * 32 + "\r\n", chunked),
        foreign("WARC-Type: revisit\r\nContent-Type: application/http\r\nWARC-Refers-To:\r\n <urn:uuid:1>\r\nWARC-Payload-Digest: sha256:00\r\n", b"HTTP/1.1 200 OK\r\n\r\n"),
        foreign("WARC-Type: metadata\r\n", b""),
        foreign("WARC-Type: resource\r\nContent-Type: text/html\r\nWARC-Block-Digest: md5:00\r\n", b"plain\r\n\r\nbody"),
    ]
    path = str(tmp_path / "other.warc.gz")
    with open(path, "wb") as out:
        out.write(b"".join(records))
    got = warc.read(spark.createDataFrame([(path,)], "path string"), str(tmp_path)).collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "revisit", "metadata", "resource"]
    assert [r.payload_bytes for r in got] == [13, 0, 9, 12, None, 0, 13]
    assert got[1].url == "http://a/" and got[2].payload_digest == sha and bytes(got[2].payload) == b"<p>hi</p>" and got[2].record_id == "<urn:uuid:1>"
    assert got[4].payload_digest is None and got[4].payload is None and got[4].refers_to_record == "<urn:uuid:1>"
    assert all(r.page_id is None and r.refers_to is None for r in got)
    wrong = foreign("WARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:" + "A" * 32 + "\r\n", page)
    with pytest.raises(ValueError):
        warc.row_of(*warc.parse(next(warc.members(io.BytesIO(wrong)))))


def test_revisits_name_the_record(spark):
    digest = hashlib.sha1(b"x").hexdigest()
    headers = [warc.parse(next(warc.members(io.BytesIO(warc.record(i, "u", body, digest, 1, to)))))[0] for i, body, to in ((9, b"x", None), (4, None, 9))]
    assert headers[1]["warc-refers-to"] == headers[0]["warc-record-id"] != headers[1]["warc-record-id"]
