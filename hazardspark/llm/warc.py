"""WARC archives: a writer and a sequential reader.

Writing: every row becomes one WARC/1.1 record in a gzip member of its own. Equal
payloads of at least ``REVISIT`` bytes are stored once, in the record of the largest
page_id; the others are revisit records that name it. Rows are dealt over files by
their own partitions, each task streams its records into one file in the shared folder
and renames it when complete, so a repeated task leaves one whole file.

Reading: files are dealt over tasks; each is read front to back in small blocks, one
gzip member after the other through an incremental decompressor, framed by
Content-Length. Each block's SHA-1 is held against WARC-Block-Digest, and a response's
payload against WARC-Payload-Digest. Archives of other writers are read as well: every
record gives a row, of whatever type; what its headers do not say is null. The payload
of an HTTP message is what follows its head, of any other record the whole block; digests
of other algorithms than SHA-1 are not verified, nor payload digests of messages with a
transfer encoding, which writers take before or after decoding. Without a stated
Content-Length a revisit's payload size is null.

Defined results: null html counts as an empty payload; rows with a repeated page_id
each give a record (several rows with the largest page_id are all responses); a null
page_id is kept and is never the response that others name; other columns are ignored;
an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm.common import shared_dir, table

REVISIT, BLOCK, SALTS = 1000, 1 << 16, 32
#: The date that each record carries: archives of equal rows are equal.
DATE = "2024-01-01T00:00:00Z"
#: The columns of a record as read.
READ = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, "
    "record_id string, refers_to_record string"
)
KINDS = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "refers_to": pa.int64(), "payload": pa.binary(), "record_id": pa.string(), "refers_to_record": pa.string(),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str):
    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:") if path.startswith("file:/") else path)


def member(headers: dict[str, str], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def _record_id(page_id, digest: str, revisit: bool) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{revisit}')}>"


def record(page_id, url, payload: bytes | None, digest: str, size: int, refers_to) -> bytes:
    """A response (payload given) or a revisit (payload None)."""
    shown = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    headers = {
        "WARC-Type": "revisit" if payload is None else "response",
        "WARC-Record-ID": _record_id(shown, digest, payload is None),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(x for x in (url or "") if x not in "\r\n"),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Page-ID": str(shown),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest": _digest(block),
    }
    if payload is None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To-Page-ID": str(refers_to), "WARC-Refers-To": _record_id(refers_to, digest, False)}
    return member(headers, block)


def write(pages: DataFrame, folder: str, least: int = REVISIT) -> DataFrame:
    """Write the archives into ``folder``; one row (path, records) for each file."""
    rows = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    first = first.where((F.col("n") > 1) & F.col("newest").isNotNull()).drop("n")
    # a payload that many pages share is met in SALTS tasks (more, where Spark splits skewed joins)
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS)))
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")) & (F.col("size") >= least)
    rows = rows.join(first, ["digest", "salt"], "left").select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("newest")).alias("refers_to")
    )

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        path = f"{base}/part-{task.partitionId():06d}.warc.gz"
        draft = f"{path}.{task.taskAttemptId()}.draft"
        count = 0
        out = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or system.open_output_stream(draft, compression=None)
                out.write(record(*row))
                count += 1
        if out:
            out.close()
            if system.get_file_info(path).type != fs.FileType.NotFound:  # of an attempt before this one
                system.delete_file(path)
            system.move(draft, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return rows.mapInArrow(run, "path string, records long")


def members(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The content of one gzip member after the other, read in blocks."""
    unpacker, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        chunk = rest or stream.read(block)
        rest = b""
        if not chunk:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(unpacker.decompress(chunk))
        if unpacker.eof:
            yield b"".join(parts)
            rest = unpacker.unused_data
            unpacker, parts = zlib.decompressobj(31), []


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _sha1(stated: str | None) -> str | None:
    """A stated SHA-1 (base 32 or hex) as lower-case hex; None for other digests or none."""
    algorithm, _, value = (stated or "").partition(":")
    if algorithm.lower().replace("-", "") != "sha1" or len(value) not in (32, 40):
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; a wrong frame or digest is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode(errors="replace").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = _fields(lines)
    size = int(headers["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("the record is not framed as its Content-Length says")
    stated = _sha1(headers.get("warc-block-digest"))
    if stated and hashlib.sha1(block).hexdigest() != stated:
        raise ValueError("the block does not have the digest that the record states")
    return headers, block


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def row_of(headers: dict[str, str], block: bytes) -> tuple:
    """A record as a row of ``read``; a response whose payload lacks its stated digest is an error."""
    kind, stated = headers["warc-type"].lower(), _sha1(headers.get("warc-payload-digest"))
    http, payload = {}, block
    if headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head.decode(errors="replace").split("\r\n")[1:])
    if kind == "revisit":
        payload, size, digest = None, _number(http.get("content-length")), stated
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if kind == "response" and stated and digest != stated and "transfer-encoding" not in http:
            raise ValueError("the payload does not have the digest that the record states")
    uri = headers.get("warc-target-uri")
    named = _number(headers.get("warc-page-id")), uri.strip("<>") if uri else uri, kind, size, digest
    return *named, _number(headers.get("warc-refers-to-page-id")), payload, headers.get("warc-record-id"), headers.get("warc-refers-to")


def read(files: DataFrame, folder: str) -> DataFrame:
    """The records of the archives named in the column path, in order within a file."""

    def run(batches):
        system, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for content in members(stream):
                        rows.append(row_of(*parse(content)))
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return files.select("path").mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS.values(), strict=True)], names=list(KINDS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = f"{folder}-files"
    write(table(spark, sf_dir, "pages"), folder).write.parquet(manifest)
    files = spark.read.schema("path string, records long").parquet(manifest)
    files = files.repartitionByRange(max(1, files.count()), "path")
    return read(files, folder).drop("payload", "url", "record_id", "refers_to_record")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS newest FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m.newest IS NOT NULL AND p.n >= 1000 AND p.page_id IS DISTINCT FROM m.newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.newest IS NOT NULL AND p.n >= 1000 AND p.page_id IS DISTINCT FROM m.newest THEN m.newest END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""
