"""WARC: a writer, and a splittable reader of record-compressed archives.

Writer: every record is a gzip member of its own. Payloads are deduplicated by SHA-1: of
the pages with one payload that with the largest page_id is a ``response``, the others
``revisit`` it. Each task attempt writes files under names of its own and reports them
as rows; only names in the checkpointed manifest are read, so files of lost or repeated
attempts don't count.

Reader: the byte length of each file is cut into ranges of ``split_bytes``. The task of a
range looks for the gzip magic from its start; a candidate is a record only if it inflates
and begins with a WARC version line. A record belongs to the range in which its member
starts, and is read to its end beyond the range if need be; the search goes on behind it.
A task holds one record and one read buffer.

Defined results: a null payload is empty; a null url is left out; pages that share an id and a
payload with the response are responses too; a page without id is always a response and
reads back with a null id; an empty table gives no files and no rows; extra columns are not
read. A magic inside a payload is no record unless a whole WARC record member is stored
there uncompressed right at the start of a range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.workspace import fresh_dir, materialise

SPLIT_BYTES = 8 << 20
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 20
#: Bytes of shared digests up to which they are broadcast, and of one of them; tasks that one payload's pages are dealt to.
BROADCAST_BYTES = 16 << 20
DIGEST_BYTES = 96
SALTS = 64
MAGIC = b"\x1f\x8b\x08"
_PAGE = "urn:outlay:page:"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_PAGE}{'none:' + uuid.uuid4().hex if page_id is None else page_id}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_PAGE}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, out_dir: str) -> DataFrame:
    """pages(page_id, url, html) -> manifest(path, n_bytes, n_records) of what was written."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    shared = materialise(
        pages.groupBy(F.sha1("payload").alias("digest"))
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select("digest", "first_id")
    )
    if shared.count() * DIGEST_BYTES <= BROADCAST_BYTES:  # payloads stay where they are
        named = pages.withColumn("digest", F.sha1("payload")).join(F.broadcast(shared), "digest", "left")
    else:  # one payload's pages are dealt to SALTS tasks
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = pages.withColumn("digest", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    refers = F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))
    # pandas would make floats of numbers beside nulls: ids go as text
    todo = named.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", refers.cast("string").alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _filesystem(out_dir)
        system.create_dir(base, recursive=True)
        out, path, size, n = None, "", 0, 0

        def closed() -> pd.DataFrame:
            out.close()
            return pd.DataFrame([(f"{out_dir}/{path}", size, n)], columns=["path", "n_bytes", "n_records"])

        for pdf in batches:
            for page_id, url, payload, refers_to in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                if out is None:
                    path, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{path}", compression=None)
                    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                    size = out.write(gzip_member(info % str(uuid.uuid4()).encode()))
                member = gzip_member(record_bytes(None if pd.isna(page_id) else int(page_id), url, bytes(payload), None if pd.isna(refers_to) else int(refers_to)))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return todo.mapInPandas(write, "path string, n_bytes long, n_records long")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-cased header fields (and the version as ``warc``), block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {"warc": first}
    for line in lines:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


def members(handle, start: int, end: int, read_bytes: int = READ_BYTES) -> Iterator[bytes]:  # noqa: ANN001
    """The inflated members of WARC records that start in [start, end) of an open file."""
    buffer, at = b"", start  # buffer holds the file's bytes from `at` on

    def more() -> bool:
        nonlocal buffer
        handle.seek(at + len(buffer))
        got = handle.read(read_bytes)
        buffer += got
        return bool(got)

    while at < end:
        i = buffer.find(MAGIC)
        if i < 0:
            keep = min(len(MAGIC) - 1, len(buffer))
            at, buffer = at + len(buffer) - keep, buffer[len(buffer) - keep :]
            if not more():
                return
            continue
        at, buffer = at + i, buffer[i:]
        if at >= end:
            return
        inflate, data, used = zlib.decompressobj(31), [], 0
        try:
            while not inflate.eof:
                if used == len(buffer) and not more():
                    raise zlib.error("cut off")
                fed = buffer[used:]
                data.append(inflate.decompress(fed))
                used += len(fed) - len(inflate.unused_data)
                if len(data[0]) >= 5 and not data[0].startswith(b"WARC/"):
                    raise zlib.error("no WARC record")
            whole = b"".join(data)
            if not whole.startswith(b"WARC/") or b"\r\n\r\n" not in whole:
                raise zlib.error("no WARC record")
        except zlib.error:
            at, buffer = at + 1, buffer[1:]
            continue
        yield whole
        at, buffer = at + used, buffer[used:]


def _page_number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").removeprefix(_PAGE)
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """manifest(path, n_bytes) -> records of type response and revisit, with payload."""
    ranges = manifest.where("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = ranges.count()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"], strict=True):
                system, name = _filesystem(path)
                with system.open_input_file(name) as handle:
                    rows, held = [], 0
                    for data in members(handle, int(start), int(start) + split_bytes):
                        fields, block = parse_record(data)
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
                        own = kind == "response"
                        digest = base32_sha1(payload) if own else fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append((_page_number(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, len(payload) if own else length, digest, _page_number(fields.get("warc-refers-to")), payload if own else None))
                        held += len(data)
                        if held > 8 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                    yield _frame(rows)

    return ranges.repartition(max(1, n), "path", "start").mapInPandas(read, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in RECORD.split(", ")]
    columns = dict(zip(names, zip(*rows), strict=True)) if rows else dict.fromkeys(names, ())
    whole = {"page_id", "payload_bytes", "refers_to"}
    return pd.DataFrame({n: pd.array(list(v), dtype="Int64") if n in whole else pd.Series(v, dtype=object) for n, v in columns.items()})


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = materialise(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_dir(spark, "warc")))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id FROM p
), bits AS (
  SELECT *, list_transform(range(8), lambda j: CAST('0x' || substr(hex, CAST(5 * j + 1 AS INTEGER), 5) AS INTEGER)) AS v FROM w
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id OR first_id IS NULL OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""
