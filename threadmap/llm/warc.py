"""WARC archives: a writer that marks revisits, and a sequential reader.

Each record is a gzip member of its own. The reader decompresses a file in pieces, cuts
records by their content length, and verifies the digests of block and payload. Writers
give each attempt's file a name of its own; only files that the saved manifest lists are
read, so what a lost or repeated task left behind is never seen.

Defined cases: a null html is an empty payload. A null url has no target URI. Rows of null
page_id are written as responses and read back with a null page_id. Rows of equal page_id
and payload are responses alike when theirs is the largest id. Empty tables give no
records. Control characters in urls are percent-encoded. Payloads may be of any length;
one record at a time is in memory. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, partitions, save, scratch

LEVEL, PIECE = 3, 1 << 18
#: Bytes of payload after which a task starts its next file.
FILE_BYTES = 256 << 20
DATE = "2020-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record: a response, or a revisit, which has the HTTP header alone, where refers_to is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    lines.append(f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """The data as one gzip member."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, decompressed piece by piece."""
    rest = stream.read(PIECE)
    while rest:
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if not rest and not (rest := stream.read(PIECE)):
                raise ValueError("the archive ends within a member")
            parts.append(d.decompress(rest))
            rest = d.unused_data
        yield b"".join(parts)
        rest = rest or stream.read(PIECE)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, framed by its content length and checked against its digests."""
    head, _, body = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ValueError("content length and record differ")
    block = body[:length]
    if headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
        raise ValueError("block digest differs")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha1:" + base32_sha1(block.partition(b"\r\n\r\n")[2]):
        raise ValueError("payload digest differs")
    return headers, block


def write(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives to the shared folder; the saved manifest (path, records).

    Of equal payloads of at least min_bytes the one of the largest page_id is a response
    and the others are revisits of it. The largest ids are found by an aggregation that
    combines on the map side, and joined back.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.where(F.octet_length("html") >= min_bytes)
    kept = large.groupBy("key").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1").select("key", "kept")
    refers = F.when(F.col("page_id") != F.col("kept"), F.col("kept"))
    planned = rows.join(kept, "key", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    base = scratch(pages.sparkSession, "warc")

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(base)
        fs.create_dir(root, recursive=True)
        out, name, count, size, done = None, "", 0, 0, []
        for frame in batches:
            for i, u, h, r in zip(*(frame[c].tolist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                payload = h.encode("utf-8", "surrogatepass")
                out.write(member(record(None if pd.isna(i) else int(i), u, payload, None if pd.isna(r) else int(r))))
                count, size = count + 1, size + len(payload)
                if size >= FILE_BYTES:
                    out.close()
                    out = done.append((f"{base}/{name}", count))
        if out is not None:
            out.close()
            done.append((f"{base}/{name}", count))
        yield pd.DataFrame(done, columns=["path", "records"])

    return save(planned.mapInPandas(archive, "path string, records long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, html of each record; html is null for revisits."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"

    def page(uri: str | None) -> int | None:
        return int(uri[10:-1]) if uri and uri.startswith("<urn:page:") else None

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            columns = [f.split()[0] for f in schema.split(", ")]
            return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

        for listed in batches:
            for path, expected in zip(listed["path"], listed["records"]):
                fs, name = filesystem(path)
                rows, size, count = [], 0, 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for data in members(stream):
                        headers, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        kind = headers["WARC-Type"]
                        html = payload.decode("utf-8", "surrogatepass") if kind == "response" else None
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        rows.append((page(headers["WARC-Record-ID"]), length, digest, kind, page(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), html))
                        count, size = count + 1, size + len(payload)
                        if size > 1 << 23:
                            yield frame(rows)
                            rows, size = [], 0
                if count != expected:
                    raise ValueError(f"{path} has {count} records, not {expected}")
                yield frame(rows)

    files = manifest.repartition(max(partitions(manifest.sparkSession), 1), "path")
    return files.mapInPandas(scan, schema)
