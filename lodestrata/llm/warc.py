"""WARC archives: written as one gzip stream each, normalised to a member for each record, read back by offset.

1. Pages are tagged with the SHA-1 of their payload. Of equal payloads the smallest page_id is the response;
   the others become revisit records without payload, whose HTTP head still tells the payload's length.
2. Each task writes archives of bounded size, each a single gzip stream.
3. The normaliser inflates such a stream once, piece by piece, rewrites every record as its own gzip member and
   writes a sidecar index of their offsets.
4. The reader takes ranges of members from the sidecars and inflates them one by one.

Files are named by task attempt and listed in a manifest that is written when the attempt's task commits, so
files of a lost executor are never read. They go to any file system that pyarrow opens by URI.

Defined results: a null html is an empty payload; a null url has no target URI. Rows of one page_id that
carry the response's payload are all responses; null ids are responses only where no row with an id has the
payload. Payloads are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import hot_spread_join, map_rows, shared_dir, written

#: Payload bytes of an archive, and members that one row of work reads back, about.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
#: Tasks that one stage has, at most; each takes more archives or ranges beyond that.
TASKS = 100_000
PIECE = 1 << 20
#: Every record carries the same date, so that writing a table again gives the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of its file system, so that other programs than Spark understand it."""
    if re.match(r"\w+://", path):
        return path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1" + _LINE + b"".join(f"{k}: {v}".encode() + _LINE for k, v in fields if v is not None) + _LINE


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record with its closing empty lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_uri(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", page_uri(refers_to) if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return _head(fields) + block + _LINE * 2


class _Archive:
    """One gzip stream, from a warcinfo record to its close."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = _opened(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.zip, self.size, self.records = system.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
        told = b"software: lodestrata\r\nformat: WARC File Format 1.1\r\n"
        self.add(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.uri)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(told))]) + told + _LINE * 2)

    def add(self, whole: bytes) -> None:
        self.out.write(self.zip.compress(whole))
        self.size, self.records = self.size + len(whole), self.records + 1

    def close(self) -> dict:
        self.out.write(self.zip.flush())
        self.out.close()
        return {"archive": self.uri, "records": self.records, "bytes": self.size}


def _writer(folder: str, least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first_id")), strict=True):
                page_id, url, html, first_id = (x.as_py() for x in row)
                payload = (html or "").encode("utf-8", "surrogatepass")
                archive = archive or _Archive(folder)
                archive.add(record(page_id, url, payload, base32_sha1(payload), first_id, first_id != page_id and len(payload) >= least))
                if archive.size >= ARCHIVE_BYTES:
                    done, archive = [*done, archive.close()], None
        done += [archive.close()] if archive else []
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return rows


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages to gzip streams below folder; returns the manifest (archive, records, bytes)."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    tagged = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"))
    firsts = written(tagged.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), folder, "firsts")
    dealt = hot_spread_join(tagged, firsts, "digest", "copies", ["page_id", "url"])
    manifest = map_rows(dealt.select("page_id", "url", "html", "first_id"), _writer(f"{qualified(spark, folder)}/raw", least_bytes), "archive string, records long, bytes long")
    return written(manifest, folder, "manifest")


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes, int]]:
    """(head, block, size of the whole record) of each record of an inflated stream, holding one record at a time."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a WARC record's head is cut off")
                return
        head = bytes(held[: end + 4])
        size = int(re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", head)[1])
        whole = end + 4 + size + 4
        while len(held) < whole:
            if not more():
                raise ValueError("a WARC record's block is cut off")
        yield head, bytes(held[end + 4 : end + 4 + size]), whole
        del held[:whole]


def inflated(stream) -> Iterator[bytes]:
    """The pieces of a gzip file, of one member or many, each of at most PIECE bytes."""
    unzip, fed = zlib.decompressobj(31), b""
    while fed or (fed := stream.read(PIECE)):
        out = unzip.decompress(fed, PIECE)
        fed = unzip.unconsumed_tail
        if out:
            yield out
        if unzip.eof:
            fed, unzip = unzip.unused_data, zlib.decompressobj(31)


def field_of(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?i)\r\n" + name.encode() + rb":[ \t]*([^\r\n]*)", b"\r\n" + head)
    return found[1].decode() if found else None


def normalise(source: str, folder: str) -> dict:
    """Rewrites the archive at source as one member a record, with a sidecar index of JSON lines, below folder."""
    name = f"{folder}/{uuid.uuid4().hex}"
    system, path = _opened(f"{name}.warc.gz")
    system.create_dir(path.rpartition("/")[0], recursive=True)
    from_system, from_path = _opened(source)
    at = count = 0
    with from_system.open_input_stream(from_path, compression=None) as stream, system.open_output_stream(path, compression=None) as out, system.open_output_stream(path.removesuffix(".warc.gz") + ".index", compression=None) as index:
        for head, block, _ in _records(inflated(stream)):
            zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = zipper.compress(head + block + _LINE * 2) + zipper.flush()
            out.write(member)
            index.write(json.dumps({"offset": at, "length": len(member), "id": field_of(head, "WARC-Record-ID"), "type": field_of(head, "WARC-Type"), "digest": field_of(head, "WARC-Payload-Digest")}).encode() + b"\n")
            at, count = at + len(member), count + 1
    return {"archive": f"{name}.warc.gz", "index": f"{name}.index", "records": count, "bytes": at}


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each archive of manifest: archive, index, records, bytes of its normalised form below folder."""
    target = f"{qualified(manifest.sparkSession, folder)}/members"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive"):
                yield pa.RecordBatch.from_pylist([normalise(source.as_py(), target)])

    dealt = manifest.repartition(max(1, min(TASKS, manifest.count())))
    return written(map_rows(dealt, rows, "archive string, index string, records long, bytes long"), folder, "normalised")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of whole members, of about RANGE_BYTES each, from the sidecars."""
    for batch in batches:
        for archive, index in zip(batch.column("archive"), batch.column("index"), strict=True):
            system, path = _opened(index.as_py())
            start = end = 0
            out = []
            with system.open_input_stream(path, compression=None) as stream:
                for line in stream.read().splitlines():
                    told = json.loads(line)
                    end = told["offset"] + told["length"]
                    if end - start >= RANGE_BYTES:
                        out.append({"archive": archive.as_py(), "start": start, "end": end})
                        start = end
            if end > start:
                out.append({"archive": archive.as_py(), "start": start, "end": end})
            if out:
                yield pa.RecordBatch.from_pylist(out)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _page_of(uri: str | None) -> int | None:
    told = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(told) if re.fullmatch(r"-?\d+", told) else None


class _Limited:
    """The bytes of a stream up to a given number."""

    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def read(self, n: int) -> bytes:
        got = self.stream.read(min(n, self.left))
        self.left -= len(got)
        return got


def _reader(payloads: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, start, end in zip(*(batch.column(c) for c in ("archive", "start", "end")), strict=True):
                system, path = _opened(archive.as_py())
                out, held = [], 0
                with system.open_input_file(path) as stream:
                    stream.seek(start.as_py())
                    for head, block, _ in _records(inflated(_Limited(stream, end.as_py() - start.as_py()))):
                        kind = field_of(head, "WARC-Type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = field_of(head, "WARC-Payload-Digest").removeprefix("sha1:")
                        size = int(field_of(http, "Content-Length"))
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"the payload of {field_of(head, 'WARC-Record-ID')} is damaged")
                        refers = _page_of(field_of(head, "WARC-Refers-To")) if kind == "revisit" else None
                        out.append({"page_id": _page_of(field_of(head, "WARC-Record-ID")), "url": field_of(head, "WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": payload if payloads and kind == "response" else None})
                        held += len(payload) * payloads
                        if held >= RANGE_BYTES or len(out) >= 10_000:
                            yield pa.RecordBatch.from_pylist(out, schema=_READ)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_READ)

    return rows


def read_archives(normalised: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each response or revisit record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A revisit's payload is null; payload_bytes is that of its full payload. Every response's digest is checked.
    Ranges are dealt to as many tasks as their bytes need: a number that adaptive execution, which sees only their
    short rows, leaves as it is.
    """
    size = normalised.agg(F.sum("bytes")).first()[0] or 0
    ranges = map_rows(normalised.select("archive", "index"), _ranges, "archive string, start long, end long")
    dealt = ranges.repartition(max(1, min(TASKS, -(-size // RANGE_BYTES))))
    return map_rows(dealt, _reader(payloads), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    archives = normalise_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)
    return read_archives(archives, payloads=False).drop("url", "payload")


#: Base 32 by way of the digest's bits.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, strlen(html)::BIGINT AS n, min(page_id) OVER (PARTITION BY html) AS first, array_to_string(list_transform(range(1, 41), lambda i:
  ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', h[i])]), '') AS bits FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
  bits[5 * k + 1]::INT * 16 + bits[5 * k + 2]::INT * 8 + bits[5 * k + 3]::INT * 4 + bits[5 * k + 4]::INT * 2 + bits[5 * k + 5]::INT + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
