"""WARC records in ZIP-packaged archives: written by tasks, read back by range without extraction.

An archive is a ZIP file whose members are stored, not deflated: archive/data.warc.gz, a chain of gzipped WARC/1.1 records, and
indexes/index.cdxj, a line of JSON per record with its offset and length in the first. The reader parses the end record, the
ZIP64 locator and end record where there are any, the central directory and a local header, then reads only the byte
ranges of the records that it wants, in blocks of about BLOCK bytes.

Of pages with equal payloads of at least LEAST bytes the one with the smallest page_id is a response record; the others are
revisit records, which hold headers only. Null html is an empty payload. A null url leaves out WARC-Target-URI. Rows that repeat
a page_id with an equal payload have the same record type. A null page_id can be a revisit but is never referred to. An empty
table gives no archives and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import commit_file, file_size, materialize, read_range, scratch, table

#: BLOCK: bytes read at once; a task reads TASK bytes.
LEAST, BLOCK, TASK = 100, 4_000_000, 64_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

# ---------------------------------------------------------------- records


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not gzipped. The block is an HTTP response; a revisit's has no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-ID": None if page_id is None else str(page_id),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "X-Refers-To-Page-ID": str(refers_to) if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def decode_record(raw: bytes) -> dict:
    """A record's headers, its HTTP headers and its payload (None in a revisit)."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": _headers(http), "payload": None if headers["warc-type"] == "revisit" else payload}


# ---------------------------------------------------------------- ZIP archives


class _Sink:
    """What zipfile needs of a stream that can't seek."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def write(self, data) -> int:
        self.sink.write(bytes(data) if not isinstance(data, bytes) else data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def write_archive(uri: str, records) -> int:
    """records: (index entry, record bytes). The number of records written; nothing is written if there are none."""
    first = next(records, None)
    if first is None:
        return 0
    count = 0

    def write(sink) -> None:
        nonlocal count
        index, at = [], 0
        with zipfile.ZipFile(_Sink(sink), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                item = first
                while item is not None:
                    entry, raw = item
                    packed = gzip.compress(raw, 6, mtime=0)
                    member.write(packed)
                    index.append(json.dumps(entry | {"offset": at, "length": len(packed)}))
                    at += len(packed)
                    count += 1
                    item = next(records, None)
            with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                for line in index:
                    member.write(line.encode() + b"\n")

    commit_file(uri, write)
    return count


class Archive:
    """Members of a ZIP file, found from its end by range reads."""

    def __init__(self, uri: str):
        self.uri, self.size = uri, file_size(uri)
        start = max(0, self.size - 65_557)
        tail = read_range(uri, start, self.size - start)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # what stands in a comment doesn't end where the file does
        if at < 0:
            raise ValueError(f"no end of central directory: {uri}")
        count, size, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
        if (count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF) and at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
            end = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
            record = read_range(uri, end, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError(f"no ZIP64 end of central directory: {uri}")
            count, size, offset = struct.unpack("<QQQ", record[32:56])
        self.members = self._directory(read_range(uri, offset, size), count)

    @staticmethod
    def _directory(raw: bytes, count: int) -> dict[str, tuple[int, int, int, int]]:
        """name: method, stored size, size, offset of the local header."""
        out, at = {}, 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
            stored, size, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
            offset = struct.unpack("<I", raw[at + 42 : at + 46])[0]
            name = raw[at + 46 : at + 46 + n_name]
            extra, p = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while p + 4 <= len(extra):
                kind, n = struct.unpack("<HH", extra[p : p + 4])
                if kind == 1:  # ZIP64: the fields that don't fit, in this order
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[p + 4 : p + 4 + n // 8 * 8]))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                p += 4 + n
            out[name.decode("utf-8" if flags & 0x800 else "cp437")] = (method, stored, size, offset)
            at += 46 + n_name + n_extra + n_comment
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, stored, _, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = read_range(self.uri, offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header: {name}")
        n_name, n_extra = struct.unpack("<HH", head[26:30])
        return offset + 30 + n_name + n_extra, stored

    def index(self):
        """The index's entries, with offsets into the file."""
        base, _ = self.locate(DATA)
        at, n = self.locate(INDEX)
        rest = b""
        for low in range(at, at + n, BLOCK):
            lines = (rest + read_range(self.uri, low, min(BLOCK, at + n - low))).split(b"\n")
            rest = lines.pop()
            for line in lines:
                entry = json.loads(line)
                yield entry | {"offset": base + entry["offset"]}

    def record(self, offset: int, length: int) -> dict:
        return decode_record(zlib.decompress(read_range(self.uri, offset, length), 31))


# ---------------------------------------------------------------- plans


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The pages (page_id, payload_digest) that repeat the payload of one with a smaller id, and that id (refers_to).

    Digests are aggregated before the shuffle; no group of equal pages is gathered.
    """
    seen = materialize(pages.where(F.octet_length("html") >= least).select("page_id", "payload_digest").distinct(), "digests")
    first = seen.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    again = seen.join(first.drop("n"), "payload_digest")
    return materialize(again.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))), "revisits")


def _write(folder: str):
    def run(batches):
        from pyspark import TaskContext

        def records():
            for batch in batches:
                for page_id, url, html, digest, refers_to, again in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to", "again")), strict=True):
                    payload = html.encode()
                    yield {"page": page_id, "digest": digest}, encode_record(page_id, url, payload, digest, refers_to, again)

        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz"
        n = write_archive(uri, records())
        if n:
            yield pa.RecordBatch.from_pydict({"path": [uri], "records": pa.array([n], pa.int64()), "bytes": pa.array([file_size(uri)], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, one per task; returns their paths, as a table in the shared folder."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("payload_digest", F.sha2("html", 256))
    old = revisits(pages).select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to")
    marked = pages.join(old, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    marked = marked.select("page_id", "url", "html", "payload_digest", "refers_to", F.col("refers_to").isNotNull().alias("again"))
    return materialize(marked.mapInArrow(_write(folder), "path string, records long, bytes long"), "archives")


def _blocks(batches):
    """Of each archive: runs of neighbouring records of about BLOCK bytes."""
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            rows, now, size = [], [], 0
            for e in Archive(uri).index():
                now.append((e["offset"], e["length"]))
                size += e["length"]
                if size >= BLOCK:
                    rows.append(now)
                    now, size = [], 0
            rows += [now] if now else []
            yield pa.RecordBatch.from_pydict({"path": [uri] * len(rows), "start": pa.array([r[0][0] for r in rows], pa.int64()), "lengths": pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int64()))})


def _read(batches):
    for batch in batches:
        for r in batch.to_pylist():
            raw, at, rows = read_range(r["path"], r["start"], sum(r["lengths"])), 0, []
            for n in r["lengths"]:
                rec = decode_record(zlib.decompress(raw[at : at + n], 31))
                at += n
                h = rec["headers"]
                digest = h["warc-payload-digest"].removeprefix("sha256:")
                size = int(rec["http"]["content-length"])
                if rec["payload"] is not None and (len(rec["payload"]) != size or hashlib.sha256(rec["payload"]).hexdigest() != digest):
                    raise ValueError(f"payload of {h['warc-record-id']} differs from its headers")
                number = lambda k, h=h: int(h[k]) if k in h else None
                rows.append((number("x-page-id"), size, digest, h["warc-type"], number("x-refers-to-page-id")))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives (path, bytes): RECORDS. Blocks are dealt evenly to tasks and read by range."""
    files, size = archives.agg(F.count("*"), F.sum("bytes")).first()
    least = archives.sparkSession.sparkContext.defaultParallelism
    # paths are few bytes, so the numbers of tasks follow what these read
    blocks = archives.select("path").repartition(max(1, min(files, max(least, (size or 0) // TASK))), "path").mapInArrow(_blocks, "path string, start long, lengths array<long>")
    return blocks.repartition(max(least, -(-(size or 0) // TASK)), "path", "start").mapInArrow(_read, RECORDS)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "wacz")))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
