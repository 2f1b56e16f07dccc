"""Container files as DataFrames: an eager scan, chunk rows of files in memory, and texts as files. The source that reads by seeks is chunk_source."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.kernels import container as ct
from tessera.sources.chunk_source import register  # noqa: F401

FILES = "path string, size long, parse_error string, warnings array<string>, codec_id int, channels int, bits int, preset int, sample_rate long, total_samples long, encoder int, meta array<struct<key:string,value:string>>, cover_mime string, n_frames long, n_seek long, n_peaks long, n_corr long, optional array<string>, n_fragments long"
CHUNKS = "path string, chunk_no int, fourcc string, chunk_offset long, payload_offset long, payload_length long, flags int, stored_crc long, repeat_index int, crc_ok boolean, payload binary"


def _row(path: str, data: bytes) -> dict:
    out = {"path": path, "size": len(data), "warnings": []}
    try:
        p = ct.parse(data)
    except (ct.ContainerError, ValueError) as e:
        return out | {"parse_error": str(e)}
    return out | p.head | {"warnings": p.warnings, "meta": [{"key": k, "value": v} for k, v in p.meta], "cover_mime": p.cover[0] if p.cover else None, "n_frames": len(p.frames), "n_seek": len(p.seek), "n_peaks": len(p.wave), "n_corr": len(p.corr), "optional": list(p.optional), "n_fragments": len(p.fragments)}


def parse_files(files: DataFrame, fingerprint: bool = False) -> DataFrame:
    """files (path, content) as one row each, FILES (and fingerprint, the SHA-256 of the bytes); a bad file has a parse_error and no rows are lost."""
    schema = files.sparkSession.createDataFrame([], FILES + (", fingerprint string" if fingerprint else "")).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b.column("path"), b.column("content"), strict=True):
                data = c.as_py() or b""  # one file at a time; rows hold no payloads
                rows.append(_row(p.as_py(), data) | ({"fingerprint": hashlib.sha256(data).hexdigest()} if fingerprint else {}))
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """Every file under path, parsed whole."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def _few(batches, rows: int = 256):
    """Batches of so many rows: what Python copies of a batch is this large at most."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def chunk_rows(files: DataFrame) -> DataFrame:
    """A row per chunk of files (path, content): CHUNKS. A file that breaks off gives the chunks before that."""

    def run(batches):
        for b in _few(batches):
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    for c in ct.index(lambda at, n, d=data: d[at : at + n], len(data), lambda *_: True):
                        rows.append((path, c.number, c.fourcc, c.offset, c.payload_offset, c.length, c.flags, c.stored_crc, c.repeat, c.crc_ok, c.payload))
                except ct.ContainerError:
                    pass
                if rows:
                    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                    names = ["path", "chunk_no", "fourcc", "chunk_offset", "payload_offset", "payload_length", "flags", "stored_crc", "repeat_index", "crc_ok", "payload"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, CHUNKS)


def pack_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, lang) as container files: path, content. The text's bytes are one audio frame."""

    def run(batches):
        for b in _few(batches):
            cols = [b.column(c).to_pylist() for c in ("doc_id", "text", "source", "lang")]
            paths, files = [], []
            for doc_id, text, source, lang in zip(*cols, strict=True):
                data = (text or "").encode()
                head = ct.head_bytes(0, 1, 16, 0, 44100, len(data) // 2)
                paths.append(f"doc-{doc_id}")
                files.append(ct.write(head, [("title", f"Document {doc_id}"), ("album", source or ""), ("language", lang or "")], frames=[(0, 0, 0, data)]))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(files, pa.binary())], ["path", "content"])

    return docs.select("doc_id", "text", "source", "lang").mapInArrow(run, "path string, content binary")


def meta_of(files: DataFrame, key: str) -> F.Column:
    from tessera.operators.catalog import meta_value

    return meta_value(files["meta"], key)
