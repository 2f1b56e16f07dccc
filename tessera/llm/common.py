"""Shared helpers: the folder that all executors see, byte buffers of text columns, and vectorised word hashing.

Text is handled as UTF-8 bytes in slices of at most SLICE_BYTES, so a task's memory follows the longest text and not the
partition. A longer text is a slice of its own, with a few arrays of one byte per byte and of eight bytes per word; what needs eight
bytes per byte is done in windows of WINDOW bytes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.scratch import materialize, remove, scratch, scratch_scope, shared_dir  # noqa: F401

SLICE_BYTES, WINDOW = 1_000_000, 1 << 20
#: Fixed seeds of the hash functions below; any odd 64-bit numbers do.
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """The pyarrow filesystem and path of a URI; a plain path or file:// is local to what is mounted on all nodes."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def commit_file(uri: str, write) -> None:
    """write(sink) under another name, then a rename: a task that dies leaves no half-written file under uri."""
    f, path = filesystem(uri)
    f.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with f.open_output_stream(part) as sink:
        write(sink)
    f.move(part, path)


def read_range(uri: str, start: int, length: int) -> bytes:
    f, path = filesystem(uri)
    with f.open_input_file(path) as source:
        source.seek(start)
        return source.read(length)


def file_size(uri: str) -> int:
    f, path = filesystem(uri)
    return f.get_file_info(path).size


def count_up_to(column: Column, values: list[int]) -> Column:
    """How many of the ascending values are at most the column's: a binary search in expressions."""
    if not values:
        return F.lit(0)
    at = F.array(*map(F.lit, values))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(values).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, w: F.when((n + w <= len(values)) & (F.get(at, n + w - 1) <= column), n + w).otherwise(n))


def plain_names(docs: DataFrame) -> DataFrame:
    """docs with its further columns named x0, x1, ..., so that neither dots nor names of one's own clash; toDF(*docs.columns) undoes it."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"x{i}" for i, c in enumerate(docs.columns)])


def orderable(kind: T.DataType) -> bool:
    """Whether values of a type have an order."""
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType | T.CalendarIntervalType | T.NullType)


def least_row(docs: DataFrame) -> Column:
    """Aggregate: the least row of a group, as a struct; columns without an order are compared as JSON."""
    whole = F.struct(*docs.columns)
    return F.min_by(whole, F.struct(*[F.col(f.name) if orderable(f.dataType) else F.to_json(F.struct(f.name)) for f in docs.schema.fields]))


# ---------------------------------------------------------------- bytes of a text column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, end to end, and its n + 1 offsets (from 0); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into row slices of at most `most` text bytes (one row at least): slice, bytes, offsets."""
    data, off = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield batch.slice(row, end - row), data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 to uint64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX2)
    x ^= x >> np.uint64(31)
    return x


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and its inverse modulo 2**64, for j <= WINDOW."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(WINDOW + 1, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


@cache
def spaces(extra: bytes = b"") -> np.ndarray:
    """True for the bytes 0x20 and 0x09 to 0x0D, and those of extra."""
    out = np.zeros(256, bool)
    out[[*b" \t\n\x0b\x0c\r", *extra]] = True
    return out


@cache
def lowered() -> np.ndarray:
    """The byte map that lower-cases A to Z."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of True in a flat mask; a run ends where a text ends."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span lies. Spans in ascending order."""
    p, inverse = powers()
    values, sums = _byte_values(), np.zeros(len(start), np.uint64)

    def add(low: int, high: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * p[: high - low], out=c[1:])
        return (c[b - low] - c[a - low]) * inverse[a - low]

    i = 0
    while i < len(start):
        low = int(start[i])
        j = int(np.searchsorted(end, low + WINDOW, "right"))
        if j > i:
            sums[i:j] = add(low, int(end[j - 1]), start[i:j], end[i:j])
            i = j
            continue
        for k, at in enumerate(range(low, int(end[i]), WINDOW)):  # a span longer than a window
            stop = min(at + WINDOW, int(end[i]))
            sums[i : i + 1] += add(at, stop, np.array([at]), np.array([stop])) * np.uint64(pow(BASE, k * WINDOW, 1 << 64))
        i += 1
    return mix(sums + (end - start).astype(np.uint64) * np.uint64(MIX2))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than 0x20 and 0x09 to 0x0D, A to Z lower-cased) and their text numbers."""
    start, end, text = runs(~spaces()[data], off)
    return hash_spans(lowered()[data], start, end), text


def shingles(w: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, with repeats, and their text numbers.

    A text with 1 to k - 1 words gives its whole word sequence as one shingle; one without words gives none.
    """
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    out, owner = [], []
    if len(w) >= k:
        h = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(BASE) + w[j : len(w) - k + 1 + j]
        same = text[: len(w) - k + 1] == text[k - 1 :]
        out.append(mix(h[same]))
        owner.append(text[: len(w) - k + 1][same])
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        h = np.full(len(short), m, np.uint64)
        for j in range(m):
            h = h * np.uint64(BASE) + w[first[short] + j]
        out.append(mix(h))
        owner.append(short)
    out, owner = np.concatenate(out), np.concatenate(owner)
    return out, owner


def distinct_sets(h: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, end to end, and n_texts + 1 offsets."""
    if len(owner) and (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    cut = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n_texts)))).astype(np.int64)
    h = h.copy()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=n_texts)))).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
