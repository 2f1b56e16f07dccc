"""Container files as chunk rows, read by seeks: spark.read.format("tessera_chunks").load(path).

- Files that path filters rule out are not opened. Headers are walked (16 bytes each); a chunk's payload is read only if the row passes all filters
  on header columns and payload or crc_ok is asked for; the stem columns read the first bytes of fragments only.
- A file is left at the first chunk after which none can pass: an upper bound of chunk_no or an offset, or all of the named (fourcc, repeat_index) seen.
- What is asked for is the schema: `.schema("path string, fourcc string")` or read_chunks(columns=...) reads no payload. (Spark tells a Python source
  its filters, but not the columns that a query drops later.)
- Option payloads: small (default: as a lazy scan, audio and large payloads stay null), all, or none.
- Option split (bytes, 128 MB): small files share a task; with payloads=all a larger file is cut into byte ranges, each with the chunks that begin in it.
- The driver lists folder after folder until it has MOST_LISTED files; each folder that is left goes to a task, which lists it and reads its files whole.

A file that breaks off, or is no container, gives the chunks before that. Names that begin with `_` or `.` are left out.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from tessera.kernels import container as ct
from tessera.kernels import package

CHUNKS = (
    "path string, chunk_no int, fourcc string, chunk_offset long, payload_offset long, payload_length long, flags int, stored_crc long, repeat_index int, "
    "stem_id string, part_index int, part_count int, crc_ok boolean, payload binary"
)
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
TYPES = {c.split()[0]: KINDS[c.split()[1]] for c in CHUNKS.split(", ")}
STEM, LOADED = ("stem_id", "part_index", "part_count"), ("crc_ok", "payload")
#: Bytes of a fragment that hold its header; what a task opens a file for; rows are handed on at so many bytes.
FRAGMENT_HEADER, OPEN_COST, BATCH_BYTES = 128, 1 << 20, 8 << 20
#: Files after which the driver lists no further folder; rows of a batch of metadata.
MOST_LISTED, BATCH_ROWS = 10_000, 500


def _passes(f: ds.Filter, value) -> bool:
    """Whether a value that may be null passes, by SQL's rules (null passes no comparison)."""
    if isinstance(f, ds.Not):
        return value is not None and not _passes(f.child, value)
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return (value is None) == isinstance(f, ds.IsNull)
    if value is None:
        return False
    match f:
        case ds.EqualTo() | ds.EqualNullSafe():
            return value == f.value
        case ds.In():
            return value in f.value
        case ds.GreaterThan():
            return value > f.value
        case ds.GreaterThanOrEqual():
            return value >= f.value
        case ds.LessThan():
            return value < f.value
        case ds.LessThanOrEqual():
            return value <= f.value
        case ds.StringStartsWith():
            return value.startswith(f.value)
        case ds.StringEndsWith():
            return value.endswith(f.value)
        case ds.StringContains():
            return f.value in value
    raise ValueError(f"a filter that isn't known: {f}")


def _column(f: ds.Filter) -> str | None:
    """The column of a filter that a scan can answer, or None."""
    if isinstance(f, ds.Not):
        return None if isinstance(f.child, ds.Not | ds.IsNull | ds.IsNotNull | ds.EqualNullSafe) else _column(f.child)
    known = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.IsNull, ds.IsNotNull, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
    value = getattr(f, "value", 0)
    if not isinstance(f, known) or len(f.attribute) != 1 or value is None or isinstance(f, ds.In) and None in value:
        return None
    return f.attribute[0] if f.attribute[0] in TYPES and f.attribute[0] not in LOADED else None


@dataclass
class Ask:
    """What a scan is asked for."""

    columns: Sequence[str] = tuple(TYPES)
    filters: list = field(default_factory=list)
    payloads: str = "small"

    def of(self, column: str) -> list:
        return [f for f in self.filters if _column(f) == column]

    def passes(self, column: str, value) -> bool:
        return all(_passes(f, value) for f in self.of(column))

    def most(self, column: str) -> float:
        """The greatest value that passes a column's filters, as far as they bound it."""
        out = float("inf")
        for f in self.of(column):
            match f:
                case ds.EqualTo() | ds.LessThan() | ds.LessThanOrEqual():
                    out = min(out, f.value)
                case ds.In():
                    out = min(out, max(f.value, default=-1))
        return out

    def names(self) -> set[str] | None:
        """The only fourccs that can pass, if filters name them."""
        out = None
        for f in self.of("fourcc"):
            own = {f.value} if isinstance(f, ds.EqualTo) else set(f.value) if isinstance(f, ds.In) else None
            out = out if own is None else own if out is None else out & own
        return out

    def loads(self, fourcc: str, size: int) -> bool:
        return self.payloads == "all" or self.payloads == "small" and ct.wanted(fourcc, size)


def scan(read: Callable[[int, int], bytes], size: int, ask: Ask, path: str = "", start: int = 0, end: int | None = None) -> Iterator[dict]:
    """The rows of a file that `read(offset, length)` reads, of chunks that begin in start .. end."""
    names, most_no, most_repeat = ask.names(), ask.most("chunk_no"), ask.most("repeat_index")
    most_at = min(ask.most("chunk_offset"), ask.most("payload_offset"), (size if end is None else end) - 1)
    header = [c for c in TYPES if c not in STEM + LOADED and ask.of(c)]
    stem_asked, stem_filtered = any(c in ask.columns for c in STEM), any(ask.of(c) for c in STEM)
    left = dict.fromkeys(names or (), most_repeat + 1) if names is not None and most_repeat < float("inf") else None
    if not ask.passes("path", path) or left == {}:
        return
    try:
        for c in ct.index(read, size, lambda *_: False):
            if c.number > most_no or c.offset > most_at:
                return
            row = {"path": path, "chunk_no": c.number, "fourcc": c.fourcc, "chunk_offset": c.offset, "payload_offset": c.payload_offset, "payload_length": c.length, "flags": c.flags, "stored_crc": c.stored_crc, "repeat_index": c.repeat}
            if c.offset >= start and all(ask.passes(n, row[n]) for n in header):
                row |= dict.fromkeys(STEM)
                if (stem_asked or stem_filtered) and c.fourcc == "STDF":
                    row |= package.fragment_header(read(c.payload_offset, min(c.length, FRAGMENT_HEADER))) or {}
                if not stem_filtered or all(ask.passes(n, row[n]) for n in STEM):
                    row["payload"] = row["crc_ok"] = None
                    if any(n in ask.columns for n in LOADED) and ask.loads(c.fourcc, c.length):
                        row["payload"] = bytes(read(c.payload_offset, c.length))
                        row["crc_ok"] = ct.crc_ok(c, row["payload"])
                    yield row
            if left is not None and c.fourcc in left:
                left[c.fourcc] -= 1
                if all(n <= 0 for n in left.values()):
                    return
    except ct.ContainerError:
        return


def _system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri, "") if "://" not in uri else (*fs.FileSystem.from_uri(uri), uri[: uri.index("://") + 3])


def _listed(system, folder: str) -> tuple[list, list]:
    """Files and folders of a folder, hidden ones left out."""
    from pyarrow import fs

    found = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name[:1] not in ("_", ".")]
    return [f for f in found if f.type == fs.FileType.File], [f.path for f in found if f.type == fs.FileType.Directory]


def _tree(system, folders: list[str], most: float = float("inf")) -> Iterator[tuple[list, list]]:
    """The files of each folder and of those below, one folder at a time; with the last ones the folders that are left once there are more than `most` files."""
    n, left = 0, list(folders)
    while left:
        files, more = _listed(system, left.pop())
        left += more
        n += len(files)
        if n > most or not left:
            yield files, left
            return
        yield files, []


def _found(root: str) -> tuple[list[tuple[str, int]], list[str]]:
    """(path, size) of files under root, or of root itself, and the folders that were not listed. A folder's own files are listed at once, however many."""
    from pyarrow import fs

    system, base, head = _system(root)
    if (own := system.get_file_info(base)).type != fs.FileType.Directory:
        return [(head + own.path, own.size)] if own.type == fs.FileType.File else [], []
    files, left = [], []
    for some, left in _tree(system, [base], MOST_LISTED):
        files += [(head + f.path, f.size) for f in some]
    return files, [head + f for f in left]


def _below(folder: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files under a folder."""
    system, base, head = _system(folder)
    for files, _ in _tree(system, [base]):
        yield from ((head + f.path, f.size) for f in files)


class _Files(ds.InputPartition):
    """Files, or ranges of files: (path, start, end); folders that a task lists: (path, 0, None)."""

    def __init__(self, parts: list[tuple[str, int, int | None]]):
        super().__init__(len(parts))
        self.parts = parts


class _Reader(ds.DataSourceReader):
    def __init__(self, options, schema):
        self.root, self.glob, self.split = options["path"], options.get("pathglobfilter"), int(options.get("split", 128 << 20))
        self.ask = Ask([f.name for f in schema.fields], [], options.get("payloads", "small").lower())
        if self.ask.payloads not in ("small", "all", "none") or not set(self.ask.columns) <= set(TYPES):
            raise ValueError(f"payloads must be small, all or none, and columns of: {CHUNKS}")

    def pushFilters(self, filters):
        for f in filters:
            if _column(f):
                self.ask.filters.append(f)
            else:
                yield f

    def _asked(self, path: str) -> bool:
        return (not self.glob or fnmatch.fnmatch(path.rpartition("/")[2], self.glob)) and self.ask.passes("path", path)

    def partitions(self):
        files, folders = _found(self.root)
        whole = self.ask.payloads == "all" and "payload" in self.ask.columns
        parts, now, cost = [], [], 0
        for path, size in sorted(((p, s) for p, s in files if self._asked(p)), key=lambda x: -x[1]):
            for start in range(0, max(size, 1), self.split) if whole else [0]:
                end = min(start + self.split, size) if whole else size
                add = OPEN_COST + (end - start if whole else min(size, OPEN_COST))
                if now and cost + add > self.split:
                    parts, now, cost = [*parts, _Files(now)], [], 0
                now.append((path, start, end))
                cost += add
        parts += [_Files(now)] if now else []
        return [_Files([(f, 0, None)]) for f in folders] + parts or [_Files([])]  # the long ones first

    def _ranges(self, part: _Files) -> Iterator[tuple[str, int, int]]:
        for path, start, end in part.parts:
            if end is None:
                yield from ((p, 0, size) for p, size in _below(path) if self._asked(p))
            else:
                yield path, start, end

    def read(self, part):
        rows, size = [], 0
        schema = pa.schema([(n, TYPES[n]) for n in self.ask.columns])
        for path, start, end in self._ranges(part):
            system, name, _ = _system(path)
            with system.open_input_file(name) as f:

                def read(at, n, f=f):
                    f.seek(at)
                    return f.read(n)

                for row in scan(read, f.size(), self.ask, path, start, end):
                    rows.append({n: row[n] for n in self.ask.columns})
                    size += 64 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class ChunkSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "tessera_chunks"

    def schema(self):
        return CHUNKS

    def reader(self, schema):
        return _Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)


def read_chunks(spark: SparkSession, path: str, columns: Sequence[str] | None = None, payloads: str = "small", split: int = 128 << 20) -> DataFrame:
    """The chunk rows under path with these columns only (None: all); filters that follow are pushed into the scan."""
    register(spark)
    reader = spark.read.format("tessera_chunks").option("payloads", payloads).option("split", split)
    if columns is not None:
        kinds = {c.split()[0]: c for c in CHUNKS.split(", ")}
        reader = reader.schema(", ".join(kinds[c] for c in columns))
    return reader.load(path)


# ---------------------------------------------------------------- what files begin with

HEADS = "path string, length long, codec_id int, channels int, bits int, preset int, sample_rate long, total_samples long, encoder int, meta array<struct<key:string,value:string>>, cover_mime string, cover binary"
#: Bytes of a file, or of a packaged track, in which its metadata is looked for.
PREFIX = 3 << 20


def metadata_row(read: Callable[[int, int], bytes], size: int, prefix: int = PREFIX) -> dict:
    """HEAD, META and COVR among the first `prefix` bytes; other payloads in between are passed over, not read. Null where they aren't, never an error."""
    head, meta, cover = ct.metadata_of(read, min(size, prefix))
    return (head or {}) | {"meta": [{"key": k, "value": v} for k, v in meta], "cover_mime": cover[0] if cover else None, "cover": cover[1] if cover else None}


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files under a folder, or of one file: folders are listed by tasks once the driver has listed MOST_LISTED files."""
    files, folders = _found(path)
    units = [(p, n) for p, n in files] + [(f, None) for f in folders]

    def run(batches):
        for b in batches:
            for name, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                rows = iter([(name, length)]) if length is not None else _below(name)
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["path", "length"])

    # a folder is a task's work, and so are some hundred files
    n = max(1, len(folders), len(units) // 256, min(len(units), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(units, "path string, length long").repartition(n).mapInArrow(run, "path string, length long")


def read_metadata(files: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """HEADS of files (path, length), as list_files or spark.read.format("binaryFile") lists them: the latter's content column is not read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = files.sparkSession.createDataFrame([], HEADS).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                system, name, _ = _system(path)
                with system.open_input_file(name) as f:

                    def read(at, n, f=f):
                        f.seek(at)
                        return f.read(n)

                    rows.append({"path": path, "length": length} | metadata_row(read, length, prefix))
                size += len(rows[-1]["cover"] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "length").mapInArrow(run, schema)
