"""Album packages as DataFrames: directory rows, fragments by range, tracks put together and checked, and what packaged tracks begin with. The sink writes them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.text import hash_or_null, same_hash
from tessera.kernels import package
from tessera.operators import scans
from tessera.sources import chunk_source


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    system, path = (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _reader(f):
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read


def read_ranges(wanted: DataFrame) -> DataFrame:
    """wanted (path, at, length, more columns) and payload: only these bytes are read. Neighbours of a file are read by one task."""

    def run(batches):
        for b in batches:
            files, out = {}, []
            for path, at, n in zip(*(b.column(c).to_pylist() for c in ("path", "at", "length")), strict=True):
                if path not in files:
                    files[path] = _open(path)
                out.append(_reader(files[path])(at, n))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "payload"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields) + ", payload binary"
    return wanted.mapInArrow(run, schema)


def load_payloads(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """The payloads of the chunks (path, fourcc, repeat_index) in keys, read by range and checked: path, fourcc, repeat_index, payload, crc_ok."""
    some = chunks.join(keys, ["path", "fourcc", "repeat_index"], "left_semi")
    got = read_ranges(some.select("path", F.col("payload_offset").alias("at"), F.col("payload_length").alias("length"), "fourcc", "repeat_index", "stored_crc"))
    return got.select("path", "fourcc", "repeat_index", "payload", (F.crc32("payload") == F.col("stored_crc")).alias("crc_ok"))


DIRECTORY = "package string, path string, pos int, track_id string, at long, length long, problem string"


def index_packages(paths: DataFrame) -> DataFrame:
    """A row per directory entry of the packages (path): header, manifest and directory are read, nothing else. A bad file is one row with a problem.

    path is the file that has the fragment: the package, or one of its segments.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                try:
                    with _open(path) as f:
                        manifest, entries = package.index(_reader(f))
                    for k, (t, at, n) in enumerate(entries):
                        segment, offset = package.place(manifest, entries, at)
                        rows.append((path, path if segment is None else f"{path}.{segment:05d}", k, t, offset, n, None))
                except (ValueError, OSError) as e:
                    rows.append((path, path, None, None, None, None, str(e)))
            c = list(zip(*rows, strict=True))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["package", "path", "pos", "track_id", "at", "length", "problem"])

    return paths.select("path").mapInArrow(run, DIRECTORY)


def index_folder(spark: SparkSession, root: str) -> DataFrame:
    """The same for the packages that the sink wrote under root; a package's segments may lie in other folders of it than the package."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.regexp_extract("path", r"/part-[0-9a-f]{32}/(.*)$", 1)
    files = files.select("path", name.alias("name")).where("name <> ''")
    rows = index_packages(files.where(r"NOT name RLIKE '[.][0-9]{5}$'"))
    segments = files.where(r"name RLIKE '[.][0-9]{5}$'").select(F.col("path").alias("_found"), F.col("name").alias("_name"))
    alone, cut = rows.where("path = package"), rows.where("path <> package")
    cut = cut.withColumn("_name", F.regexp_extract("path", r"/part-[0-9a-f]{32}/(.*)$", 1)).join(segments, "_name", "left")
    missing = F.coalesce("problem", F.when(F.col("_found").isNull(), "a segment is missing"))
    return alone.unionByName(cut.select("package", F.coalesce("_found", "path").alias("path"), "pos", "track_id", "at", "length", missing.alias("problem")))


def fragments(directory: DataFrame) -> DataFrame:
    """The directory's records read and decoded: path (of the package), track_id, part_index, part_count, crc_ok, payload. A record that is none has a null part."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        names = ["path", "track_id", "part_index", "part_count", "crc_ok", "payload"]
        for b in batches:
            rows = []
            for path, track, raw in zip(*(b.column(c).to_pylist() for c in ("package", "track_id", "payload")), strict=True):
                f = package.read_fragment(raw)
                rows.append((path, track, f["part_index"], f["part_count"], f["crc_ok"], f["payload"]) if f and f["track_id"] == track else (path, track, None, None, False, None))
            c = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names)

    some = directory.where("problem IS NULL").select("path", "at", "length", "track_id", "package")
    return read_ranges(some).mapInArrow(run, "path string, track_id string, part_index int, part_count int, crc_ok boolean, payload binary")


def report(parts: DataFrame) -> DataFrame:
    """Per track: fragments, missing parts, bad CRCs, and whether it can be put together. Payloads are not moved."""
    g = parts.groupBy("path", "track_id").agg(F.count("*").alias("fragments"), F.collect_set("part_index").alias("seen"), F.max("part_count").alias("n"), F.countDistinct("part_count").alias("counts"), F.count_if(~F.col("crc_ok")).alias("bad_crc"), F.countDistinct("part_index").alias("d"))
    missing = F.when(F.col("n") > 0, F.array_sort(F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("seen"))))
    ok = (F.col("counts") == 1) & (F.col("bad_crc") == 0) & (F.size(missing) == 0) & (F.col("d") == F.col("fragments"))
    return g.select("path", "track_id", "fragments", missing.alias("missing"), "bad_crc", F.coalesce(ok, F.lit(False)).alias("complete"))


def load_tracks(parts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per complete track its bytes and SHA-256. A track is one row, as a file is.

    expected (path, track_id, sha256, bytes): also hash_ok and length_ok, null where nothing is expected.
    """
    whole = report(parts).where("complete").select("path", "track_id")
    got = parts.join(whole, ["path", "track_id"]).groupBy("path", "track_id").agg(F.array_sort(F.collect_list(F.struct("part_index", "payload"))).alias("a"))
    data = F.aggregate("a", F.lit(b""), lambda acc, x: F.concat(acc, x["payload"]))
    out = got.select("path", "track_id", data.alias("content")).withColumn("sha256", F.sha2("content", 256))
    if expected is None:
        return out
    want = expected.select("path", "track_id", hash_or_null(F.col("sha256")).alias("_hash"), F.col("bytes").alias("_bytes"))
    out = out.join(want, ["path", "track_id"], "left")
    return out.select("path", "track_id", "content", "sha256", same_hash(F.col("_hash"), F.col("sha256")).alias("hash_ok"), (F.octet_length("content") == F.col("_bytes")).alias("length_ok"))


def track_metadata(directory: DataFrame, prefix: int = chunk_source.PREFIX) -> DataFrame:
    """HEAD, META and COVR of packaged container files, from the first `prefix` bytes of each: chunk_source.HEADS without path and length, by package and track_id.

    Only fragments that begin before that are read, and of them only what lies before it.
    """
    header = package.FRAGMENT_HEADER + F.octet_length("track_id")
    some = directory.where("problem IS NULL").withColumn("header", header)
    some = scans.running(some, ["package", "track_id"], ["pos"], {"before": F.col("length") - F.col("header")}, before=True).where(F.col("before") < prefix)
    some = some.withColumn("length", F.least("length", F.lit(prefix) - F.col("before") + F.col("header")).cast("long"))
    names = [c for c in chunk_source.HEADS.split(", ") if c.split()[0] not in ("path", "length")]
    schema = directory.sparkSession.createDataFrame([], "package string, track_id string, " + ", ".join(names)).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = []
            for name, track, pieces in zip(*(b.column(c).to_pylist() for c in ("package", "track_id", "pieces")), strict=True):
                data = b"".join(package.fragment_prefix(x["payload"]) for x in pieces)
                rows.append({"package": name, "track_id": track} | chunk_source.metadata_row(lambda at, n, data=data: data[at : at + n], len(data), prefix))
            yield pa.RecordBatch.from_pylist(rows, arrow)

    read = read_ranges(some.select("path", "at", "length", "track_id", "package", "pos"))
    whole = read.groupBy("package", "track_id").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("pieces"))  # `prefix` bytes at most
    return whole.mapInArrow(run, schema)
