"""The source that reads by seeks, and the sink that commits."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tessera.kernels import container as ct
from tessera.kernels import package
from tessera.sources import chunk_source as cs
from tessera.sources import packages, sink


def sample(audio=50_000, stems=2):
    stdf = [("STDF", package.fragment(f"stem-{s}", p, 2, bytes([s]) * 3000)) for s in range(stems) for p in range(2)]
    return ct.write(ct.head_bytes(0, 2, 16, 0, 48000, 9), [("title", "T"), ("artist", "A")], ct.cover_bytes("image/png", b"\x89PNG" * 100), [(0, 0, 0, b"a" * audio)], optional=[("MOOD", b"{}"), ("VIBE", b"{}")], extra=stdf)


def counted(data):
    log = []

    def read(at, n):
        log.append(n)
        return data[at : at + n]

    return read, log


ALL = cs.Ask()


@pytest.mark.parametrize(
    "filters",
    [
        [ds.EqualTo(("fourcc",), "META")], [ds.In(("fourcc",), ("HEAD", "COVR")), ds.EqualTo(("repeat_index",), 0)], [ds.LessThanOrEqual(("chunk_no",), 1)], [ds.Not(ds.EqualTo(("fourcc",), "AUDI")), ds.GreaterThan(("payload_length",), 100)],
        [ds.EqualTo(("stem_id",), "stem-1")], [ds.IsNotNull(("stem_id",)), ds.EqualTo(("part_index",), 1)], [ds.StringStartsWith(("fourcc",), "M")], [ds.IsNull(("fourcc",))], [ds.EqualTo(("fourcc",), "STDF"), ds.LessThan(("repeat_index",), 2)], [ds.EqualTo(("path",), "other")],
    ],
)
def test_filters_give_the_rows_that_pass(filters):
    data = sample()
    every = list(cs.scan(lambda at, n: data[at : at + n], len(data), cs.Ask(payloads="all"), "f"))
    want = [r for r in every if all(cs._passes(f, r[f.attribute[0] if not isinstance(f, ds.Not) else f.child.attribute[0]]) for f in filters)]
    assert list(cs.scan(lambda at, n: data[at : at + n], len(data), cs.Ask(filters=filters, payloads="all"), "f")) == want


def test_bytes_read():
    data = sample(500_000)
    read, log = counted(data)
    list(cs.scan(read, len(data), cs.Ask(payloads="all")))
    assert sum(log) > 500_000
    read, log = counted(data)
    rows = list(cs.scan(read, len(data), cs.Ask(filters=[ds.EqualTo(("fourcc",), "META"), ds.EqualTo(("repeat_index",), 0)], payloads="all")))
    assert len(rows) == 1 and ct.meta(rows[0]["payload"]) == [("title", "T"), ("artist", "A")] and sum(log) < 150
    read, log = counted(data)
    assert len(list(cs.scan(read, len(data), cs.Ask(columns=["fourcc", "payload_length"])))) == 10 and sum(log) == ct.FILE_HEADER + 10 * ct.CHUNK_HEADER
    read, log = counted(data)
    assert len(list(cs.scan(read, len(data), cs.Ask(filters=[ds.EqualTo(("stem_id",), "stem-0")], payloads="all")))) == 2
    assert sum(log) < ct.FILE_HEADER + 10 * ct.CHUNK_HEADER + 4 * cs.FRAGMENT_HEADER + 2 * 3100
    read, log = counted(data)
    got = cs.metadata_row(read, len(data))
    assert got["cover_mime"] == "image/png" and len(got["cover"]) == 400 and got["total_samples"] == 9 and sum(log) < 1000


def test_ranges_share_a_file():
    data = sample(5000)
    whole = list(cs.scan(lambda at, n: data[at : at + n], len(data), cs.Ask(payloads="all")))
    parts = [r for start in range(0, len(data), 4000) for r in cs.scan(lambda at, n: data[at : at + n], len(data), cs.Ask(payloads="all"), "", start, min(start + 4000, len(data)))]
    assert parts == whole


def test_source(spark, tmp_path):
    data = sample(5000)
    files = spark.createDataFrame([(f"d/{i}.bin", data if i else data[:-5]) for i in range(6)] + [("bad.bin", b"??")], sink.FILES)
    sink.write_files(files.repartition(3), str(tmp_path / "in"))
    chunks = cs.read_chunks(spark, str(tmp_path / "in"), payloads="all", split=4000)
    assert chunks.count() == 59 and chunks.where("crc_ok").count() == 59 and chunks.rdd.getNumPartitions() > 6
    names = cs.read_chunks(spark, str(tmp_path / "in"), ["path", "fourcc"]).where("fourcc IN ('HEAD', 'AUDI') AND path LIKE '%3.bin'")
    assert sorted(r.fourcc for r in names.collect()) == ["AUDI", "HEAD"] and "payload" not in names.columns
    plan = chunks.where("fourcc = 'MOOD'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan or "fourcc" not in plan.split("Filter (")[1].split("\n")[0]
    odd = chunks.where("payload_length % 2 = 0 AND fourcc <> 'AUDI' AND (chunk_no = 1 OR stem_id = 'stem-1')").select("fourcc", "stem_id").distinct().collect()
    assert {(r.fourcc, r.stem_id) for r in odd} <= {("META", None), ("STDF", "stem-1")}
    with pytest.raises(Exception, match="payloads must be"):
        cs.read_chunks(spark, str(tmp_path / "in"), payloads="some").count()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "in"))
    heads = {os.path.basename(r.path): r for r in cs.read_metadata(listed).collect()}
    assert heads["3.bin"].codec_id == 0 and [tuple(m) for m in heads["0.bin"].meta] == [("title", "T"), ("artist", "A")] and heads["bad.bin"].codec_id is None and heads["bad.bin"].meta == []


def test_sink_commits_whole_jobs(spark, tmp_path):
    at = str(tmp_path / "out")
    one = spark.createDataFrame([("a", b"1"), ("b/c", None)], sink.FILES)
    sink.write_files(one, at)
    sink.write_files(spark.createDataFrame([("a", b"x" * 9)], sink.FILES), at)
    read = lambda: sorted(open(f, "rb").read() for f in glob.glob(at + "/part-*/**", recursive=True) if os.path.isfile(f))
    assert read() == [b"", b"1", b"x" * 9] and os.path.exists(at + "/_SUCCESS")

    def fails(batches):
        for i, b in enumerate(batches):
            yield b
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        sink.write_files(spark.createDataFrame([(f"n{i}", b"z") for i in range(40)], sink.FILES).repartition(4).mapInArrow(fails, sink.FILES), at)
    assert read() == [b"", b"1", b"x" * 9] and not glob.glob(at + "/_staging*")
    for bad in ("/abs", "../up", "a//b", ""):
        with pytest.raises(Exception, match="not a relative path"):
            sink.write_files(spark.createDataFrame([(bad, b"z")], sink.FILES), at)
    with pytest.raises(Exception, match="follow one another"):
        sink.write_files(spark.createDataFrame([("a", b"1"), ("b", b"1"), ("a", b"2")], sink.FILES).coalesce(1), at)
    sink.write_files(one, at, overwrite=True)
    assert read() == [b"", b"1"]


def test_a_retried_task_leaves_one_copy(spark, tmp_path):
    """A task's first attempt writes files and dies: only what the commit was told of is there."""
    w = sink._Writer(str(tmp_path), False)
    import pyarrow as pa

    def rows(die):
        yield pa.RecordBatch.from_pydict({"path": pa.array(["f"]), "content": pa.array([b"whole"], pa.binary())})
        if die:
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        w.write(rows(True))
    told = w.write(rows(False))
    assert not glob.glob(str(tmp_path / "part-*"))
    w.commit([told, None])
    assert len(glob.glob(str(tmp_path / "part-*/f"))) == 1 and not glob.glob(str(tmp_path / "_staging*"))


def test_containers(spark, tmp_path):
    rows = [("x", 2, "AUDI", ct.frames_bytes([(0, 0, 0, b"pcm")])), ("x", 0, "HEAD", ct.head_bytes(0, 1, 16, 0, 44100, 1)), ("y", 5, "MOOD", None), ("x", 1, "META", ct.meta_bytes([("title", "t")]))]
    sink.write_containers(spark.createDataFrame(rows, "path string, chunk_no int, fourcc string, payload binary"), str(tmp_path))
    parsed = ct.parse(open(glob.glob(str(tmp_path / "part-*/x"))[0], "rb").read())
    assert parsed.meta == [("title", "t")] and parsed.frames == [(0, 0, 0, b"pcm")] and [c.fourcc for c in parsed.chunks] == ["HEAD", "META", "AUDI"]


@pytest.mark.parametrize("segment", [sink.SEGMENT, 2500])
def test_packages(spark, tmp_path, segment):
    tracks = [("alb", "t1", 2, sample(9000)), ("alb", "t2", 1, b"b" * 10), ("alb", "t3", 3, None), ("two/b", "t1", 1, sample(10))]
    sink.write_packages(spark.createDataFrame(tracks, "album string, track_id string, pos int, content binary"), str(tmp_path), 1024, segment)
    files = [f for f in glob.glob(str(tmp_path / "part-*/**"), recursive=True) if os.path.isfile(f)]
    assert (len(files) == 2) == (segment == sink.SEGMENT)
    directory = packages.index_folder(spark, str(tmp_path))
    heads = sorted({r.package for r in directory.collect()})
    assert len(heads) == 2 and directory.where("problem IS NOT NULL").count() == 0 and (directory.where("path <> package").count() > 0) == (segment != sink.SEGMENT)
    parts = packages.fragments(directory)
    want = {(os.path.basename(a), t): hashlib.sha256(c).hexdigest() for a, t, _, c in tracks if c}
    expected = spark.createDataFrame([(f, t, h, 0) for f in heads for (a, t), h in want.items() if os.path.basename(f) == a], "path string, track_id string, sha256 string, bytes long")
    got = packages.load_tracks(parts, expected).collect()
    assert {(os.path.basename(r.path), r.track_id): r.sha256 for r in got} == want and all(r.hash_ok and not r.length_ok for r in got)
    meta = {(os.path.basename(r.package), r.track_id): [tuple(m) for m in r.meta] for r in packages.track_metadata(directory, 600).collect()}
    assert meta[("alb", "t1")] == meta[("b", "t1")] == [("title", "T"), ("artist", "A")] and meta[("alb", "t2")] == []
