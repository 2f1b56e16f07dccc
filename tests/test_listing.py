"""Folders of many files are listed by tasks: the driver knows few of them."""

import pytest
from pyspark.sql import functions as F

from tessera.kernels import container as ct
from tessera.sources import chunk_source as cs

FOLDERS, FILES = 3, 6000


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    root = tmp_path_factory.mktemp("many")
    for d in range(FOLDERS):
        (at := root / f"part-{d}/below").mkdir(parents=True)
        for i in range(FILES):
            (at / f"f{d}-{i}").write_bytes(ct.write(ct.head_bytes(0, 1, 16, 0, 44100, i), [("title", f"T{d}-{i}")], frames=[(0, 0, 0, b"x")]))
    (root / "_staging").mkdir()
    (root / "part-0/below/.hidden").write_bytes(b"")
    (root / "_staging/left").write_bytes(b"")
    return str(root)


def test_the_driver_lists_few_files(many):
    class Schema:
        fields = [type("Field", (), {"name": n}) for n in ("path", "fourcc")]

    parts = cs._Reader({"path": many}, Schema).partitions()
    assert sum(len(p.parts) for p in parts) <= 2 * FILES + FOLDERS
    assert sum(p.parts[0][2] is None for p in parts) == 1


def test_all_files_are_read(spark, many):
    chunks = cs.read_chunks(spark, many, ["path", "fourcc", "payload", "crc_ok"], "all").where("fourcc = 'AUDI' AND crc_ok")
    assert chunks.agg(F.count("*"), F.count_distinct("path")).first() == (FOLDERS * FILES, FOLDERS * FILES)
    some = spark.read.format("tessera_chunks").option("pathGlobFilter", "f*-17").load(many)
    assert some.select("path").distinct().count() == FOLDERS


def test_metadata_of_all_files(spark, many):
    listed = cs.list_files(spark, many)
    heads = cs.read_metadata(listed)
    assert heads.select(F.expr("regexp_extract(path, '([^/]*)$', 1)").alias("f"), F.expr("meta[0].value").alias("t"), "total_samples").where("t = concat('T', substring(f, 2)) AND endswith(f, concat('-', total_samples))").distinct().count() == FOLDERS * FILES
    one = cs.list_files(spark, f"{many}/part-0/below/f0-1").collect()
    assert [r.path.endswith("f0-1") and r.length > 0 for r in one] == [True] and cs.list_files(spark, f"{many}/_staging/nothing").collect() == []


def test_ordered_chunks_are_written_as_shuffled_ones(spark, tmp_path):
    from tessera.sources import sink

    rows = [(f"f{i % 7}", i // 7, "DATA", bytes([i]) * i) for i in range(70)]
    chunks = spark.createDataFrame(rows, "path string, chunk_no int, fourcc string, payload binary")
    sink.write_containers(chunks, str(tmp_path / "a"))
    sink.write_containers(chunks.repartition(2, "path").sortWithinPartitions("path", "chunk_no"), str(tmp_path / "b"), ordered=True)
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / x).glob("part-*/*")} for x in "ab")
    want = {f"f{k}": ct.file_header() + b"".join(ct.chunk("DATA", bytes([i]) * i) for i in range(k, 70, 7)) for k in range(7)}
    assert a == b == want
