"""Packages on disk, range loads and the keyed store."""

import hashlib

from pyspark.sql import functions as F

from tessera.kernels import container as ct
from tessera.kernels import package
from tessera.operators.store import Store
from tessera.sources import containers, packages


def test_packages(spark, tmp_path):
    tracks = [("alb", "t1", 2, b"a" * 3000), ("alb", "t2", 1, b"b" * 10)]
    by_pos = sorted(tracks, key=lambda t: t[2])
    (tmp_path / "alb.bin").write_bytes(package.write({"format": "embedded", "tracks": []}, [(t, c) for _, t, _, c in by_pos], 1024))
    (tmp_path / "bad.bin").write_bytes(b"??")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("alb.bin", "bad.bin")], "path string")
    directory = packages.index_packages(paths)
    assert [r.track_id for r in directory.where("problem IS NULL").orderBy("pos").collect()] == ["t2", "t1", "t1", "t1"] and directory.where("problem IS NOT NULL").count() == 1
    parts = packages.fragments(directory)
    assert {r.track_id: r.sha256 for r in packages.load_tracks(parts).collect()} == {t: hashlib.sha256(c).hexdigest() for _, t, _, c in tracks}
    broken = packages.report(parts.where("NOT (track_id = 't1' AND part_index = 1)")).collect()
    assert {r.track_id: (r.complete, r.missing) for r in broken} == {"t1": (False, [1]), "t2": (True, [])}


def test_range_loads(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(ct.write(ct.head_bytes(0, 1, 16, 0, 44100, 1), frames=[(0, 0, 0, b"xyz")]))
    containers.register(spark)
    chunks = spark.read.format("tessera_chunks").load(str(tmp_path))
    keys = chunks.where("fourcc = 'AUDI'").select("path", "fourcc", "repeat_index")
    got = packages.load_payloads(chunks, keys).collect()
    assert len(got) == 1 and got[0].crc_ok and ct.frames(got[0].payload) == [(0, 0, 0, b"xyz")]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "lib"), "id", "id string, title string")
    assert s.all().count() == 0
    s.put(spark.createDataFrame([("a", "1"), ("b", "2")], "id string, title string"))
    s.put(spark.createDataFrame([("b", "3")], "id string, title string"))
    assert {r.id: r.title for r in s.all().collect()} == {"a": "1", "b": "3"} and s.get("b").first().title == "3"
    s.delete(s.all().where(F.col("id") == "a"))
    assert s.all().count() == 1
    s.clear()
    assert s.all().count() == 0
