"""Manifests, playing rows and profiles."""

import json

from pyspark.sql import functions as F

from tessera.kernels import container as ct
from tessera.operators import albums
from tessera.sources.containers import parse_files


def test_manifest(spark):
    good = {"format": "album", "tracks": [{"trackId": "b", "file": "d/B.bin", "trackNumber": 2}, {"trackId": "a", "file": "A.bin", "trackNumber": 1}, {"trackId": "c", "file": "C.bin", "discNumber": 2, "trackNumber": 1}]}
    bad = {"format": "other", "tracks": [{"trackId": " ", "file": "../x"}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "[1"), (4, None)], "id int, j string")
    got = albums.parse_manifest(df, "j", "album")
    problems = {r.id: r.problems for r in got.collect()}
    assert problems == {1: [], 2: ["format: expected album", "tracks[0].trackId: missing", "tracks[0].file: unsafe path"], 3: ["Invalid JSON"], 4: ["Invalid JSON"]}
    rows = albums.tracks(got.where("id = 1"), "id").orderBy("place").collect()
    assert [(r.trackId, r.base) for r in rows] == [("a", "a.bin"), ("b", "b.bin"), ("c", "c.bin")]


def test_playing(spark):
    rows = spark.createDataFrame([("x", 1, "l1", "r1"), ("x", 2, "l2", "l1"), ("y", 1, None, "r9")], "album string, pos int, loaded string, ref string")
    now = spark.createDataFrame([("x", "l1"), ("x", "zz"), ("y", "r9")], "album string, item string")
    assert {(r.album, r.item): r.pos for r in albums.playing(rows, "album", "pos", ["loaded", "ref"], now, "item").collect()} == {("x", "l1"): 1, ("x", "zz"): None, ("y", "r9"): 1}


def test_profile(spark):
    head = ct.head_bytes(0, 1, 16, 0, 44100, 1)
    files = [("full", ct.write(head, [("Title", "t")], frames=[(0, 0, 0, b"x")], optional=[("LYRC", b"{}"), ("STEM", b"{}")])), ("basic", ct.write(head, frames=[(0, 0, 0, b"x")])), ("bad", b"?")]
    got = albums.profile(parse_files(spark.createDataFrame(files, "path string, content binary"))).collect()
    assert {r.path: r.level for r in got} == {"full": "full", "basic": "basic", "bad": "unreadable"}


def test_hashes(spark):
    e = spark.createDataFrame([("a", "0" * 64), ("b", None), ("c", "bad")], "k string, sha256 string")
    a = spark.createDataFrame([("a", b"1"), ("b", b"2")], "k string, payload binary")
    assert {r.k: r.same for r in albums.expected_hashes(e, a, "k").collect()} == {"a": False, "b": None, "c": None}
    assert albums.storage(spark.createDataFrame([("s", 3), ("s", 5)], "s string, n int"), "s", "n").select(F.col("bytes")).first().bytes == 8
