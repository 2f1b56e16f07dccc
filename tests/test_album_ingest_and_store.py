"""Album ingest, saved albums, and the store that rewrites touched buckets only."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import album_ingest as ai
from tessera.operators.store import Store, StoreConflict


def test_first_album(spark):
    files = [("f", "x.MP5", 1), ("f", "b.mp5p", 3), ("f", "a.MP5P", 2), ("f", "notes.txt", 0), ("g", "y.mp5", 1), (None, "mp5", 1)]
    got = {r.d: tuple(r)[1:] for r in ai.first_album(spark.createDataFrame(files, "d string, n string, o int"), "d", "n", "o").collect()}
    assert got == {"f": ("a.MP5P", 1, 1), "g": (None, 1, 0), None: (None, 0, 1)}


ENTRIES = "album string, pos int, track_id string, file string, title string, artist string, duration_ms double, album_artist string"
TRACKS = "id string, name string, title string, artist string, duration_ms double, parse_error string, seq int"


def test_resolve(spark):
    entries = [
        ("al", 0, "id1", "a/One.mp5", None, None, None, "AA"), ("al", 1, "none", "a\\Two.MP5", "Own", None, 5.0, "AA"), ("al", 2, "none", "three.mp5", None, None, None, None),
        ("al", 3, "bad", "bad.mp5", None, None, None, "AA"), ("al", 4, None, None, None, None, None, None), ("b", 0, "id1", "x.mp5", None, "Me", 0.0, None),
    ]
    tracks = [
        ("id1", "other.mp5", "T1", "A1", 1000.4, None, 1), ("id2", "dir/two.mp5", "T2", "A2", 2000.6, None, 2), ("id3", "TWO.mp5", "T3", None, 3000.5, None, 3), ("bad", "bad.mp5", "B", "B", 1.0, "broken", 4), ("id1", "again.mp5", "T4", None, None, None, 0), (None, None, "N", None, None, None, 9),
    ]
    out = ai.resolve(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(tracks, TRACKS))
    got = {(r.album, r.pos): (r.display_title, r.display_artist, r.duration, r.missing, r.found_id, r.found_by) for r in out.collect()}
    assert got == {
        ("al", 0): ("T1", "A1", 1000, False, "id1", "id"), ("al", 1): ("Own", "AA", 5, False, "id3", "name"), ("al", 2): ("three", "", None, True, None, None),
        ("al", 3): ("bad", "AA", None, True, None, None), ("al", 4): (None, "", None, True, None, None), ("b", 0): ("T1", "Me", 0, False, "id1", "id"),
    }
    sums = {r.album: (r.resolved_count, r.missing_count, r.total_duration, r.found_files, r.missing_files) for r in ai.totals(out).collect()}
    assert sums["al"] == (2, 3, 1005, ["a/One.mp5", "a\\Two.MP5"], ["three.mp5", "bad.mp5", None]) and sums["b"] == (1, 0, None, ["x.mp5"], [])
    assert ai.resolve(spark.createDataFrame([], ENTRIES), spark.createDataFrame(tracks, TRACKS)).count() == 0
    assert ai.resolve(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame([], TRACKS)).where("missing").count() == 6


def test_directory_problems(spark):
    a = [("ok", 0, "x"), ("ok", 1, "y"), ("short", 0, "x"), ("short", 1, "y"), ("turned", 0, "x"), ("turned", 1, "y"), ("none", 0, "x")]
    b = [("ok", 1, "y"), ("ok", 0, "x"), ("short", 0, "x"), ("turned", 0, "y"), ("turned", 1, "x"), ("extra", 0, "x")]
    df = lambda rows: spark.createDataFrame(rows, "album string, pos int, track_id string")
    assert {r.album: r.problem for r in ai.directory_problems(df(a), df(b)).collect()} == {"ok": "ok", "short": "count", "turned": "order", "none": "count", "extra": "count"}


def folders(path):
    return {d for d in os.listdir(f"{path}/data")} if os.path.exists(f"{path}/data") else set()


def test_put_rewrites_touched_buckets(spark, tmp_path):
    at = str(tmp_path / "lib")
    s = Store(spark, at, "id", "id string, title string", 16)
    s.put(spark.range(2000).selectExpr("CAST(id AS STRING) AS id", "'old' AS title"))
    before = s._manifest()[1]
    assert len(before) == 16 and s.all().count() == 2000
    inside = s._buckets_of(["7"])
    keys = [r.id for r in s.all().where(s._bucket(F.col("id")).isin(*inside)).select("id").limit(3).collect()]
    s.put(spark.createDataFrame([(k, "new") for k in keys], "id string, title string"))
    after = s._manifest()[1]
    assert {b for b in after if after[b] != before[b]} == inside  # one bucket of 16 is written
    assert s.all().where("title = 'new'").count() == 3 and s.all().count() == 2000 and s.all(0).where("title = 'new'").count() == 0
    assert s.get(*keys).count() == 3 and len(s.get(keys[0]).inputFiles()) <= 8
    s.delete_keys(keys[0], "absent")
    assert s.get(keys[0]).count() == 0 and s.all().count() == 1999
    s.vacuum()
    assert s.all().count() == 1999 and s.versions() == [2] and len(folders(at)) == 2


def test_store_edges(spark, tmp_path):
    s = Store(spark, str(tmp_path), "id", "id long, v string", 4)
    rows = lambda x: spark.createDataFrame(x, "id long, v string")
    assert s.all().count() == 0 and s.get(1).count() == 0
    s.delete_keys(1)
    s.put(rows([(1, "a"), (1, "a"), (None, "n")]))
    s.put(rows([(None, "m"), (2, None)]))
    assert {(r.id, r.v) for r in s.all().collect()} == {(1, "a"), (None, "m"), (2, None)}
    s.put(rows([]))
    s.delete(rows([(None, "")]))
    assert {r.id for r in s.all().collect()} == {1, 2}
    with pytest.raises(ValueError, match="buckets"):
        Store(spark, str(tmp_path), "id", "id long, v string", 5).all()
    other = s._manifest()
    s.put(rows([(9, "z")]))
    with pytest.raises(StoreConflict):
        s._commit(other[0], other[1])
    s.clear()
    assert s.all().count() == 0


def test_saved_albums(spark, tmp_path):
    saved = ai.SavedAlbums(spark, str(tmp_path), 4)
    when = lambda d: datetime.datetime(2024, 1, d)
    rows = [("1", None, when(1), '{"album": {"title": "T"}}', None), ("2", "n.mp5p", when(3), "{}", b"bytes"), ("3", "", when(2), "oops", b"")]
    saved.save(spark.createDataFrame(rows, "id string, name string, imported_at timestamp, manifest string, content binary"))
    assert [(r.id, r.name, r.kind, r.file_size) for r in saved.list().collect()] == [("2", "n.mp5p", "embedded", 5), ("3", "album.mp5p", "embedded", 0), ("1", "T.mp5p", "manifest", None)]
    assert {r.id: r.content for r in saved.content("1", "2", "9").collect()} == {"2": bytearray(b"bytes")}
    saved.delete("2", "9")
    assert saved.get("2").count() == 0 and saved.blobs.all().count() == 1 and saved.list().count() == 2
