"""Sources, streaming and operators on small tables."""

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.kernels import container as ct
from tessera.operators import catalog as cat
from tessera.operators import folds, joins
from tessera.sources import containers
from tessera.streaming import ingest


def make_files(folder, n=3):
    folder.mkdir(exist_ok=True)
    for i in range(n):
        (folder / f"f{i}.bin").write_bytes(ct.write(ct.head_bytes(0, 1, 16, 0, 44100, i), [("title", f"T{i}")], frames=[(0, 0, 0, b"x" * 10)]))
    (folder / "bad.bin").write_bytes(b"nothing")


def test_scans(spark, tmp_path):
    make_files(tmp_path / "in")
    got = containers.read_containers(spark, str(tmp_path / "in")).orderBy("path").collect()
    assert len(got) == 4 and got[0].parse_error == "not a container" and [r.total_samples for r in got[1:]] == [0, 1, 2]
    containers.register(spark)
    chunks = spark.read.format("tessera_chunks").load(str(tmp_path / "in"))
    assert chunks.count() == 9 and chunks.where("fourcc = 'AUDI' AND payload IS NULL").count() == 3
    whole = spark.read.format("tessera_chunks").option("payloads", "all").load(str(tmp_path / "in"))
    assert whole.where("fourcc = 'AUDI' AND crc_ok AND crc32(payload) = stored_crc").count() == 3


def test_streaming_ingest(spark, tmp_path):
    make_files(tmp_path / "in", 2)
    library, state = str(tmp_path / "library"), str(tmp_path / "state")
    ingest.watch(spark, str(tmp_path / "in"), library, state, once=True).awaitTermination()
    assert spark.read.parquet(library).count() == 3
    make_files(tmp_path / "in" / "more", 3)  # two of these are known
    ingest.watch(spark, str(tmp_path / "in"), library, state, once=True).awaitTermination()
    assert spark.read.parquet(library).count() == 4


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 3), ("c", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 4, "w")], "k string, at long, line string")
    got = {(r.k, r.t): r.line for r in joins.as_of(left, right, ["k"], "t", "at", ["line"]).collect()}
    assert got == {("a", 1): None, ("a", 5): "z", ("a", 9): "z", ("b", 3): None, ("c", 1): None}


def test_by_position(spark):
    e = spark.createDataFrame([("g", 1, "h1"), ("g", 2, "h2")], "g string, n int, h string")
    p = spark.createDataFrame([("g", 10), ("g", 20), ("g", 30), ("x", 1)], "g string, p int")
    assert {(r.g, r.p): r.hash for r in joins.by_position(e, p, "g", "n", "p", "h", "hash").collect()} == {("g", 10): "h1", ("g", 20): "h2", ("g", 30): "h2", ("x", 1): None}


def test_keep_first_scans_in_order(spark):
    df = spark.createDataFrame([(1, 1, "a", "f"), (1, 2, "a", "g"), (1, 3, "b", "g"), (1, 4, "c", "f")], "album int, pos int, id string, file string")
    got = {r.pos: r.reject for r in cat.keep_first(df, ["album"], "pos", ["id", "file"]).collect()}
    assert got == {1: None, 2: "id", 3: None, 4: "file"}


def test_fragments(spark):
    df = spark.createDataFrame([(1, "x" * 25), (2, ""), (3, "é" * 10)], "id int, body string")
    cut = folds.split_text(df, "body", 10)
    assert cut.count() == 5
    back = folds.reassemble(cut, "id", "part", "parts", "piece").collect()
    assert {r.id: r.whole for r in back} == {1: "x" * 25, 2: "", 3: "é" * 10}
    assert folds.reassemble(cut.where("part <> 1"), "id", "part", "parts", "piece").where("NOT complete").count() == 1


def test_overrides_and_duplicates(spark):
    row = spark.range(1).select(cat.override(F.expr("map('a', '1', 'b', '2')"), F.expr("map('b', '', 'c', '3')")).alias("m")).first()
    assert row.m == {"a": "1", "c": "3"}
    new = spark.createDataFrame([(1, "k"), (2, "k"), (3, "old")], "id int, key string")
    assert [r.id for r in cat.save_unless_duplicate(new, spark.createDataFrame([("old",)], "key string"), "key", "id").collect()] == [1]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_functions(spark):
    assert [one(spark, fn.timecode_ms, x) for x in ("[01:02.5]", "01:02.50", "1:02.005", "00:00", "1:99", "x")] == [62500, 62500, 62005, 0, None, None]
    assert one(spark, fn.timecode, 59999, "long") == "00:59.100" and one(spark, fn.clock, 61.9, "double") == "1:01"
    assert [one(spark, fn.hex_color, x) for x in ("#AbC", "#abcd", "#A1B2C3", "#a1b2c3ff", "abc")] == ["#aabbcc", "#aabbcc", "#a1b2c3", "#a1b2c3", None]
    assert one(spark, fn.web_url, "ftp://a") is None and one(spark, fn.web_url, "https://u:p@a/") is None and one(spark, fn.web_url, " http://a/b ") == "http://a/b"
    assert one(spark, fn.track_number, "A/07 - Song") == 7 and one(spark, fn.track_number, "song") is None
    assert one(spark, fn.tag_list, "a, b;;a ") == ["a", "b", "a"] and one(spark, fn.isrc, "us-abc-12-34567") == "USABC1234567"
    assert one(spark, fn.unsafe_path, "a/../b") and not one(spark, fn.unsafe_path, "a/b..c") and one(spark, fn.basename, "a\\b/c") == "c"
    assert round(one(spark, lambda x: fn.contrast(x, F.lit("#ffffff")), "#000000"), 2) == 21.0
    assert one(spark, fn.mime, b"\x89PNG1234", "binary") == "image/png" and one(spark, fn.sanitize, "a\x00b\tc") == "ab\tc"
    names = spark.createDataFrame([("t10",), ("T9",), ("t009b",)], "n string").orderBy(cat.natural_key(F.col("n"))).collect()
    assert [r.n for r in names] == ["T9", "t009b", "t10"]
