"""Records by VARIANT: strict types, one parse, and what a bad record does; and the summary of files that hold them."""

import json

from pyspark.sql import functions as F

from tessera.functions import records
from tessera.kernels import container as ct
from tessera.operators import summary
from tessera.sources.containers import chunk_rows, parse_files


def test_types_are_strict(spark):
    rows = [
        {"tags": ["a", 1, True, None, {"x": 1}, " b "], "energy": "0.5", "intensity": 2, "source": 7}, {"tags": "a"}, {"tags": []}, {"tags": [1]}, [], 5, "x", {"tags": ["c"], "energy": 0.25, "source": " s "},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(90, None), (91, "{oops"), (92, ""), (93, ' {"tags": ["d"]} '), (94, '{"tags": ["' + "x" * 70_000 + '"]}')], "i int, j string")
    got = {r.i: r.m for r in df.select("i", records.mood(F.col("j")).alias("m")).collect()}
    assert got[0].asDict() == {"tags": ["a", "b"], "intensity": 2.0, "energy": None, "source": None} and got[7].asDict() == {"tags": ["c"], "intensity": None, "energy": 0.25, "source": "s"}
    assert {i for i, m in got.items() if m is not None} == {0, 7, 93}


def test_guidance_and_fingerprint(spark):
    one = lambda f, value: spark.createDataFrame([(json.dumps(value),)], "j string").select(f(F.col("j")).alias("r")).first().r
    g = one(records.RECORDS["EXPL"], {"explicit": True, "violence": 1, "contentWarnings": ["w"], "warningSource": "bot", "confidence": 7})
    assert (g.explicit, g.violence, g.contentWarnings, g.warningSource, g.confidence) == (True, False, ["w"], "unknown", 1.0)
    a, b, c = "a" * 64, "b" * 64, "c" * 64
    f = lambda **x: one(records.fingerprint, x)
    assert f(audiHash=a, fileHash=b).identity == a and f(audiHash=a, fileHash=b, audioFingerprintType="SHA256-file").audioFingerprint == b
    assert f(pcmHash=c, audiHash=a).audioFingerprintType == "sha256-pcm" and f(audioFingerprint=b, audiHash=a).identity == b
    assert f(fileSize=5.7).fileSize == 5 and f(fileSize=5.7).identity is None and f(generatedBy="x") is None and f(pcmHash="short") is None


def test_one_parse_and_bad_records(spark):
    good = {"MOOD": '{"tags": ["a"]}', "HOOK": '{"startMs": 5}', "LYRC": "plain"}
    rows = [(1, good), (2, good | {"HOOK": "{oops"}), (3, good | {"VIBE": "x" * 70_000}), (4, {}), (5, None), (6, good | {"MOOD": None})]
    df = spark.createDataFrame(rows, "i int, c map<string,string>")
    strict = records.read_all(df, "c", "r")
    got = {r.i: r.r for r in strict.collect()}
    assert got[1].mood.tags == ["a"] and got[1].hook.startMs == 5 and got[1].lyrc.source == "legacy" and got[2].hook is None and got[2].mood is not None
    assert got[3] is None and got[4].mood is None and got[5].mood is None and got[6].mood is None and got[6].hook.startMs == 5
    assert records.read_all(df, "c", "r", strict=False).where("i = 3").first().r.mood.tags == ["a"]
    plan = strict._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(") + plan.count("parseJson(") == len(records.RECORDS), plan[:3000]


def test_summary_of_files(spark):
    text = lambda x: json.dumps(x).encode()
    whole = ct.write(ct.head_bytes(3, 2, 16, 0, 48000, 96000), [("TITLE", "T"), ("artist", "A")], ct.cover_bytes("image/png", b"img"), [(0, 0, 0, b"x")], optional=[("STEM", text({"stems": [{"stemId": "s", "stemName": "n"}]})), ("SENS", b"{}"), ("VIBE", text({"tags": ["v"]})), ("EXPL", text({"strongLanguage": True}))])
    files = spark.createDataFrame([("d/one.MP5", whole), ("d/two.mp5", b"??"), ("d/.mp5", b"")], "path string, content binary")
    chunks = chunk_rows(files)
    parsed = parse_files(files).join(summary.texts(chunks), "path", "left")
    covers = chunks.where("fourcc = 'COVR'").select("path", F.expr("substring(payload, 15)").alias("cover"))
    out = {r.path: r for r in summary.summary(parsed.join(covers, "path", "left")).collect()}
    one = out["d/one.MP5"]
    assert len(one) == 21 and (one.title, one.artist, one.album, one.duration_sec, one.codec_label) == ("T", "A", "", 2.0, "MP5-H (hybrid · not default)")
    assert one.guidance == "Strong language · Sensitive themes" and one.has_guidance and one.has_stems and one.stem_count == 1 and one.vibe_tags == ["v"] and one.format_warnings == [summary.NO_CORRECTION, summary.NOT_DEFAULT]
    assert bytes(one.thumbnail) == b"img" and one.thumbnail_mime == "image/png" and not one.has_fingerprint and one.fingerprint_key is None
    two = out["d/two.mp5"]
    assert (two.title, two.codec_label, two.duration_sec, two.has_cover, two.stem_count, two.format_warnings) == ("two", "—", None, False, 0, []) and two.parse_error and out["d/.mp5"].title == "Untitled"
