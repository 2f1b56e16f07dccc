"""The lossy and hybrid codecs, JSON records and timeline text."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import records
from tessera.kernels import lossy, signal
from tessera.operators import timeline


@pytest.mark.parametrize("version", [3, 4])
@pytest.mark.parametrize("channels", [1, 2])
def test_lossy(version, channels):
    x = np.repeat(signal.tone(0.4, 44100, level=0.4), channels)
    last = 0.0
    for preset in range(4):
        y = lossy.decode(lossy.encode(x, channels, preset, version))[: len(x)]
        now = signal.snr(signal.to_float(x), signal.to_float(y))
        assert now > last
        last = now
    assert last > 28
    silent = np.zeros(5000 * channels, np.int16)
    assert not lossy.decode(lossy.encode(silent, channels, 1, version)).any()
    assert lossy.frame_counts(lossy.encode(silent, channels, 1, version))["silence"] == 3 * channels


@pytest.mark.parametrize("x", [signal.tone(0.3, 44100), signal.noise(0.3, 44100), signal.decay(0.3, 44100), np.zeros(0, np.int16)], ids=["tone", "noise", "tail", "empty"])
def test_hybrid_is_exact(x):
    data = lossy.encode_hybrid(x)
    assert (lossy.decode_hybrid(data)[: len(x)] == x).all() and (lossy.decode_any(data)[: len(x)] == x).all()
    base, rest = lossy.split_hybrid(data)
    assert rest is not None and (lossy.decode(base) == lossy.decode_hybrid(data, enhanced=False)).all()
    with pytest.raises(ValueError):
        lossy.split_hybrid(data[:9])


def test_old_frames_are_read():
    import struct

    q = np.arange(-576, 576).astype("<i2")
    body = struct.pack("<I", len(q)) + q.tobytes()
    data = bytes([lossy.MARK, 2, 1, 3]) + struct.pack("<I", 1) + struct.pack("<II", 0, len(body)) + body
    assert len(lossy.decode(data)) == 1152


def test_zigzag():
    x = np.arange(-32768, 32768).astype(np.int16)
    assert (lossy.unzigzag(lossy.zigzag(x)) == x).all() and int(lossy.zigzag(np.array([-1]))[0]) == 0xFFFE0001


def first(spark, column, value):
    text = value if isinstance(value, str) or value is None else json.dumps(value)
    r = spark.createDataFrame([(text,)], "j string").select(column(F.col("j")).alias("y")).first().y
    return r.asDict(True) if hasattr(r, "asDict") else r


def test_records(spark):
    got = first(spark, records.lyrics, {"synced": [{"timeMs": 2000, "text": "b"}, {"time": 1.5, "text": " a "}, {"text": "no time"}], "source": "user"})
    assert [(x["timeMs"], x["text"]) for x in got["synced"]] == [(1500, "a"), (2000, "b")] and got["source"] == "user"
    assert first(spark, records.lyrics, "plain words")["source"] == "legacy" and first(spark, records.lyrics, None) is None
    assert first(spark, records.mood, {"tags": []}) is None and first(spark, records.mood, {"tags": ["calm", ""], "energy": 0.5})["tags"] == ["calm"]
    assert first(spark, records.hook, {"label": "x"}) is None and first(spark, records.hook, {"startMs": 5})["startMs"] == 5
    g = first(spark, lambda j: records.guidance(j, "explicit", "ai"), {"explicit": True, "ai": "true"})
    assert g["explicit"] is True and g["ai"] is False and g["warningSource"] == "unknown"
    s = spark.createDataFrame([(json.dumps({"sections": [{"start": 9, "type": "Chorus", "confidence": 7}, {"startMs": 1, "type": "odd"}, {"type": "verse"}]}),)], "j string").select(records.sections(F.col("j")).alias("s")).first().s
    assert [(x.startMs, x.type, x.confidence) for x in s] == [(1, "custom", None), (9, "chorus", 1.0)]
    assert first(spark, lambda j: records.theme(j, "a", "b"), {"a": "#FFF", "b": "red"}) == {"a": "#ffffff", "b": None}
    f = first(spark, records.fingerprint, {"audiHash": "A" * 64, "fileHash": "b" * 64, "pcmHash": "short"})
    assert f["identity"] == "a" * 64 and f["pcmHash"] is None


def test_timeline(spark):
    df = spark.createDataFrame([(1, "# note\n[00:01.5] hi\n\n[00:02|Hook]\nbad\n[00:99] x\n[00:03]")], "id int, lyrics string")
    got = timeline.parse_lyrics(df, "id", "lyrics").orderBy("n").collect()
    assert [(r.n, r.time_ms, r.section, r.text) for r in got if r.error is None] == [(2, 1500, None, "hi"), (4, 2000, "Hook", "Hook")]
    assert [r.error.split(": ")[1] for r in got if r.error] == ["not a timed line", "no such time", "nothing to sing"]
    df = spark.createDataFrame([(1, "[00:00-00:10|Intro] a\n[00:10|Chorus]\n[00:20-00:15] c\n[00:30|Odd] d")], "id int, t string")
    rows = timeline.parse_sections(df, "id", "t")
    good = rows.where("error IS NULL")
    assert [(r.start_ms, r.end_ms, r.type, r.title) for r in good.orderBy("n").collect()] == [(0, 10000, "intro", "a"), (10000, None, "chorus", None), (30000, None, "custom", "d")]
    assert rows.where("error LIKE '%ends before it begins'").count() == 1
    assert timeline.hooks(good, "id").first().start_ms == 10000
    assert [r.next_ms for r in timeline.steps(good, "id").orderBy("start_ms").collect()] == [10000, 30000, 30000]
