"""Names, records, kernels and folds of the library against hand-made values and plain loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import names, records
from tessera.kernels import container, lossless, lossy, package, signal
from tessera.operators import catalog, joins
from tessera.operators import library as lib


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: names.meta_key(F.lit(" Album_Artist ")), "albumartist"),
        (lambda: names.meta_key(F.lit("My Key")), "my key"),
        (lambda: names.title_in_name(F.lit("track 07_Blue.wav")), "Blue"),
        (lambda: names.title_in_name(F.lit(".wav")), "Untitled"),
        (lambda: names.number_in_name(F.lit("00 x.wav")), None),
        (lambda: names.export_name(F.lit(" "), F.lit(None).cast("string"), F.lit("a/b:c.wav")), "a_b_c.mp5"),
        (lambda: names.export_name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")), "track.mp5"),
        (lambda: names.extract_name(F.lit(123), F.lit('"?"')), "123 - Track.mp5"),
        (lambda: names.album_of_path(F.lit("/.hidden/x.mp5")), None),
        (lambda: names.stem_type(F.lit("My_Lead-Vox.wav")), "lead_vocals"),
        (lambda: names.section_label(F.lit("post_chorus")), "Post-chorus"),
        (lambda: names.byte_size(F.lit(-1)), "—"),
        (lambda: names.readable_text(F.lit("#ffffff"), F.lit("#eee")), "#111827"),
        (lambda: names.readable_text(F.lit("#000000"), F.lit("#fff")), "#ffffff"),
        (lambda: names.with_alpha(F.lit("#abc"), F.lit(0.5)), "#aabbcc80"),
        (lambda: names.fourcc(F.lit("lyrc")), "LYRC"),
        (lambda: names.barcode(F.lit("12-34")), None),
        (lambda: names.trusted_ms(F.lit(105), F.lit(100)), 105),
        (lambda: names.trusted_ms(F.lit(150), F.lit(100)), 100),
        (lambda: records.guidance(F.lit("[1]"), "a"), None),
        (lambda: records.stems(F.lit(json.dumps({"stems": [{"stemId": "a"}]}))), None),
        (lambda: records.rights(F.lit("{}")), None),
        (lambda: lib.thumbnail(F.lit(b"")), None),
    ],
)
def test_values(spark, make, want):
    assert one(spark, make()) == want


def test_records_over_their_size(spark):
    j = json.dumps({"notes": "x", "pad": "y" * 70_000})
    assert one(spark, records.credits(F.lit(j))) is None and one(spark, records.credits(F.lit('{"notes": "x"}'))).notes == "x"


def test_first_key_takes_the_later_row(spark):
    left = spark.createDataFrame([("a",)], "k string")
    right = spark.createDataFrame([("a", "z", 1), ("a", "b", 2)], "k string, v string, n int")
    assert joins.first_key(left, right, [("k", "k")], "v", "out", "n").first().out == "b"


def test_keep_first_against_a_plain_scan(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), i, int(rng.integers(6)), str(rng.integers(6))) for g in range(12) for i in range(20)]
    got = catalog.keep_first(spark.createDataFrame(rows, "g int, i int, a int, b string"), ["g"], "i", ["a", "b"]).collect()
    want = []
    for g in range(12):
        seen = {"a": set(), "b": set()}
        for _, i, a, b in [r for r in rows if r[0] == g]:
            bad = "a" if a in seen["a"] else "b" if b in seen["b"] else None
            if bad is None:
                seen["a"].add(a)
                seen["b"].add(b)
            want.append((g, i, bad))
    assert sorted((r.g, r.i, r.reject) for r in got) == want and {w[2] for w in want} == {None, "a", "b"}


def test_shuffled_is_an_order_of_its_own(spark):
    df = spark.range(200)
    order = lambda seed: [r.id for r in catalog.shuffled(df, "id", seed, 7).collect()]
    one_, two = order(1), order(2)
    assert one_ == order(1) and one_[0] == two[0] == 7 and sorted(one_) == sorted(two) == list(range(200)) and one_ != two and one_[1:] != sorted(one_[1:])


def test_band_errors_against_a_loop():
    rng = np.random.default_rng(3)
    s = rng.standard_normal(1000)
    d = s + rng.standard_normal(1000) / 50
    want = []
    a = [np.exp(-2 * np.pi * h / 44100) for h in (120, 800, 4000)]
    energy, error, state = [0.0] * 4, [0.0] * 4, {}
    for x, y in zip(s, d, strict=True):
        bands = []
        for side, v in (("s", x), ("d", y)):
            low, mid, top = state.get(side, (0.0, 0.0, 0.0))
            low = a[0] * low + (1 - a[0]) * v
            rest = v - low
            mid = a[1] * mid + (1 - a[1]) * rest
            band = rest - mid
            top = a[2] * top + (1 - a[2]) * band
            state[side] = low, mid, top
            bands.append((low, rest, band, band - top - top))
        for k in range(4):
            energy[k] += bands[0][k] ** 2
            error[k] += (bands[0][k] - bands[1][k]) ** 2
    want = [np.sqrt(e / p) for e, p in zip(error, energy, strict=True)]
    assert np.allclose(signal.band_errors(s, d, 44100), want, rtol=1e-9)


def test_stem_data():
    parts = [b"", b"abc", b"x" * 500]
    raw = package.stda(parts)
    assert raw[:2] == b"\x01\x03" and package.read_stda(raw) == parts
    assert package.read_stda(raw[:-1]) == parts[:2] and package.read_stda(b"\x02" + raw[1:]) == [] and package.read_stda(None) == []


def test_cut_off_inputs_raise_value_errors():
    """Every prefix of a payload, and payloads with bytes changed, give a value or a ValueError."""
    rng = np.random.default_rng(4)
    x = np.concatenate((np.zeros(4096), np.full(4096, 7), rng.integers(-500, 500, 5000))).astype(np.int16)
    whole = package.write({"a": 1}, [("t1", b"x" * 3000)])
    payloads = [
        (lossless.decode, lossless.encode(x, 1)), (lossless.decode, lossless.encode(x[:8192].repeat(2), 2)), (lossy.decode_any, lossy.encode(x[:3000], 1)), (lossy.decode_any, lossy.encode_hybrid(x[:3000], 1)),
        (lambda b: package.index(lambda at, n: b[at : at + n]), whole), (container.parse, container.write(container.head_bytes(1, 1, 16, 0, 44100, 10), meta=[("a", "b")], frames=[(0, 10, 0, b"abc")])),
    ]
    for read, raw in payloads:
        read(raw)
        for cut in {*rng.integers(0, len(raw), 60).tolist(), 0, 1, 2, 3, 5, 8, 13}:
            for bad in (raw[:cut], raw[:cut] + bytes(rng.integers(0, 256, 6).tolist()) + raw[cut + 6 :]):
                try:
                    read(bad)
                except ValueError:
                    pass
