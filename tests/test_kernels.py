"""Containers, the lossless codec, signals and packages as pure functions."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.kernels import container as ct
from tessera.kernels import lossless, package, signal


def sample_file(**more):
    return ct.write(ct.head_bytes(0, 1, 16, 2, 44100, 100), [("title", "Häppy 🎵"), ("artist", 'A "B"')], frames=[(0, 0, 0, b"abc"), (1, 2, 1, b"")], seek=[(0, 0), (50, 3)], wave=[0.5, 1.0], info=[("encoder", "x")], corr=[(0, b"zz")], **more)


def test_container_fields():
    p = ct.parse(sample_file(optional=[("LYRC", b"{}"), ("LYRC", b"[]")], extra=[("FUTR", b"?")]))
    assert p.head == {"codec_id": 0, "channels": 1, "bits": 16, "preset": 2, "sample_rate": 44100, "total_samples": 100, "encoder": 1}
    assert p.meta == [("title", "Häppy 🎵"), ("artist", 'A "B"')] and p.frames == [(0, 0, 0, b"abc"), (1, 2, 1, b"")]
    assert p.seek.tolist() == [[0, 0], [50, 3]] and p.wave.tolist() == [0.5, 1.0] and p.corr == [(0, b"zz")]
    assert p.optional == {"LYRC": b"{}", "FUTR": b"?"} and len(p.warnings) == 1
    assert [c.fourcc for c in p.chunks] == ["HEAD", "META", "AUDI", "SEEK", "WAVE", "INFO", "CORR", "LYRC", "LYRC", "FUTR"]


def flip(data: bytes, fourcc: bytes) -> bytes:
    at = data.index(fourcc) + 16
    return data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]


def test_container_damage():
    good = sample_file(optional=[("MOOD", b"{}")], extra=[("FUTR", b"?")])
    for bad in (b"", good[:8], b"XXXX" + good[4:], good[:4] + b"\x09" + good[5:], good[: len(good) * 2 // 5], good + b"!", flip(good, b"META"), flip(good, b"FUTR")):
        with pytest.raises(ct.ContainerError):
            ct.parse(bad)
    p = ct.parse(flip(good, b"MOOD"))
    assert "MOOD" not in p.optional and p.warnings
    head, meta, _ = ct.metadata(good[:150])
    assert head["sample_rate"] == 44100 and meta[0][0] == "title"
    assert ct.metadata(b"nothing") == (None, [], None)


def test_lazy_index_skips_audio():
    data, reads = sample_file(), []

    def read(at, n):
        reads.append(n)
        return data[at : at + n]

    chunks = list(ct.index(read, len(data)))
    assert next(c for c in chunks if c.fourcc == "AUDI").payload is None and next(c for c in chunks if c.fourcc == "META").payload
    assert not ct.wanted("STDF", 1) and not ct.wanted("COVR", (1 << 20) + 1) and ct.wanted("COVR", 1 << 20) and not ct.wanted("LYRC", (256 << 10) + 1)


@given(st.lists(st.integers(-32768, 32767), max_size=300), st.sampled_from([1, 2]), st.sampled_from([2, 3]))
@settings(max_examples=60, deadline=None)
def test_lossless_roundtrip(values, channels, version):
    x = np.array(values[: len(values) // channels * channels], np.int16)
    assert (lossless.decode(lossless.encode(x, channels, version)) == x).all()


@pytest.mark.parametrize("x", [np.zeros(10000, np.int16), np.full(5000, -7, np.int16), signal.tone(0.5, 44100), signal.noise(0.3, 44100), signal.decay(0.4, 48000)], ids=["silence", "const", "tone", "noise", "tail"])
def test_lossless_signals(x):
    data = lossless.encode(x)
    assert (lossless.decode(data) == x).all() and len(data) <= 2 * len(x) + 13 * (len(x) // 4096 + 1) + 7
    both = np.stack([x, x // 2], 1).ravel()
    assert (lossless.decode(lossless.encode(both, 2)) == both).all()


def test_lossless_damage():
    data = bytearray(lossless.encode(signal.tone(0.2, 44100)))
    data[60] ^= 1
    with pytest.raises(ValueError):
        lossless.decode(bytes(data))
    with pytest.raises(ValueError):
        lossless.decode(b"L\x09\x01\0\0\0\0")


@given(st.lists(st.integers(-(2**31), 2**31 - 1), max_size=50))
@settings(deadline=None)
def test_varints(values):
    x = np.array(values, np.int64)
    assert (lossless.unzigzag(lossless.read_varints(lossless.varints(lossless.zigzag(x)), len(x))) == x).all()


@given(st.lists(st.integers(-3000, 3000), max_size=40), st.integers(0, 4))
@settings(deadline=None)
def test_residuals_follow_their_definition(values, order):
    x = np.array(values, np.int64)
    weights = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
    want = [v - sum(w * x[i - 1 - j] for j, w in enumerate(weights[min(order, i)])) for i, v in enumerate(x)]
    r = lossless.residuals(x, order)
    assert r.tolist() == want and lossless.rebuilt(r, order).tolist() == x.tolist()


def test_mid_side():
    a, b = signal.noise(0.1, 8000, 3) & -2, signal.noise(0.1, 8000, 4) & -2
    assert all((p == q).all() for p, q in zip(lossless.from_mid_side(*lossless.mid_side(a, b)), (a, b), strict=True))


def test_signal():
    assert signal.to_int(np.array([1.0, -1.0, 0.5 / 32767, -0.5 / 32767, 2.0], np.float32)).tolist() == [32767, -32767, 1, -1, 32767]
    x = signal.tone(0.1, 8000)
    y, rate, channels = signal.read_wav(signal.wav(x, 8000, 1))
    assert (x == y).all() and (rate, channels) == (8000, 1)
    assert signal.snr(x, x) == 120 and signal.snr(x[:0], x) == 0 and 5 < signal.snr(x, x // 2) < 7
    assert signal.compared(x, x)["bit_exact"] and signal.compared(x, x + 1)["max_diff"] == 1
    assert len(signal.peaks(signal.to_float(x), 512)) == 512 and len(signal.resample(x, 8000, 16000)) == 2 * len(x)
    assert signal.layout(np.array([1, 2]), 1, 2).tolist() == [1, 1, 2, 2] and signal.aligned(np.array([1, 2, 3]), 5).tolist() == [1, 2, 3, 0, 0]


def test_package():
    tracks = [("a", bytes(range(256)) * 20), ("b-1", b"x" * 1024)]
    raw = package.write({"format": "embedded"}, tracks, 1024)
    manifest, entries = package.index(lambda at, n: raw[at : at + n])
    assert manifest == {"format": "embedded"} and package.kind(raw) == "binary" and package.kind(b' {"a"') == "json"
    for name, data in tracks:
        got = [package.read_fragment(raw[at : at + n]) for t, at, n in entries if t == name]
        assert package.joined(got) == (data, [])
        assert package.joined(got[1:])[1] == (["part 0 is missing"] if len(got) > 1 else ["fragments disagree about their number"])
        got[0] |= {"crc_ok": False}
        assert package.joined(got)[1] == ["part 0 has a bad CRC"]
    assert package.read_fragment(b"\x02" + raw[41:60]) is None and struct.unpack_from("<I", raw, 8)[0] == len('{"format": "embedded"}')
    with pytest.raises(ValueError):
        package.fragment("../x", 0, 1, b"")
