"""The artifact row against loops over single samples, in tiles of several sizes."""

import math

import numpy as np
import pytest

from tessera.operators import artifact


def slow(o, d, rate, channels, seconds=1.0):
    s, x = [v / 32768 for v in o], [v / 32768 for v in d]
    n = len(s)
    db = lambda p, q: 120.0 if q < 1e-20 else 10 * math.log10(max(p, 1e-30) / q)
    square = lambda v: sum(a * a for a in v)
    e = [a - b for a, b in zip(s, x, strict=True)]
    out = {"full_snr_db": db(square(s), square(e))}
    quiet = [j for f in range(0, n, channels) if max(abs(v) for v in s[f : f + channels]) < 10 ** (-2.1) for j in range(f, min(f + channels, n))]
    qp, qe = square(s[j] for j in quiet), square(e[j] for j in quiet)
    out["quiet_snr_db"] = 120.0 if not quiet or qp < 1e-20 else db(qp, qe)
    out["noise_floor_rms"] = 0.0 if not quiet or qp < 1e-20 else math.sqrt(qe / len(quiet))
    out["hf_err_rms"] = math.sqrt(square(e[j] - e[j - 1] for j in range(1, n)) / (n - 1)) if n >= 4 else 0.0
    out["lf_err_rms"] = math.sqrt(square(e[1:]) / n) if n >= 4 else 0.0
    pairs = [(e[j], e[j + 1]) for j in range(0, n // channels * channels, channels)] if channels > 1 else []
    out["side_err_rms"] = math.sqrt(square((a - b) / 2 for a, b in pairs) / len(pairs)) if pairs else 0.0
    out["mid_err_rms"] = (math.sqrt(square((a + b) / 2 for a, b in pairs) / len(pairs)) if pairs else 0.0) if channels > 1 else out["lf_err_rms"]
    win = int(rate * seconds) * channels
    spots = [(db(square(s[j : j + win]), square(e[j : j + win])), j) for j in range(0, n - win + 1, max(1, win // 4))] or [(out["full_snr_db"], 0)]
    worst = min(round(v, 9) for v, _ in spots)
    out["worst_snr_db"], out["worst_start_sec"] = worst, next(j for v, j in spots if round(v, 9) == worst) // channels / rate

    def split(v):
        a, state, parts = [math.exp(-2 * math.pi * hz / max(rate, 8000)) for hz in (120, 800, 4000)], [0.0] * 3, [0.0] * 4
        rows = []
        for z in v:
            state[0] = a[0] * state[0] + (1 - a[0]) * z
            b0 = z - state[0]
            state[1] = a[1] * state[1] + (1 - a[1]) * b0
            b1 = b0 - state[1]
            state[2] = a[2] * state[2] + (1 - a[2]) * b1
            parts = [state[0], b0, b1, b1 - 2 * state[2]]
            rows.append(parts)
        return [square(r[k] for r in rows) for k in range(4)]

    out["band_error_ratios"] = [math.sqrt(q / p) if p > 1e-20 else 0.0 for p, q in zip(split(s), split(e), strict=True)]
    out["peak_error"], out["clipped_samples"] = max(map(abs, e)), sum(abs(v) >= 32767 for v in d)
    return out


@pytest.mark.parametrize(("tile", "channels", "rate"), [(1 << 16, 1, 44100), (700, 1, 8000), (900, 2, 11025), (64, 3, 101), (5, 1, 97)])
def test_against_loops(spark, tile, channels, rate):
    rng = np.random.default_rng(tile)
    signals = {}
    for k, n in enumerate([2500, 1200, 61, 3, 1]):
        o = np.clip(rng.normal(size=n).cumsum() * (30 if k else 3000), -32768, 32767).astype(int)
        d = np.clip(o + rng.integers(-40, 41, n) * (np.arange(n) % 300 > 100), -32768, 32767)
        signals[f"s{k}"] = (o.tolist(), d.tolist())
    signals["silent"] = ([0] * 400, [0] * 400)
    signals["same"] = (signals["s1"][0], signals["s1"][0])
    rows = [(k, i, a, b) for k, (o, d) in signals.items() for i, (a, b) in enumerate(zip(o, d, strict=True))]
    got = {r.k: r for r in artifact.artifacts(spark.createDataFrame(rows, "k string, i long, o int, d int"), "k", "i", "o", "d", rate, channels, tile=tile).collect()}
    assert len(got) == len(signals)
    for k, (o, d) in signals.items():
        for name, value in slow(o, d, rate, channels).items():
            np.testing.assert_allclose(got[k][name], value, rtol=1e-7, atol=1e-9, err_msg=f"{k} {name}")
    assert got["silent"].silence_gate and got["silent"].quiet_gate and got["silent"].is_silence and got["same"].quiet_gate


def test_nothing(spark):
    assert artifact.artifacts(spark.createDataFrame([], "k long, i long, o int, d int"), "k", "i", "o", "d", 8000).count() == 0
