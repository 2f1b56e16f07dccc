"""PCM: scales, WAV files, generators, resampling, levels and error measures on NumPy arrays."""

from __future__ import annotations

import struct

import numpy as np


def to_float(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) / np.float32(32768)


def half_away(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def to_int(x: np.ndarray) -> np.ndarray:
    """Full scale is 32767 on the way back; halves round away from zero."""
    return half_away(np.clip(x, -1, 1) * np.float32(32767)).astype(np.int16)


def quantise(x: np.ndarray, step: float) -> np.ndarray:
    return np.clip(half_away(x / step), -32768, 32767).astype(np.int16)


def wav(samples: np.ndarray, rate: int, channels: int) -> bytes:
    data = samples.astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def read_wav(raw: bytes) -> tuple[np.ndarray, int, int]:
    """Samples, rate and channels of 16-bit PCM."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, channels = 12, 0, 0
    while at + 8 <= len(raw):
        kind, n = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if form not in (1, 0xFFFE) or bits != 16:
                raise ValueError("only 16-bit PCM is read")
        elif kind == b"data":
            body = raw[at + 8 : at + 8 + n]
            return np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.int16), rate, channels
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def tone(seconds: float, rate: int, hertz: float = 440.0, level: float = 0.5, channels: int = 1) -> np.ndarray:
    t = np.arange(int(seconds * rate)) / rate
    return np.repeat(to_int((level * np.sin(2 * np.pi * hertz * t)).astype(np.float32)), channels)


def noise(seconds: float, rate: int, seed: int = 1, level: float = 0.3) -> np.ndarray:
    return to_int((np.random.default_rng(seed).uniform(-level, level, int(seconds * rate))).astype(np.float32))


def decay(seconds: float, rate: int, seed: int = 2) -> np.ndarray:
    """A reverb tail: noise that dies away."""
    t = np.arange(int(seconds * rate)) / rate
    return to_int((np.random.default_rng(seed).standard_normal(len(t)) * 0.2 * np.exp(-3 * t)).astype(np.float32))


def resample(x: np.ndarray, old: int, new: int) -> np.ndarray:
    """Linear interpolation to a rounded length."""
    if old == new or not len(x):
        return x
    n = max(1, int(np.floor(len(x) * new / old + 0.5)))
    return np.interp(np.arange(n) * (old / new), np.arange(len(x)), x).astype(x.dtype if x.dtype.kind == "f" else np.float64)


def layout(x: np.ndarray, old: int, new: int) -> np.ndarray:
    """Interleaved samples from old to new channels: mono is doubled, stereo is averaged."""
    if old == new:
        return x
    return np.repeat(x, 2) if (old, new) == (1, 2) else x.reshape(-1, old).mean(1)


def aligned(x: np.ndarray, frames: int) -> np.ndarray:
    return np.pad(x[:frames], (0, max(0, frames - len(x))))


def peaks(x: np.ndarray, buckets: int = 512) -> np.ndarray:
    """The greatest magnitude in each bucket; frames after the last whole bucket are left out."""
    if not len(x):
        return np.zeros(0, np.float32)
    width = max(1, len(x) // buckets)
    n = min(buckets, len(x) // width)
    return np.abs(x[: n * width]).reshape(n, width).max(1).astype(np.float32)


def snr(signal: np.ndarray, other: np.ndarray) -> float:
    """Decibels; 0 without samples, 120 where the error is nothing."""
    n = min(len(signal), len(other))
    if not n:
        return 0.0
    s = signal[:n].astype(np.float64)
    e = float(((s - other[:n]) ** 2).sum())
    if e < 1e-20:
        return 120.0
    return float(10 * np.log10(max((s**2).sum(), 1e-30) / e))


def compared(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """A null test: differences, peaks and levels of two equally long signals."""
    n = min(len(a), len(b))
    x, y = a[:n].astype(np.float64), b[:n].astype(np.float64)
    d = x - y
    level = lambda v: float(np.sqrt((v**2).mean())) if n else 0.0
    return {"max_diff": float(np.abs(d).max(initial=0)), "differing": int((d != 0).sum()), "rms_diff": level(d), "rms_a": level(x), "rms_b": level(y), "bit_exact": bool(len(a) == len(b) and not d.any())}


def quiet_snr(signal: np.ndarray, other: np.ndarray, frame: int = 2048, floor_db: float = -42.0) -> float:
    """SNR over the frames whose peak is under floor_db of full scale."""
    n = min(len(signal), len(other)) // frame * frame
    if not n:
        return 0.0
    s, o = signal[:n].reshape(-1, frame), other[:n].reshape(-1, frame)
    quiet = np.abs(s).max(1) < 10 ** (floor_db / 20)
    return snr(s[quiet].ravel(), o[quiet].ravel())


def one_pole(x: np.ndarray, a: float, block: int = 64) -> np.ndarray:
    """y[i] = a * y[i - 1] + (1 - a) * x[i] from 0, a block at a time: within one it is a product with a fixed matrix."""
    n = len(x)
    if not n:
        return np.zeros(0)
    m = -(-n // block)
    padded = np.zeros(m * block)
    padded[:n] = x
    k = np.arange(block)
    own = padded.reshape(m, block) @ (np.tril((1 - a) * a ** np.maximum(k[:, None] - k[None, :], 0).astype(float))).T
    before, last = np.zeros(m), 0.0
    for i in range(m):
        before[i] = last
        last = own[i, -1] + last * a**block
    return (own + before[:, None] * a ** (k + 1.0)).reshape(-1)[:n]


def band_errors(signal: np.ndarray, other: np.ndarray, rate: int) -> list[float]:
    """In four bands, parted by one-pole filters at 120, 800 and 4000 Hz: the error's RMS over the signal's; 0 for a silent band."""
    n = min(len(signal), len(other))
    a = [np.exp(-2 * np.pi * hertz / max(rate, 8000)) for hertz in (120.0, 800.0, 4000.0)]

    def bands(x: np.ndarray) -> list[np.ndarray]:
        x = x[:n].astype(float)
        low = one_pole(x, a[0])
        rest = x - low
        middle = rest - one_pole(rest, a[1])
        slow = one_pole(middle, a[2])
        return [low, rest, middle, middle - 2 * slow]

    out = []
    for s, d in zip(bands(signal), bands(other), strict=True):
        power = float((s * s).sum())
        out.append(float(np.sqrt(((s - d) ** 2).sum() / power)) if power > 1e-20 else 0.0)
    return out
