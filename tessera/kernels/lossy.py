"""The lossy frame codec (versions 2 to 4) and the hybrid of it with a lossless residual, on NumPy arrays.

Version 2 is read only; 3 has one step per preset; 4 scales the step of each frame by its level and its share of high frequencies.
Arithmetic on samples is in float32, as the format's results need.
"""

from __future__ import annotations

import struct

import numpy as np

from tessera.kernels import lossless
from tessera.kernels.signal import half_away, quantise

# Fixed values of the stream.
MARK, HYBRID_MARK, OLD_FRAME, FRAME = 0x43, 0x48, 1152, 2048
SILENCE, DELTA, DENSE = range(3)
# Steps by version and preset; of a frame's scale: its level, how far quiet and change fine it down, and its least value.
STEPS = {2: (0.10, 0.028, 0.014, 0.012), 3: (0.10, 0.05, 0.025, 0.012), 4: (0.10, 0.028, 0.014, 0.012)}
QUIET, QUIET_SHARE, CHANGE, CHANGE_SHARE, LEAST_SCALE = 0.14, 0.58, 0.5, 0.12, 0.32


def step_scale(frame: np.ndarray) -> np.float32:
    """Finer steps for quiet frames and for frames with much change from sample to sample."""
    f = np.float32
    x = frame.astype(np.float32)
    level = np.sqrt((x * x).mean(dtype=np.float32)) if len(x) else f(0)
    d = np.diff(x)
    high, low = (d * d).sum(dtype=np.float32), (x[1:] * x[1:]).sum(dtype=np.float32)
    share = high / (low + high + f(1e-12)) if len(x) >= 4 else f(0)
    quiet = max(f(QUIET) - level, f(0)) / f(QUIET)
    return f(np.clip((1 - quiet * f(QUIET_SHARE)) * (1 - min(share, f(CHANGE)) * f(CHANGE_SHARE)), LEAST_SCALE, 1.0))


def scale_byte(scale: float) -> int:
    return int(np.floor((min(max(float(scale), 0.25), 1.0) - 0.25) / 0.75 * 255 + 0.5))


def scale_of(byte: int) -> np.float32:
    return np.float32(0.25 + byte / 255 * 0.75)


def zigzag(delta: np.ndarray) -> np.ndarray:
    """The format's variant: a negative difference has high bits set, so it takes five bytes."""
    u = delta.astype(np.int64) & 0xFFFFFFFF
    return (((u << 1) & 0xFFFFFFFF) ^ (u >> 15)).astype(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = u.astype(np.int64)
    return ((u >> 1) ^ -(u & 1)).astype(np.int16)


def pack(q: np.ndarray) -> tuple[int, bytes]:
    if not q.any():
        return SILENCE, b""
    delta = np.diff(q.astype(np.int64), prepend=0).astype(np.int16)
    packed = lossless.varints(zigzag(delta))
    return (DELTA, packed) if len(packed) + 2 < 2 * len(q) else (DENSE, q.astype("<i2").tobytes())


def unpack(flag: int, data: bytes, n: int) -> np.ndarray:
    if flag == SILENCE:
        return np.zeros(n, np.int16)
    if flag == DELTA:
        count = min(n, int((np.frombuffer(data, np.uint8) < 0x80).sum()))
        x = np.cumsum(unzigzag(lossless.read_varints(data, count)).astype(np.int64)).astype(np.int16)
    elif flag == DENSE:
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int16)
    else:
        raise ValueError(f"unknown frame flag {flag}")
    return np.pad(x[:n], (0, n - min(n, len(x))))


def _lanes(samples: np.ndarray, channels: int) -> list[np.ndarray]:
    if channels not in (1, 2):
        raise ValueError("one or two channels only")
    return [samples[c::channels] for c in range(channels)]


def encode(samples: np.ndarray, channels: int = 1, preset: int = 1, version: int = 4) -> bytes:
    lanes = _lanes(samples, channels)
    if version == 3 and channels == 2:
        n = min(map(len, lanes))
        a, b = (x[:n].astype(np.int32) for x in lanes)
        lanes = [np.trunc(x / 2).astype(np.int16) for x in (a + b, a - b)]
    step, out = np.float32(STEPS[version][preset]), []
    for x in lanes:
        for at in range(0, len(x), FRAME):
            frame = np.zeros(FRAME, np.float32)
            part = x[at : at + FRAME]
            frame[: len(part)] = part.astype(np.float32) / np.float32(32768)
            scale = step_scale(frame) if version == 4 else np.float32(1)
            flag, data = pack(quantise(frame, step * scale))
            out.append(bytes([flag]) + (bytes([scale_byte(scale)]) if version == 4 else b"") + struct.pack("<H", len(data)) + data)
    frames = max((-(-len(x) // FRAME) for x in lanes), default=0)
    return bytes([MARK, version, channels, preset]) + struct.pack("<I", frames) + b"".join(out)


def decode(data: bytes) -> np.ndarray:
    """Interleaved int16, padded to whole frames; raises ValueError where the stream is cut off."""
    try:
        return _decode(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"a stream is cut off: {e}") from None


def _decode(data: bytes) -> np.ndarray:
    if len(data) < 8 or data[0] != MARK or data[1] not in STEPS or data[3] > 3:
        raise ValueError("not a lossy stream of a known version")
    version, channels, count, at = data[1], max(1, data[2]), struct.unpack_from("<I", data, 4)[0], 8
    base, lanes = np.float32(STEPS[version][data[3]]), []
    for _ in range(channels):
        lane = []
        for _ in range(count):
            if at >= len(data):
                break
            step = base
            if version == 2:
                n, size = struct.unpack_from("<I", data, at + 4)[0], OLD_FRAME
                flag, body, at = DENSE, data[at + 12 : at + 8 + n], at + 8 + n
            else:
                flag, size = data[at], FRAME
                at += 1
                if version == 4:
                    step, at = base * scale_of(data[at]), at + 1
                n = struct.unpack_from("<H", data, at)[0]
                body, at = data[at + 2 : at + 2 + n], at + 2 + n
            if at > len(data):
                raise ValueError("a frame is cut off")
            x = np.clip(unpack(flag, body, size).astype(np.float32) * step, -1, 1) * np.float32(32767)
            lane.append(half_away(x).astype(np.int16))
        lanes.append(np.concatenate(lane) if lane else np.zeros(0, np.int16))
    if channels == 1:
        return lanes[0]
    n = min(map(len, lanes))
    pair = [x[:n].astype(np.int32) for x in lanes]
    if version == 3 and channels == 2:
        pair = [np.clip(pair[0] + pair[1], -32768, 32767), np.clip(pair[0] - pair[1], -32768, 32767)]
    return np.stack(pair, 1).ravel().astype(np.int16)


def encode_hybrid(samples: np.ndarray, channels: int = 1, preset: int = 2, version: int = 4) -> bytes:
    """A lossy base and the lossless residual that mends it."""
    base = encode(samples, channels, preset, version)
    heard = np.zeros(len(samples), np.int32)
    got = decode(base)[: len(samples)]
    heard[: len(got)] = got
    rest = lossless.encode(np.clip(samples.astype(np.int32) - heard, -32768, 32767).astype(np.int16), channels)
    return bytes([HYBRID_MARK, 1]) + struct.pack("<I", len(base)) + base + struct.pack("<I", len(rest)) + rest


def split_hybrid(data: bytes) -> tuple[bytes, bytes | None]:
    if len(data) < 10 or data[0] != HYBRID_MARK:
        raise ValueError("not a hybrid stream")
    n = struct.unpack_from("<I", data, 2)[0]
    if 10 + n > len(data):
        raise ValueError("a hybrid stream is cut off")
    m = struct.unpack_from("<I", data, 6 + n)[0]
    return data[6 : 6 + n], data[10 + n : 10 + n + m] if 10 + n + m <= len(data) else None


def decode_hybrid(data: bytes, enhanced: bool = True) -> np.ndarray:
    base, rest = split_hybrid(data)
    out = decode(base)
    if enhanced and rest is not None:
        r = lossless.decode(rest)[: len(out)]
        out = out.astype(np.int32)
        out[: len(r)] += r
        out = np.clip(out, -32768, 32767).astype(np.int16)
    return out


def decode_any(data: bytes) -> np.ndarray:
    """By the stream's mark: lossless, lossy, hybrid, else 16-bit PCM."""
    first = data[:1]
    if first == bytes([lossless.MARK]):
        return lossless.decode(data)
    if first == bytes([MARK]):
        return decode(data)
    return decode_hybrid(data) if first == bytes([HYBRID_MARK]) else np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int16)


def frame_counts(data: bytes) -> dict[str, float]:
    """How many frames of each form a stream of version 3 or 4 has, and its payload sizes."""
    at, version, sizes, kinds = 8, data[1], [], [0, 0, 0]
    while at < len(data):
        kinds[data[at]] += 1
        at += 1 + (version == 4)
        n = struct.unpack_from("<H", data, at)[0]
        sizes.append(n)
        at += 2 + n
    total = max(1, len(sizes))
    return {"frames": len(sizes), "silence": kinds[0], "delta": kinds[1], "dense": kinds[2], "dense_share": kinds[2] / total, "mean_payload": sum(sizes) / total, "max_payload": max(sizes, default=0)}
