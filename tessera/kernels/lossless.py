"""The lossless block codec on NumPy arrays: versions 2 (raw blocks) and 3.

Recurrences are written as array operations: residuals of fixed predictors are repeated differences, their inverse is
repeated cumulative sums, and variable-length integers are found from the bytes that end them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the stream.
MARK, RAW_VERSION, VERSION, BLOCK = 0x4C, 2, 3, 4096
RAW, SILENCE, CONST, PREDICTED, DELTA, STEREO = range(6)
JOINT, HEADER, ORDERS = 0x80, 13, 4


def zigzag(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return ((x << 1) ^ (x >> 63)).astype(np.uint64) & np.uint64(0xFFFFFFFF)


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = u.astype(np.int64)
    return (u >> 1) ^ -(u & 1)


def varint_sizes(u: np.ndarray) -> np.ndarray:
    """Bytes of each value: seven bits a byte."""
    return 1 + sum((u >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 5))


def varints(u: np.ndarray) -> bytes:
    n = varint_sizes(u)
    end = np.cumsum(n)
    k = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - n, n)
    v = (np.repeat(u, n) >> (7 * k).astype(np.uint64)) & np.uint64(0x7F)
    more = k < np.repeat(n, n) - 1
    return (v.astype(np.uint8) | (more.astype(np.uint8) << 7)).tobytes()


def read_varints(data: bytes, count: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 0x80)[:count]
    if len(ends) < count:
        raise ValueError("varints are cut off")
    if not count:
        return np.zeros(0, np.uint64)
    start = np.concatenate(([0], ends[:-1] + 1))
    if (ends - start).max() > 4:
        raise ValueError("a varint is too long")
    b = b[: ends[-1] + 1].astype(np.uint64)
    k = np.arange(len(b)) - np.repeat(start, ends - start + 1)
    return np.add.reduceat((b & np.uint64(0x7F)) << (7 * k).astype(np.uint64), start)


def residuals(x: np.ndarray, order: int) -> np.ndarray:
    """Differences of the order; the first samples take the order that they can."""
    out = x.astype(np.int64)
    for k in range(min(order, max(0, len(x) - 1))):
        out[k + 1 :] = np.diff(out[k:])
    return out


def rebuilt(r: np.ndarray, order: int) -> np.ndarray:
    out = r.astype(np.int64)
    for k in range(min(order, max(0, len(r) - 1)) - 1, -1, -1):
        out[k:] = np.cumsum(out[k:])
    return out.astype(np.int16)


def order_cost(r: np.ndarray) -> int:
    """The format's estimate: a negative residual counts as five bytes."""
    return int(np.where(r < 0, 5, varint_sizes(np.abs(2 * r).astype(np.uint64))).sum())


def best_order(x: np.ndarray) -> int:
    return min(range(min(ORDERS, len(x) - 1) + 1), key=lambda k: (order_cost(residuals(x, k)), k)) if len(x) else 0


def encode_block(x: np.ndarray) -> tuple[int, bytes]:
    """The smallest form of a block; raw wins ties, then the plain differences."""
    if not x.any():
        return SILENCE, b""
    if (x == x[0]).all():
        return CONST, x[:1].astype("<i2").tobytes()
    count = struct.pack("<I", len(x))
    order = best_order(x)
    forms = [(RAW, x.astype("<i2").tobytes()), (DELTA, count + varints(zigzag(residuals(x, 1)))), (PREDICTED, bytes([order]) + count + varints(zigzag(residuals(x, order))))]
    return min(forms, key=lambda f: len(f[1]))


def decode_block(flag: int, data: bytes, n: int) -> np.ndarray:
    if flag == SILENCE:
        return np.zeros(n, np.int16)
    if flag == CONST:
        return np.full(n, struct.unpack_from("<h", data)[0], np.int16)
    if flag == RAW:
        if len(data) < 2 * n:
            raise ValueError("a raw block is cut off")
        return np.frombuffer(data, "<i2", n).astype(np.int16)
    if flag in (DELTA, PREDICTED):
        order, at = (1, 0) if flag == DELTA else (data[0], 1)
        if order > ORDERS or struct.unpack_from("<I", data, at)[0] != n:
            raise ValueError("a block's header is wrong")
        return rebuilt(unzigzag(read_varints(data[at + 4 :], n)), order)
    if flag == STEREO:
        at, sides = 0, []
        for _ in range(2):
            sub, size = struct.unpack_from("<BI", data, at)
            sides.append(decode_block(sub, data[at + 5 : at + 5 + size], n))
            at += 5 + size
        return np.stack(from_mid_side(*sides), 1).ravel()
    raise ValueError(f"unknown block flag {flag}")


def mid_side(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = left.astype(np.int32), right.astype(np.int32)
    return ((a + b) >> 1).astype(np.int16), (a - b).astype(np.int16)


def from_mid_side(mid: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The format's inverse: exact where left and right are of the same parity, so an encoder tries it first."""
    m, s = mid.astype(np.int32), side.astype(np.int32)
    left = (m + (s >> 1)).astype(np.int16)
    return left, (left.astype(np.int32) - s).astype(np.int16)


def spread(x: np.ndarray) -> int:
    """Sum of squared distances from the whole-number mean (rounded to zero)."""
    if not len(x):
        return 0
    x = x.astype(np.int64)
    total = int(x.sum())
    mean = abs(total) // len(x) * (1 if total >= 0 else -1)
    return int(((x - mean) ** 2).sum())


def _block(x: np.ndarray, flag: int, data: bytes) -> bytes:
    return struct.pack("<IBII", len(x), flag, zlib.crc32(x.astype("<i2").tobytes()), len(data)) + data


def encode(samples: np.ndarray, channels: int = 1, version: int = VERSION) -> bytes:
    """samples: interleaved int16."""
    channels = max(1, channels)
    lanes = [samples[c::channels] for c in range(channels)]
    longest = max((len(x) for x in lanes), default=0)
    blocks = -(-longest // BLOCK)
    out = [[] for _ in lanes]
    for at in range(0, longest, BLOCK):
        parts = [x[at : at + BLOCK] for x in lanes]
        if channels == 2 and version == VERSION and len(parts[0]) == len(parts[1]):
            joint = mid_side(*parts)
            if sum(map(spread, joint)) < sum(map(spread, parts)) and all((a == b).all() for a, b in zip(from_mid_side(*joint), parts, strict=True)):
                for c, x in enumerate(joint):
                    flag, data = encode_block(x)
                    out[c].append(_block(x, flag | (0 if c else JOINT), data))
                continue
        for c, x in enumerate(parts):
            if len(x):
                out[c].append(_block(x, *(encode_block(x) if version == VERSION else (RAW, x.astype("<i2").tobytes()))))
    return bytes([MARK, version, channels]) + struct.pack("<I", blocks) + b"".join(b for lane in out for b in lane)


def blocks(data: bytes):
    """(channel, number in it, flag with the joint bit, samples, CRC, payload) of each block."""
    if len(data) < 7 or data[0] != MARK or data[1] not in (RAW_VERSION, VERSION):
        raise ValueError("not a lossless stream of a known version")
    count, at = struct.unpack_from("<I", data, 3)[0], 7
    for c in range(max(1, data[2])):
        for k in range(count):
            if at + HEADER > len(data):
                return
            n, flag, crc, size = struct.unpack_from("<IBII", data, at)
            if at + HEADER + size > len(data):
                raise ValueError(f"block {k} of channel {c} is cut off")
            yield c, k, RAW if data[1] == RAW_VERSION else flag, n, crc, data[at + HEADER : at + HEADER + size]
            at += HEADER + size


def decode(data: bytes) -> np.ndarray:
    """Interleaved int16; raises ValueError where a block is cut off or its CRC is wrong."""
    try:
        return _decode(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"a stream is cut off: {e}") from None


def _decode(data: bytes) -> np.ndarray:
    channels = max(1, data[2]) if len(data) > 2 else 1
    lanes, joint = [[] for _ in range(channels)], set()
    for c, k, flag, n, crc, payload in blocks(data):
        if c == 0 and flag & JOINT:
            joint.add(k)
        x = decode_block(flag & ~JOINT, payload, n)
        if zlib.crc32(x.astype("<i2").tobytes()) != crc:
            raise ValueError(f"CRC mismatch in block {k} of channel {c}")
        lanes[c].append(x)
    if channels > 1:
        for k in joint:
            if k < len(lanes[1]) and len(lanes[0][k]) == len(lanes[1][k]):
                lanes[0][k], lanes[1][k] = from_mid_side(lanes[0][k], lanes[1][k])
    whole = [np.concatenate(x) if x else np.zeros(0, np.int16) for x in lanes]
    if channels == 1:
        return whole[0]
    n = min(map(len, whole))
    return np.stack([x[:n] for x in whole], 1).ravel()


def counts(data: bytes) -> dict[str, int]:
    """How many blocks of each form a stream has, and its payload bytes."""
    names = ("raw", "silence", "const", "lpc_varint", "delta", "stereo")
    out = dict.fromkeys(names, 0) | {"joint": 0, "payload_bytes": 0}
    for _, _, flag, _, _, payload in blocks(data):
        out[names[flag & ~JOINT]] += 1
        out["joint"] += flag >= JOINT
        out["payload_bytes"] += len(payload)
    return out
