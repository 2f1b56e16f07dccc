"""The chunked container: records to bytes and back. No Spark here.

All numbers are little-endian. A bad file gives an `error`, never an exception, from `scan`; `parse` raises ContainerError.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
MAGIC, VERSION, CRC_FLAG = b"MP5A", 1, 1
FILE_HEADER, CHUNK_HEADER, HEAD_SIZE, FRAME_HEADER, CORR_HEADER = 12, 16, 32, 10, 8
COVER_MAGIC = b"CV1\x01"
CORE = ("HEAD", "META", "COVR", "AUDI", "SEEK", "WAVE", "INFO", "CORR")
OPTIONAL = ("LYRC", "SECT", "HOOK", "HILT", "EXPL", "SAFE", "RECV", "SENS", "MOOD", "VIBE", "VISU", "CRDT", "LICN", "IDEN", "FING", "HASH", "STEM")
LARGE = ("AUDI", "STDF")
COVER_LIMIT, OTHER_LIMIT = 1 << 20, 256 << 10


class ContainerError(ValueError):
    pass


@dataclass
class Chunk:
    number: int
    fourcc: str
    offset: int
    payload_offset: int
    length: int
    flags: int
    stored_crc: int
    repeat: int
    crc_ok: bool | None = None
    payload: bytes | None = None


@dataclass
class Parsed:
    chunks: list[Chunk] = field(default_factory=list)
    head: dict | None = None
    meta: list[tuple[str, str]] = field(default_factory=list)
    info: list[tuple[str, str]] = field(default_factory=list)
    cover: tuple[str | None, bytes] | None = None
    frames: list[tuple[int, int, int, bytes]] = field(default_factory=list)
    seek: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.uint64))
    wave: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    corr: list[tuple[int, bytes]] = field(default_factory=list)
    optional: dict[str, bytes] = field(default_factory=dict)
    fragments: list[bytes] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


# ---------------------------------------------------------------- encoders


def chunk(fourcc: str, payload: bytes) -> bytes:
    return fourcc.encode() + struct.pack("<IHHI", len(payload), CRC_FLAG, 0, zlib.crc32(payload)) + payload


def head_bytes(codec: int, channels: int, bits: int, preset: int, rate: int, frames: int, encoder: int = 1) -> bytes:
    return struct.pack("<BBBBIQH", codec, channels, bits, preset, rate, frames, encoder).ljust(HEAD_SIZE, b"\0")


def meta_bytes(pairs) -> bytes:
    raw = [(k.encode(), v.encode()) for k, v in pairs]
    return b"".join(struct.pack("<H", len(k)) + k + struct.pack("<H", len(v)) + v for k, v in raw)


def frames_bytes(frames) -> bytes:
    return b"".join(struct.pack("<IIBB", i, len(d), kind, flags) + d for i, kind, flags, d in frames)


def corr_bytes(records) -> bytes:
    return b"".join(struct.pack("<II", i, len(d)) + d for i, d in records)


def cover_bytes(mime: str, image: bytes) -> bytes:
    return COVER_MAGIC + bytes([len(mime)]) + mime.encode() + image


def file_header(flags: int = 0) -> bytes:
    return MAGIC + bytes([VERSION, 0, 0, 0]) + struct.pack("<I", flags)


def write(head: bytes, meta=(), cover: bytes | None = None, frames=(), seek=None, wave=None, info=(), corr=(), optional=(), extra=(), file_flags: int = 0) -> bytes:
    """A whole file, chunks in the format's order, with a CRC on every chunk."""
    parts = [chunk("HEAD", head)]
    if meta:
        parts.append(chunk("META", meta_bytes(meta)))
    if cover is not None:
        parts.append(chunk("COVR", cover))
    parts.append(chunk("AUDI", frames_bytes(frames)))
    if seek is not None and len(seek):
        parts.append(chunk("SEEK", np.asarray(seek, "<u8").tobytes()))
    if wave is not None and len(wave):
        parts.append(chunk("WAVE", struct.pack("<I", len(wave)) + np.asarray(wave, "<f4").tobytes()))
    if info:
        parts.append(chunk("INFO", meta_bytes(info)))
    if corr:
        parts.append(chunk("CORR", corr_bytes(corr)))
    parts += [chunk(k, v) for k, v in (*optional, *extra)]
    return file_header(file_flags) + b"".join(parts)


# ---------------------------------------------------------------- decoders


def head(payload: bytes) -> dict:
    if len(payload) < 18:
        raise ContainerError("HEAD is too short")
    names = ("codec_id", "channels", "bits", "preset", "sample_rate", "total_samples")
    out = dict(zip(names, struct.unpack_from("<BBBBIQ", payload), strict=True))
    return out | {"encoder": struct.unpack_from("<H", payload, 16)[0]}


def clean(text: str, most: int = 8192) -> str:
    return "".join(c for c in text if c in "\t\n\r" or (ord(c) >= 32 and ord(c) != 127))[:most]


def meta(payload: bytes) -> list[tuple[str, str]]:
    """Key-value pairs up to the first that is cut off; values are cleaned."""
    out, at = [], 0
    while at + 2 <= len(payload):
        key_end = at + 2 + struct.unpack_from("<H", payload, at)[0]
        if key_end + 2 > len(payload):
            break
        end = key_end + 2 + struct.unpack_from("<H", payload, key_end)[0]
        if end > len(payload):
            break
        out.append((payload[at + 2 : key_end].decode("utf-8", "replace"), clean(payload[key_end + 2 : end].decode("utf-8", "replace"))))
        at = end
    return out


def frames(payload: bytes) -> list[tuple[int, int, int, bytes]]:
    """(index, block type, flags, data) up to the first record that is cut off."""
    out, at = [], 0
    while at + FRAME_HEADER <= len(payload):
        index, size, kind, flags = struct.unpack_from("<IIBB", payload, at)
        at += FRAME_HEADER
        if at + size > len(payload):
            break
        out.append((index, kind, flags, payload[at : at + size]))
        at += size
    return out


def corr(payload: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at + CORR_HEADER <= len(payload):
        index, size = struct.unpack_from("<II", payload, at)
        at += CORR_HEADER
        if at + size > len(payload):
            break
        out.append((index, payload[at : at + size]))
        at += size
    return out


def seek(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload[: len(payload) // 16 * 16], "<u8").reshape(-1, 2)


def wave(payload: bytes) -> np.ndarray:
    if len(payload) < 4:
        return np.zeros(0, np.float32)
    n = min(struct.unpack_from("<I", payload)[0], (len(payload) - 4) // 4)
    return np.frombuffer(payload, "<f4", n, 4)


def cover(payload: bytes) -> tuple[str | None, bytes]:
    """MIME type and image; a payload without the cover header is a bare image."""
    if payload[:4] == COVER_MAGIC and len(payload) > 4:
        n = payload[4]
        return payload[5 : 5 + n].decode("ascii", "replace"), payload[5 + n :]
    kinds = ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG", "image/png"), (b"GIF8", "image/gif"))
    if payload[:4] == b"RIFF" and payload[8:12] == b"WEBP":
        return "image/webp", payload
    return next((m for p, m in kinds if payload.startswith(p)), None), payload


# ---------------------------------------------------------------- scans


def wanted(fourcc: str, size: int) -> bool:
    """Whether a lazy scan loads a payload at once."""
    return fourcc not in LARGE and size <= (COVER_LIMIT if fourcc == "COVR" else OTHER_LIMIT)


def index(read, size: int, load=wanted, prefix: bool = False):
    """Yields the chunks of a source that `read(offset, length)` reads; payloads only where load(fourcc, size) says so.

    prefix: end at a chunk that is cut off, instead of raising.
    """
    start = read(0, FILE_HEADER)
    if len(start) < FILE_HEADER or start[:4] != MAGIC:
        raise ContainerError("not a container")
    if start[4] != VERSION:
        raise ContainerError(f"version {start[4]} is not supported")
    at, number, seen = FILE_HEADER, 0, {}
    while at + CHUNK_HEADER <= size:
        h = read(at, CHUNK_HEADER)
        fourcc = h[:4].decode("latin-1")
        length, flags, _, stored = struct.unpack("<IHHI", h[4:])
        begin = at + CHUNK_HEADER
        if begin + length > size:
            if prefix:
                return
            raise ContainerError(f"chunk {fourcc} extends past the end")
        c = Chunk(number, fourcc, at, begin, length, flags, stored, seen.get(fourcc, 0))
        seen[fourcc] = c.repeat + 1
        if load(fourcc, length):
            c.payload = bytes(read(begin, length))
            c.crc_ok = crc_ok(c, c.payload)
        yield c
        number, at = number + 1, begin + length
    if at < size and not prefix:
        raise ContainerError("trailing bytes or a chunk header that is cut off")


def parse(data: bytes) -> Parsed:
    """Everything in a file. Of repeated core chunks the last counts, of others the first."""
    out = Parsed()
    for c in index(lambda at, n: data[at : at + n], len(data), lambda *_: True):
        out.chunks.append(c)
        p = c.payload
        if c.crc_ok is False:
            if c.fourcc not in OPTIONAL:
                raise ContainerError(f"CRC mismatch in chunk {c.fourcc}")
            out.warnings.append(f"CRC mismatch in optional chunk {c.fourcc}, skipped")
            continue
        if c.fourcc == "HEAD":
            out.head = head(p)
        elif c.fourcc in ("META", "INFO"):
            setattr(out, c.fourcc.lower(), meta(p))
        elif c.fourcc == "COVR":
            out.cover = cover(p)
        elif c.fourcc == "AUDI":
            out.frames += frames(p)
        elif c.fourcc == "SEEK":
            out.seek = seek(p)
        elif c.fourcc == "WAVE":
            out.wave = wave(p)
        elif c.fourcc == "CORR":
            out.corr += corr(p)
        elif c.fourcc == "STDF":
            out.fragments.append(p)
        elif c.fourcc in out.optional:
            out.warnings.append(f"repeated optional chunk {c.fourcc}, the first is kept")
        else:
            out.optional[c.fourcc] = p
    if out.head is None:
        raise ContainerError("no HEAD chunk")
    return out


def crc_ok(c: Chunk, payload: bytes) -> bool | None:
    """Whether a payload has the CRC of its header; None where the header has none."""
    return zlib.crc32(payload) == c.stored_crc if c.flags & CRC_FLAG else None


def metadata_of(read, size: int) -> tuple[dict | None, list[tuple[str, str]], tuple[str | None, bytes] | None]:
    """HEAD, META and COVR among the first `size` bytes of what read(offset, length) reads; bad CRCs are skipped. Never raises."""
    h, m, c = None, [], None
    try:
        for x in index(read, size, lambda f, _: f in ("HEAD", "META", "COVR"), prefix=True):
            if x.payload is None or x.crc_ok is False:
                continue
            if x.fourcc == "HEAD":
                h = head(x.payload)
            elif x.fourcc == "META":
                m = meta(x.payload)
            else:
                c = cover(x.payload)
    except ContainerError:
        pass
    return h, m, c


def metadata(data: bytes) -> tuple[dict | None, list[tuple[str, str]], tuple[str | None, bytes] | None]:
    """The same from the beginning of a file, however short."""
    return metadata_of(lambda at, n: data[at : at + n], len(data))
