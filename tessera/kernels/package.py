"""Album packages: a header, a manifest, a directory, then fragments of container files.

Offsets are 64-bit throughout, and the fragment offset in the header is not relied on: the directory has each record's.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib

# Fixed values of the format.
MAGIC, VERSION, FRAGMENT_VERSION, HEADER, FRAGMENT_HEADER, TRACK_ID_LIMIT = b"MP5P", 1, 1, 40, 14, 128
DEFAULT_PAYLOAD, MOST_PAYLOAD = 12 << 20, 16 << 20


def kind(data: bytes) -> str:
    """binary, json or unknown."""
    if data[:4] == MAGIC:
        return "binary"
    return "json" if data.lstrip()[:1] == b"{" else "unknown"


def fragment(track: str, part: int, parts: int, payload: bytes) -> bytes:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", track):
        raise ValueError(f"bad track id: {track!r}")
    name = track.encode()
    return bytes([FRAGMENT_VERSION, len(name)]) + name + struct.pack("<HHII", part, parts, len(payload), zlib.crc32(payload)) + payload


def _header(data: bytes) -> tuple | None:
    """Name, part, parts, payload's size and CRC, and where the payload begins."""
    if len(data) < 14 or data[0] != FRAGMENT_VERSION or data[1] > TRACK_ID_LIMIT or 14 + data[1] > len(data):
        return None
    at = 2 + data[1]
    return data[2:at].decode("utf-8", "replace"), *struct.unpack_from("<HHII", data, at), at


def fragment_header(data: bytes) -> dict | None:
    """The name and place of a fragment of a stem, from its first bytes."""
    found = _header(data)
    return found and {"stem_id": found[0], "part_index": found[1], "part_count": found[2]}


def fragment_prefix(data: bytes) -> bytes:
    """What there is of a fragment's payload; empty where its header is wrong."""
    found = _header(data)
    return data[found[5] + 12 :][: found[3]] if found else b""


def read_fragment(data: bytes) -> dict | None:
    """A fragment's fields, or None where its header is wrong."""
    found = _header(data)
    if not found:
        return None
    track, part, parts, size, crc, at = found
    payload = data[at + 12 : at + 12 + size]
    if size > MOST_PAYLOAD or len(payload) < size or not re.fullmatch(r"[A-Za-z0-9_-]+", track):
        return None
    return {"track_id": track, "part_index": part, "part_count": parts, "payload_crc": crc, "crc_ok": zlib.crc32(payload) == crc, "payload": payload}


def payload_limit(most: int) -> int:
    return max(1024, min(most, MOST_PAYLOAD))


def split(track: str, data: bytes, most: int = DEFAULT_PAYLOAD) -> list[bytes]:
    most = payload_limit(most)
    parts = -(-len(data) // most)
    return [fragment(track, k, parts, data[k * most : (k + 1) * most]) for k in range(parts)]


def joined(fragments: list[dict]) -> tuple[bytes | None, list[str]]:
    """One track's bytes from its fragments, and what is wrong with them."""
    issues = []
    counts = {f["part_count"] for f in fragments}
    if len(counts) != 1:
        return None, ["fragments disagree about their number"]
    n = counts.pop()
    by = {f["part_index"]: f for f in fragments}
    if len(by) < len(fragments):
        issues.append("a fragment is repeated")
    issues += [f"part {k} is missing" for k in range(n) if k not in by]
    issues += [f"part {k} has a bad CRC" for k, f in sorted(by.items()) if not f["crc_ok"]]
    return (None, issues) if issues else (b"".join(by[k]["payload"] for k in range(n)), [])


def head(manifest: dict, entries: list[tuple[str, int, int]], segments: list[int] = ()) -> bytes:
    """Header, manifest and directory. entries: track, start and length of each fragment in the fragments laid end to end. segments: where each further file begins in them, if there are any."""
    text = json.dumps(manifest | ({"segments": list(segments)} if segments else {}), ensure_ascii=False).encode()
    names = [t.encode() for t, _, _ in entries]
    directory_at = HEADER + len(text)
    at = directory_at + 4 + sum(len(n) + 18 for n in names)
    rows = [struct.pack("<H", len(n)) + n + struct.pack("<QQ", at + start, size) for n, (_, start, size) in zip(names, entries, strict=True)]
    first = MAGIC + struct.pack("<BBHIQQQ", VERSION, 0, 0, len(text), HEADER, directory_at, 0)
    return first.ljust(HEADER, b"\0") + text + struct.pack("<I", len(entries)) + b"".join(rows)


def write(manifest: dict, tracks: list[tuple[str, bytes]], most: int = DEFAULT_PAYLOAD) -> bytes:
    records = [(t, f) for t, data in tracks for f in split(t, data, most)]
    entries, at = [], 0
    for t, f in records:
        entries.append((t, at, len(f)))
        at += len(f)
    return head(manifest, entries) + b"".join(f for _, f in records)


def index(read) -> tuple[dict, list[tuple[str, int, int]]]:
    """The manifest and the directory (track id, offset, length) of a package that read(offset, length) reads; ValueError where it is cut off."""
    try:
        return _index(read)
    except struct.error as e:
        raise ValueError(f"a package is cut off: {e}") from None


def _index(read) -> tuple[dict, list[tuple[str, int, int]]]:
    head = read(0, HEADER)
    if len(head) < HEADER or head[:4] != MAGIC or head[4] != VERSION:
        raise ValueError("not a package of a known version")
    size, at, directory = struct.unpack_from("<IQQ", head, 8)
    manifest = json.loads(read(at, size))
    n = struct.unpack("<I", read(directory, 4))[0]
    out, at = [], directory + 4
    for _ in range(n):
        k = struct.unpack("<H", read(at, 2))[0]
        track = read(at + 2, k).decode()
        out.append((track, *struct.unpack("<QQ", read(at + 2 + k, 16))))
        at += k + 18
    return manifest, out


def place(manifest: dict, entries: list[tuple[str, int, int]], at: int) -> tuple[int | None, int]:
    """The segment file (None: the package itself) and the offset in it of a directory entry that begins at `at`."""
    starts = manifest.get("segments") or []
    if not starts:
        return None, at
    inside = at - min(e[1] for e in entries[:1])  # the first entry is where fragments begin
    k = bisect.bisect_right(starts, inside) - 1
    return k, inside - starts[k]


# ---------------------------------------------------------------- stem data

STDA_VERSION, MOST_STEM = 1, 256 * 1024 * 1024


def stda(stems: list[bytes]) -> bytes:
    """Stem payloads in one chunk: version, count, then each with its length."""
    return bytes([STDA_VERSION, len(stems)]) + b"".join(struct.pack("<I", len(s)) + s for s in stems)


def read_stda(data: bytes | None) -> list[bytes]:
    """The payloads up to one that is cut off or too long; none of another version."""
    if not data or len(data) < 2 or data[0] != STDA_VERSION:
        return []
    out, at = [], 2
    while len(out) < data[1] and at + 4 <= len(data):
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
        if n > min(len(data) - at, MOST_STEM):
            break
        out.append(data[at : at + n])
        at += n
    return out
