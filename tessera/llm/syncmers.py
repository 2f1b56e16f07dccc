"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is an anchor if the least hash among its s-byte substrings is that of the first or the last of
them (ties count for the edge). Whether a k-mer is an anchor depends on its own bytes alone, so an edit moves no anchor elsewhere. With K = 16
and S = 8, two in nine k-mers are anchors. A fingerprint is a sketch of fixed size of a text's anchors with their places: in each
of BUCKETS classes of anchor hashes, 16 bits of the least one and 16 bits of where in the text (of 65,536 parts) it first
stands. Two fingerprints are matched by position: of the entries with equal hashes the longest chain that stands in the
same order in both texts counts, and the likeness is its share of the entries that either has. For texts whose common passages
keep their order it estimates the Jaccard likeness of their anchor sets; equal anchors that stand elsewhere don't count.
matches() aligns two texts by all their anchors.

Each text is led by S zero bytes, so that its beginning gives anchors too, however short it is.
A text of 1 to K - S - 1 bytes has one anchor, all of it. Null and empty texts have no anchors, an
empty fingerprint, and likeness 1 with one another, 0 with others. Rows that repeat a doc_id follow one another in the order of
their texts; a null doc_id comes first. In a table of one row the row is its own next. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import count_up_to, mix, slices, table

K, S, BUCKETS = 16, 8, 128
EMPTY = np.iinfo(np.uint64).max


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte position in its text (-S for one that begins with the lead), and text of every anchor of the texts in data."""
    n_texts, size = len(off) - 1, np.diff(off)
    bare, at_bare = data, off
    data = np.insert(data, np.repeat(off[:-1], S), 0)
    off = off + S * np.arange(n_texts + 1)
    parts = []
    m = len(data) - K + 1
    if m > 0:
        word = np.zeros(len(data) - S + 1, np.uint64)
        for j in range(S):
            word |= data[j : len(data) - S + 1 + j].astype(np.uint64) << np.uint64(8 * j)
        h = mix(word)
        two = np.minimum(h[:-1], h[1:])
        four = np.minimum(two[:-2], two[2:])
        inner = np.minimum(four[1 : m + 1], four[4 : m + 4])  # s-mers 1 to 7 of the k-mer
        edge = np.minimum(h[:m], h[K - S : K - S + m]) <= inner
        at = np.flatnonzero(edge)
        text = np.searchsorted(off, at, "right") - 1
        inside = at + K <= off[text + 1]
        at, text = at[inside], text[inside]
        parts.append((mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + K - S]), at - off[text] - S, text))
    found = np.bincount(parts[0][2], minlength=n_texts) if parts else np.zeros(n_texts, np.int64)
    rest = np.flatnonzero((size > 0) & (found == 0))
    if len(rest):
        whole = [int.from_bytes(hashlib.blake2b(bare[at_bare[i] : at_bare[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in rest]
        parts.append((np.array(whole, np.uint64), np.zeros(len(rest), np.int64), rest))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def sketches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of BUCKETS least anchor hashes per text (EMPTY where there is none), and of where each first stands, in 65,536ths of the text."""
    h, pos, text = anchors(data, off)
    at = text * BUCKETS + (h >> np.uint64(57)).astype(np.int64)
    out = np.full((len(off) - 1) * BUCKETS, EMPTY, np.uint64)
    np.minimum.at(out, at, h)
    least = out[at] == h
    at, where = at[least], pos[least] + S
    place = np.full(len(out), np.iinfo(np.int64).max)
    np.minimum.at(place, at, where)
    size = np.repeat(np.diff(off) + S, BUCKETS)
    place = np.where(out == EMPTY, 0, place) * 65536 // np.maximum(size, 1)
    return out.reshape(-1, BUCKETS), place.reshape(-1, BUCKETS)


def _coded(sketch: np.ndarray, place: np.ndarray) -> np.ndarray:
    """32 bits per entry: 16 of the hash (0 where there is none), then 16 of the place."""
    code = np.where(sketch == EMPTY, 0, (sketch & np.uint64(0xFFFF)) % np.uint64(65535) + np.uint64(1))
    return (code.astype(np.uint32) << np.uint32(16) | place.astype(np.uint32)).astype(">u4")


def fingerprint(codes: np.ndarray) -> str:
    return codes.tobytes().hex() if codes.any() else ""


def chain(a: np.ndarray, b: np.ndarray) -> int:
    """The longest run of pairs (a, b) in which neither falls."""
    order = np.lexsort((b, a))
    tops: list[int] = []
    for y in b[order].tolist():
        k = bisect_right(tops, y)
        tops[k : k + 1] = [y]
    return len(tops)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of codes with the same row of others: the share of entries that match in order."""
    x, y = a >> 16, b >> 16
    some, same = ((x != 0) | (y != 0)).sum(1), (x == y) & (x != 0)
    longest = [chain(p[m] & 0xFFFF, q[m] & 0xFFFF) if m.any() else 0 for p, q, m in zip(a, b, same, strict=True)]
    return np.where(some == 0, 1.0, np.array(longest, float).reshape(len(some)) / np.maximum(some, 1))


def decode(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4") if text else np.zeros(BUCKETS, ">u4")


def matches(one: str, other: str, least: int = 2) -> list[tuple[int, int, int, int]]:
    """Where the same passages stand in two texts: runs of equal anchors at one offset, as (start in one, start in other, bytes, anchors).

    All anchors are compared; a run ends where more than four lengths K hold no common anchor. Longest first.
    """
    (h, p, _), (g, q, _) = (anchors(*_flat([t])) for t in (one, other))
    at: dict[int, list[int]] = {}
    for x, i in zip(g.tolist(), q.tolist(), strict=True):
        at.setdefault(x, []).append(i)
    by: dict[int, list[int]] = {}
    for x, i in sorted(zip(h.tolist(), p.tolist(), strict=True), key=lambda r: r[1]):
        for j in at.get(x, ()):
            by.setdefault(j - i, []).append(i)
    out = []
    for shift, starts in by.items():
        cut = [0, *(k for k in range(1, len(starts)) if starts[k] - starts[k - 1] > 4 * K), len(starts)]
        for a, b in zip(cut, cut[1:], strict=False):
            if b - a >= least:
                low = max(0, starts[a])
                out.append((low, low + shift, starts[b - 1] + K - low, b - a))
    return sorted(out, key=lambda r: (-r[2], r))


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first code points of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches):
    """Rows sorted by (part, at, doc_id, text): each row with at = 0 is compared with the one after it, of the same part."""
    held: list[tuple[int | None, int, int, str]] = []

    def done(rows):
        ids, part, at, texts = zip(*rows, strict=True)
        keep = [i for i in range(len(rows) - 1) if part[i] == part[i + 1] and at[i] == 0]
        new = [edited(texts[i], texts[i + 1]) for i in keep]
        codes, other = _coded(*sketches(*_flat(texts))), _coded(*sketches(*_flat(new)))
        own, following = codes[keep], codes[[i + 1 for i in keep]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in keep], pa.int64()),
                pa.array([len(texts[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                pa.array([fingerprint(c) for c in own], pa.string()),
                pa.array([fingerprint(c) for c in other], pa.string()),
                pa.array(likeness(own, other), pa.float64()),
                pa.array(likeness(own, following), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for part, _, _ in slices(batch, most=2_000_000):
            rows = held + list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "part", "at", "text")), strict=True))
            held = rows[-1:]
            if len(rows) > 1:
                yield done(rows)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """OUT's columns: each document's fingerprint, that of its edited text, and their likenesses.

    Documents are dealt to ranges of doc_id that begin at ids of the table, so one shuffle brings neighbours together; the first
    document of a range is sent to the range before as well, and the table's first to the last range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least, bounds, nulls = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts), F.count_if(F.col("doc_id").isNull())).first()
    # a null id comes before all others; a bound is an id of the table that is not its first
    bounds = sorted({b for b in bounds or [] if nulls or b > least})
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(count_up_to(F.col("doc_id"), bounds))
    begins = (F.get(F.array(*map(F.lit, bounds)), F.col("part") - 1) == F.col("doc_id")) if bounds else F.lit(False)
    place = lambda p, at: F.array(F.struct(p.cast("int").alias("part"), F.lit(at).alias("at")))
    none = F.array().cast("array<struct<part:int,at:int>>")
    places = F.concat(place(F.col("part"), 0), F.when(begins, place(F.col("part") - 1, 1)).otherwise(none), F.when(is_first, place(F.lit(len(bounds)), 1)).otherwise(none))
    dealt = docs.withColumn("part", part).withColumn("place", F.explode(places)).select("doc_id", "text", "place.part", "place.at")
    return dealt.repartition("part").sortWithinPartitions("part", "at", "doc_id", "text").mapInArrow(_compare, OUT)


def positions(docs: DataFrame) -> DataFrame:
    """A row per anchor: doc_id, pos (byte), anchor. For matching where in two texts the same passages stand."""

    def run(batches):
        for batch in batches:
            for part, data, off in slices(batch):
                h, pos, text = anchors(data, off)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array(pos), pa.array(h.view(np.int64))], ["doc_id", "pos", "anchor"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, pos long, anchor long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
