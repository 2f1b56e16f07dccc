"""Token-ID files with a minimal perfect hash index, written in ascending doc_id order and read back by range or by key.

A shard file, little-endian throughout:

    magic "TIDS0001"
    ids       uint16 or uint32, all documents end to end
    ends      uint64 per document: ids before its end
    keys      int64 per document
    flags     uint8 per document: 1 where the key is null
    levels    bit arrays of the hash index
    ranks     uint32 per GROUP bits of a level: set bits before them, in the level and those before it
    prints    uint32 per distinct key, in hash order: fingerprints
    places    uint32 per distinct key, in hash order: the first document that has the key
    footer    JSON with every part's offset, length and type; then its length as uint32 and the magic again

The index hashes a shard's distinct keys to 0 .. n - 1 by levels of bit arrays (a key sits at the first level where no other
key shares its bit; its number is the count of set bits before it). A lookup reads, for each level that it tries (1.6 on average),
one group of GROUP bits and its rank; then a fingerprint, a place and the key there: as many bytes in a large shard as in a small one.
A key that the shard doesn't hold is told by its fingerprint, with one error in 2**32, and by the key column. Shards
follow one another in key order; the manifest's first and last keys route a lookup to its shard.

Documents with null doc_ids come first. Rows that repeat a doc_id are in the order of their texts' hashes, may lie in several
shards, and a lookup returns the first of them. Null and empty texts are one end id. An empty table gives no shards and an
empty manifest.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import commit_file, file_size, materialize, mix, read_range, scratch, table
from tessera.llm.tokens import VOCABULARY, crc32, encoder

MAGIC = b"TIDS0001"
#: The least number of bits per remaining key of a level, and bits per rank.
GAMMA, GROUP = 2.0, 512
#: Documents that a task reads back, and those of a range read.
PART, BLOCK = 1 << 18, 4096
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_key long, last_key long, id_bytes int"


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """levels: (bits in the level, packed bits, set bits before the level)."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels, before = [], 0
        for size, packed in levels:
            bits = np.unpackbits(packed, bitorder="little")[:size]
            rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
            self.levels.append((size, bits, rank, before))
            before += int(rank[-1])
        self.n = before

    @staticmethod
    def build(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """keys: distinct int64."""
        levels, rest = [], keys
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            at = _slot(rest, len(levels), size)
            count = np.bincount(at, minlength=size)
            levels.append((size, np.packbits(count == 1, bitorder="little")))
            rest = rest[count[at] > 1]
        return levels

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 for keys that no level holds."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (size, bits, rank, before) in enumerate(self.levels):
            at = _slot(keys[todo], k, size)
            hit = bits[at] == 1
            out[todo[hit]] = before + rank[at[hit]]
            todo = todo[~hit]
        return out


def _write_shard(path: str, id_bytes: int, chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    """chunks: (keys, null flags, ids, ids per document), in order. Ids are streamed; keys and ends are kept till the end."""
    keys, flags, counts = [], [], []

    def write(sink) -> None:
        at, parts = 0, {}

        def put(name: str, x: np.ndarray, **more) -> None:
            nonlocal at
            sink.write(x.tobytes())
            parts.setdefault(name, []).append({"at": at, "n": len(x), "type": x.dtype.str, **more})
            at += x.nbytes

        sink.write(MAGIC)
        at = len(MAGIC)
        n_ids = 0
        for k, f, ids, n in chunks:
            x = ids.astype(f"<u{id_bytes}")
            sink.write(x.tobytes())
            n_ids += len(x)
            keys.append(k)
            flags.append(f)
            counts.append(n)
        parts["ids"] = [{"at": at, "n": n_ids, "type": f"<u{id_bytes}"}]
        at += n_ids * id_bytes
        key, flag, n = np.concatenate(keys), np.concatenate(flags), np.concatenate(counts)
        put("ends", np.cumsum(n).astype("<u8"))
        put("keys", key.astype("<i8"))
        put("flags", flag.astype(np.uint8))
        named = np.flatnonzero(flag == 0)
        distinct, first = np.unique(key[named], return_index=True)
        levels = PerfectHash.build(distinct)
        before = 0
        for size, packed in levels:
            put("levels", packed, bits=size)
            groups = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(0, len(packed), GROUP // 8))
            put("ranks", (before + np.cumsum(groups) - groups).astype("<u4"))
            before += int(groups.sum())
        number = PerfectHash(levels).number(distinct)
        prints, places = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
        prints[number], places[number] = fingerprint(distinct), named[first]
        put("prints", prints)
        put("places", places)
        foot = json.dumps(parts).encode()
        sink.write(foot + struct.pack("<I", len(foot)) + MAGIC)

    commit_file(path, write)
    key, flag = np.concatenate(keys), np.concatenate(flags)
    named = key[flag == 0]
    return {"path": path, "n_docs": len(key), "n_ids": int(sum(int(n.sum()) for n in counts)), "first_key": int(named[0]) if len(named) else None, "last_key": int(named[-1]) if len(named) else None, "id_bytes": id_bytes}


class Shard:
    """Reads a shard file by ranges; read counts the bytes."""

    def __init__(self, path: str):
        self.path, size, self.read = path, file_size(path), 0
        tail = read_range(path, size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"not a token-id shard: {path}")
        n = struct.unpack("<I", tail[:4])[0]
        self.parts = json.loads(read_range(path, size - 12 - n, n))

    def part(self, name: str, low: int = 0, high: int | None = None, k: int = 0) -> np.ndarray:
        p = self.parts[name][k]
        high, width = p["n"] if high is None else min(high, p["n"]), np.dtype(p["type"]).itemsize
        raw = read_range(self.path, p["at"] + low * width, max(0, high - low) * width)
        self.read += len(raw)
        return np.frombuffer(raw, p["type"])

    def index(self) -> PerfectHash:
        return PerfectHash([(p["bits"], self.part("levels", k=k)) for k, p in enumerate(self.parts.get("levels", []))])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each of many keys, by the whole index; -1 where the shard has none."""
        number = self.index().number(keys)
        prints, places = self.part("prints"), self.part("places").astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        ok = number >= 0
        ok[ok] = prints[number[ok]] == fingerprint(keys[ok])
        out[ok] = places[number[ok]]
        return out

    def find_one(self, key: int) -> int:
        """The first document of a key, by reads of constant size; -1 where the shard has none."""
        x = np.array([key], np.int64)
        for k, p in enumerate(self.parts.get("levels", [])):
            at = int(_slot(x, k, p["bits"])[0])
            group = at // GROUP
            packed = self.part("levels", group * GROUP // 8, (group + 1) * GROUP // 8, k)
            bits = np.unpackbits(packed, bitorder="little")
            if bits[at % GROUP]:
                number = int(self.part("ranks", group, group + 1, k)[0]) + int(bits[: at % GROUP].sum())
                if self.part("prints", number, number + 1)[0] != fingerprint(x)[0]:
                    return -1
                place = int(self.part("places", number, number + 1)[0])
                return place if int(self.part("keys", place, place + 1)[0]) == key else -1
        return -1

    def ids(self, doc: int) -> np.ndarray:
        ends = self.part("ends", max(0, doc - 1), doc + 1).astype(np.int64)
        return self.part("ids", 0 if doc == 0 else int(ends[0]), int(ends[-1]))


def _encode_shards(folder: str, vocabulary: str, end_id: int, id_bytes: int):
    import os

    def run(batches):
        from pyspark import TaskContext

        made = encoder(vocabulary)

        def chunks():
            for batch in batches:
                for part, ids, off in made.texts(batch):
                    n = np.diff(off)
                    with_end = np.insert(ids, off[1:], end_id)
                    key = part.column("doc_id")
                    yield key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False), with_end, n + 1

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return
        context = TaskContext.get()
        shard = context.partitionId()

        def rest():
            yield first
            yield from stream

        got = _write_shard(f"{folder}/shard-{shard:06d}-{context.taskAttemptId()}-{os.getpid()}.tids", id_bytes, rest())
        yield pa.RecordBatch.from_pylist([{"shard": shard, **got}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("id_bytes", pa.int32())]))

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) and writes one file per range of doc_id; returns the manifest (MANIFEST's columns).

    One shuffle carries the texts; each task encodes what it receives in order and streams the ids to its file. Files of
    attempts that were lost are not in the manifest, which is a table in the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return materialize(dealt.mapInArrow(_encode_shards(folder, vocabulary, end_id, 2 if vocabulary == VOCABULARY else 4), MANIFEST), "manifest")


def _read_parts(batches):
    """For each (path, low, high, base): the documents of a shard whose keys stand at [low, high), found by their keys; base is the number of ids before it.

    The shard's index is read once for a part. A document is where the hash of its key says; those that repeat a key follow its first.
    """
    for batch in batches:
        for r in batch.to_pylist():
            shard = Shard(r["path"])
            keys, null = shard.part("keys", r["low"], r["high"]), shard.part("flags", r["low"], r["high"]) == 1
            place = np.arange(r["low"], r["high"])  # documents without a key
            if not null.all():
                named = keys[~null]
                first = shard.find(named)
                new = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
                run = np.diff(np.append(new, len(named)))
                begun = place[~null][new]  # a run of one key may begin in the part before
                begun[0] = first[0] if first[0] < begun[0] else begun[0]
                place[~null] = first + place[~null] - np.repeat(begun, run)
                if (first < 0).any() or (shard.part("keys", r["low"], r["high"])[place - r["low"]] != keys).any():
                    raise ValueError(f"the index of {r['path']} misses keys of its own")
            for at in range(0, len(place), BLOCK):
                now, none = place[at : at + BLOCK], null[at : at + BLOCK]
                low, high = int(now.min()), int(now.max()) + 1
                ends = shard.part("ends", max(0, low - 1), high).astype(np.int64)
                ends = ends if low else np.concatenate(([0], ends))
                start, end = ends[now - low], ends[now - low + 1]
                ids = shard.part("ids", int(ends[0]), int(ends[-1]))
                crc = [crc32(ids[a - ends[0] : b - ends[0]]) for a, b in zip(start, end, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + BLOCK], mask=none), pa.array(start + r["base"]), pa.array(end - start), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, part: int = PART) -> DataFrame:
    """Every document of the files, through the index: doc_id, start, n_tokens, ids_crc32. A task reads parts of `part` documents."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    plan = manifest.select("path", "n_docs", before.alias("base"))  # a row per file
    plan = plan.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(part).cast("long"))))
    plan = plan.select("path", "low", F.least(F.col("low") + part, "n_docs").alias("high"), "base")
    tasks = manifest.select(F.sum(F.ceil(F.col("n_docs") / part))).first()[0] or 1
    return plan.repartition(int(tasks), "path", "low").mapInArrow(_read_parts, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: list[int]) -> dict[int, np.ndarray | None]:
    """Keyed access from the driver: the ids of a few keys (None where no file has the key)."""
    shards = manifest.where("first_key IS NOT NULL").orderBy("shard").collect()
    out: dict[int, np.ndarray | None] = {}
    for k in keys:
        out[k] = None
        for s in shards:
            if s.first_key <= k <= s.last_key:
                shard = Shard(s.path)
                at = shard.find_one(k)
                if at >= 0:
                    out[k] = shard.ids(at)
                    break
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "tids"))
    return read_token_files(manifest)
