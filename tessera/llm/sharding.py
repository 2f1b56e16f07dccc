"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard has `vnodes` points on a 64-bit ring; a document belongs to the first point clockwise of its doc_id's hash.
No shard takes more than its capacity: keys that overflow a full shard continue clockwise to the next point with room.
At load=None the capacities are the exact even split (counts differ by one at most); at load e they are
ceil((1 + e) * rows / shards), so fewer keys move.

The plan is made on counts per arc (shards * vnodes numbers, a fixed size), never on rows: the driver walks the ring and
says how many of each arc's keys go to which shard and from which slot on. Rows then need only their rank in their part of an
arc. An arc of more than PART rows has a part for each PART rows, dealt by input partition, so a doc_id that a third of all rows share
is ranked by many tasks, more of them as the input grows. The keys of an arc are in the order of their parts, then their hashes.

Null doc_ids are hashed as any value; null and empty texts have size 1 and crc32 0. Repeated rows are rows like others.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

#: BUCKETS: ranges of the ring in the table that finds a key's arc.
SHARDS, VNODES, PART, BUCKETS = 16, 128, 1_000_000, 4096


def ring(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The ring's points in order, with their shards: shards * vnodes pairs, made by Spark's own hash."""
    points = spark.range(shards * vnodes).select((F.col("id") / vnodes).cast("long").alias("shard"), (F.col("id") % vnodes).alias("node"))
    points = points.select(F.xxhash64(F.lit("vnode"), "shard", "node").alias("at"), "shard")
    return sorted((r.at, r.shard) for r in points.collect())


def with_arcs(keyed: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """keyed (with a position `at`) and arc: the index of the first ring point at or after the position (round to 0 at the end).

    A table of BUCKETS rows, which is broadcast, says for each range of the ring which points lie in it and how many before.
    """
    width, least = (1 << 64) // BUCKETS, -(1 << 63)
    inside: list[list[int]] = [[] for _ in range(BUCKETS)]
    for p, _ in points:
        inside[(p - least) // width].append(p)
    rows, before = [], 0
    for b, cuts in enumerate(inside):
        rows.append((b, before, cuts))
        before += len(cuts)
    ranges = keyed.sparkSession.createDataFrame(rows, "bucket int, before int, cuts array<long>")
    bits = BUCKETS.bit_length() - 1
    bucket = (F.shiftright("at", 64 - bits) + BUCKETS // 2).cast("int")
    found = keyed.withColumn("bucket", bucket).join(F.broadcast(ranges), "bucket")
    return found.withColumn("arc", ((F.col("before") + F.size(F.filter("cuts", lambda c: c < F.col("at")))) % len(points)).cast("int")).drop("bucket", "before", "cuts")


def capacities(rows: int, shards: int, load: float | None) -> list[int]:
    if load is None:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-(1 + load) * rows // shards)] * shards


def deal(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """For each arc: (keys, shard, first slot) in the order of its keys' ranks.

    In every round each point takes from its queue what its shard has room for, points in ring order; the rest of the queue
    moves to the next point. A shard's slots are gapless from 0.
    """
    room, used = list(room), [0] * len(room)
    queues = {a: deque([(a, n)]) for a, n in counts.items() if n}
    out: dict[int, list[tuple[int, int, int]]] = {a: [] for a in queues}
    while queues:
        moved: dict[int, deque] = {}
        for at in sorted(queues):
            shard, queue = points[at][1], queues[at]
            while queue and room[shard]:
                arc, n = queue.popleft()
                take = min(n, room[shard])
                out[arc].append((take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                if take < n:
                    queue.appendleft((arc, n - take))
            if queue:
                moved.setdefault((at + 1) % len(points), deque()).extend(queue)
        queues = moved
    return out


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, load: float | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot, home_shard (without bounds) and moved."""
    spark = docs.sparkSession
    points = ring(spark, shards, vnodes)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("string").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.spark_partition_id().alias("task"),
    ).withColumn("at", F.xxhash64(F.lit("key"), "doc_id"))
    keyed = materialize(with_arcs(keyed, points), "keys")
    large = [(r.arc, -(-r.n // PART)) for r in keyed.groupBy("arc").agg(F.count("*").alias("n")).where(F.col("n") > PART).collect()]  # shards * vnodes rows at most
    salts = F.broadcast(spark.createDataFrame(large, "arc int, salts int"))
    keyed = keyed.join(salts, "arc", "left").withColumn("salt", F.pmod(F.xxhash64("task"), F.coalesce("salts", F.lit(1))).cast("int")).drop("task", "salts")

    # ranks within (arc, salt), then the salts of an arc one after another
    part = keyed.groupBy("arc", "salt").agg(F.count("*").alias("n"))
    counted = part.collect()  # at most shards * vnodes rows, and one for each PART rows
    before: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for r in sorted(counted, key=lambda r: (r.arc, r.salt)):
        before[r.arc, r.salt] = total.get(r.arc, 0)
        total[r.arc] = total.get(r.arc, 0) + r.n
    plan = deal(total, points, capacities(sum(total.values()), shards, load))
    spans = []  # of each part of an arc: its first rank within the part, the shard, and slot minus rank
    sizes = {(r.arc, r.salt): r.n for r in counted}
    for (arc, salt), start in before.items():
        end, low = start + sizes[arc, salt], 0
        for n, s, slot in plan[arc]:
            a, b = max(low, start), min(low + n, end)
            if a < b:
                spans.append((arc, salt, a - start, s, slot + a - low - (a - start)))
            low += n
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "salt").orderBy("at", "doc_id", "size", "text_crc32")) - 1)
    spans_ = spark.createDataFrame(spans or [(0, 0, 0, 0, 0)], "arc int, salt int, low long, shard int, shift long")
    steps = spans_.groupBy("arc", "salt").agg(F.sort_array(F.collect_list(F.struct("low", "shard", "shift"))).alias("steps"))
    # a row for each arc or PART rows: broadcast where that is small, by Spark's own measure
    placed = ranked.join(steps, ["arc", "salt"]).withColumn("step", F.element_at(F.filter("steps", lambda x: x.low <= F.col("rank")), -1))
    home = F.get(F.array(*[F.lit(int(s)) for _, s in points]), F.col("arc"))
    return placed.select("doc_id", "size", "text_crc32", F.col("step.shard").alias("shard"), (F.col("rank") + F.col("step.shift")).cast("long").alias("slot"), home.cast("int").alias("home_shard"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
