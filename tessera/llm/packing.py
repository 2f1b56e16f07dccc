"""Best-fit packing in bounded space: a fixed number of open bins, found by a bitset keyed by free space.

Documents are cut into pieces of at most CAPACITY ids; only longer documents are cut. Each task packs the pieces of its
partition online, in the order in which they come: a piece goes to the open bin with the least room that fits it; if none
fits, a new bin is opened, and if OPEN bins are open already, the fullest closes first. The pieces of a bin leave when it closes, so a
task holds what lies in its open bins and one batch, whatever it reads; these pieces are not shuffled. The pieces of bins still
open at a task's end go to the next round, which packs them in the same way with a task for PER_TASK * OPEN bins, until one task
is left; the OPEN bins that it leaves open are packed once more, the longest piece first. So what tasks leave half full is
packed again, and no step sees all rows.

Null and empty texts are one end id. Rows that repeat a doc_id are documents like others. An empty table gives no rows. The
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, table
from tessera.llm.tokens import VOCABULARY, crc32, encoder

CAPACITY, OPEN, PER_TASK = 2048, 16384, 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Open bins by free space: one bit for each amount of room that some open bin has."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.n, self.made = capacity, most, 0, 0, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, room: int) -> int:
        bins = self.by_room[room]
        out = bins.pop()
        if not bins:
            self.bits &= ~(1 << room)
        self.n -= 1
        return out

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it that a piece gets."""
        fitting = self.bits >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.n == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, room = self.made, self.capacity
            self.made += 1
        left = room - length
        if left:
            self.by_room[left].append(bin_)
            self.bits |= 1 << left
            self.n += 1
        return bin_, self.capacity - room

    def open(self) -> dict[int, int]:
        """The open bins and the ids that they hold."""
        return {b: self.capacity - room for room, bins in enumerate(self.by_room) for b in bins}


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches):
        for batch in batches:
            for part, ids, off in encoder(vocabulary).texts(batch):
                key = part.column("doc_id").to_pylist()
                rows = []
                for i, k in enumerate(key):
                    x = np.append(ids[off[i] : off[i + 1]], np.uint32(end_id))
                    rows += [(k, p, at, min(capacity, len(x) - at), crc32(x[at : at + capacity])) for p, at in enumerate(range(0, len(x), capacity))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(vocabulary, end_id, capacity), PIECES)


def _pack(capacity: int, most: int):
    """Adds to each row the bin (task << 32 | number) and place it gets, and whether the bin is open at the task's end."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        bins, held = Bins(capacity, most), None

        def of(t: pa.Table, still: bool):
            return t.append_column("open", pa.array(np.full(t.num_rows, still))).to_batches()

        for batch in batches:
            got = np.array([bins.put(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            t = pa.Table.from_batches([batch]).append_column("bin", pa.array(got[:, 0] + task)).append_column("place", pa.array(got[:, 1]))
            t = t if held is None else pa.concat_tables([held, t])
            still = np.isin(t.column("bin").to_numpy() - task, list(bins.open()))
            yield from of(t.filter(pa.array(~still)), False)
            held = t.filter(pa.array(still)).combine_chunks()
        if held is not None:
            yield from of(held, True)

    return run


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, most: int = OPEN, per_task: int = PER_TASK, make=None, columns: str = "") -> DataFrame:
    """pieces (with a column length) and sequence_id, offset. per_task: how many tasks of a round hand their open bins to one of the next.

    make: what turns batches of `pieces` into those of the pieces proper, with these columns, in the worker that packs them.
    """
    added = [T.StructField("bin", T.LongType()), T.StructField("place", T.LongType()), T.StructField("open", T.BooleanType())]
    fields = T._parse_datatype_string(columns).fields if make else pieces.schema.fields
    schema = T.StructType([*fields, *added])
    columns, level, tasks, last, out = [f.name for f in fields], 0, 0, False, None
    run = pack = _pack(capacity, most)
    if make:
        run = lambda batches: pack(make(batches))
    while True:
        packed = materialize(pieces.mapInArrow(run, schema), "packed")
        run = pack
        left = packed.where("open")
        bins = left.select("bin").distinct().count()
        last = last or not bins
        done = (packed if last else packed.where("NOT open")).select(*columns, (F.col("bin") + F.lit(level << 56)).alias("sequence_id"), F.col("place").alias("offset"))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        level, last, tasks = level + 1, tasks == 1, -(-bins // (per_task * most))
        order = F.xxhash64(F.lit(level), "bin", "place")  # a row's own: repeated rows are dealt apart
        pieces = left.repartition(tasks, order).sortWithinPartitions(*[F.desc("length")] * last, order).select(*columns)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return best_fit(docs, capacity, make=_pieces(vocabulary, end_id, capacity), columns=PIECES)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
