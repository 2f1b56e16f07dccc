"""Incremental ingest of container files into the library table, and its progress (an extension: the formats are batch formats).

Which files are new is keyed state of the stream, and not a scan of the library: a batch costs what it brings. What the library held before the stream's
first batch is the state's beginning. Each batch is a folder of the library, `batch=<id>`, which a batch that is run again writes anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tessera.sources.containers import FILES, parse_files

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """The first row (by path) of each fingerprint that the state doesn't know."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "known boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                row = batch.sort_values("path").head(1)
                first = row if first is None or row.path.iloc[0] < first.path.iloc[0] else first
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first[["fingerprint", "path", "row"]]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if not self.seen.exists():
            self.seen.update((True,))

    def close(self) -> None:
        pass


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.isDirectory() or s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p))


def new_files(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """Of a stream of files (path, content) those whose bytes neither known (fingerprint) nor an earlier file has: fingerprint, path, and the parsed row as JSON."""
    spark = files.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # content goes into the parser and the hash, and no further
    kept = parse_files(files, fingerprint=True)
    rows = kept.select("fingerprint", "path", F.to_json(F.struct(*[c for c in kept.columns if c not in ("fingerprint", "path")])).alias("row"))
    initial = None if known is None else known.select("fingerprint").where("fingerprint IS NOT NULL").distinct().groupBy("fingerprint")
    return rows.groupBy("fingerprint").transformWithStateInPandas(FirstOfKey(), "fingerprint string, path string, row string", "Append", "None", initial)


def watch(spark: SparkSession, folder: str, library: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Follows a folder; once: takes what is there and ends."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    known = spark.read.parquet(library).select("fingerprint") if _exists(spark, library) else None
    rest = ", ".join(c for c in FILES.split(", ") if not c.startswith("path "))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", F.from_json("row", rest).alias("r"), "fingerprint").select("path", "r.*", "fingerprint")
        if not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{library}/batch={checkpoint_name}-{number}")

    checkpoint_name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex[:12]
    out = new_files(files.select("path", "content"), known).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


PROGRESS = "query string, run string, batch long, at string, stage string, rows_in long, state_rows long, state_updates long, batch_ms long"


class Progress(StreamingQueryListener):
    """Writes a row per micro-batch of each query to a folder of JSON files, which spark.read.schema(PROGRESS).json reads.

    stage: started, idle (no rows), rows, or ended. state_rows and state_updates are what the state store holds and wrote (two entries for a fingerprint).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _put(self, **row) -> None:
        jvm = self.spark.sparkContext._jvm
        name = uuid.uuid4().hex
        part, whole = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}") for x in (f".{name}", f"{name}.json"))
        fs = part.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(part)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()
        fs.rename(part, whole)

    def onQueryStarted(self, event) -> None:
        self._put(query=event.name or str(event.id), run=str(event.runId), at=event.timestamp, stage="started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators[0] if p.stateOperators else None
        self._put(query=p.name or str(p.id), run=str(p.runId), batch=p.batchId, at=p.timestamp, stage="rows" if p.numInputRows else "idle", rows_in=p.numInputRows, state_rows=state.numRowsTotal if state else None, state_updates=state.numRowsUpdated if state else None, batch_ms=p.batchDuration)

    def onQueryIdle(self, event) -> None:
        self._put(run=str(event.runId), at=event.timestamp, stage="idle")

    def onQueryTerminated(self, event) -> None:
        self._put(query=str(event.id), run=str(event.runId), stage="ended")


def progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(path)
