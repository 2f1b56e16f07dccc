"""A keyed table in Parquet, by buckets of its key, copied on write.

Rows lie in `data/b=<bucket>/<version>`; a manifest per version (`v/<version>.json`, renamed into place) says which folder each bucket has. put and delete rewrite
only buckets that they touch and write a new manifest; all others keep their folders. Readers hold a manifest, so they are safe from writers until
`vacuum` removes what no kept version names. Of two writers at once the one whose manifest comes second is refused (StoreConflict) and may try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class StoreConflict(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    # ------------------------------------------------------------ manifests

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, root = self._fs(f"{self.path}/v")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(root) if s.getPath().getName().endswith(".json")) if fs.exists(root) else []

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """The version and the folder of each bucket that has rows."""
        known = self.versions()
        if not known:
            return -1, {}
        at = known[-1] if version is None else version
        fs, p = self._fs(f"{self.path}/v/{at}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        if held["buckets"] != self.buckets:
            raise ValueError(f"the store has {held['buckets']} buckets, not {self.buckets}")
        return at, {int(b): f for b, f in held["folders"].items()}

    def _commit(self, before: int, folders: dict[int, str]) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, part = self._fs(f"{self.path}/v/.{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": folders}).encode()))
        out.close()
        to = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v/{before + 1}.json")
        if fs.exists(to) or not fs.rename(part, to):
            fs.delete(part, False)
            raise StoreConflict(f"version {before + 1} was written by another")

    # ------------------------------------------------------------ reads

    def _bucket(self, key: Column) -> Column:
        kind = next(f.dataType for f in self.spark.createDataFrame([], self.schema).schema.fields if f.name == self.key)
        return F.pmod(F.xxhash64(key.cast(kind)), F.lit(self.buckets)).cast("int")

    def _read(self, folders: dict[int, str], some: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}" for b, f in folders.items() if some is None or b in some]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def all(self, version: int | None = None) -> DataFrame:
        return self._read(self._manifest(version)[1])

    def _buckets_of(self, keys) -> set[int]:
        if not keys:
            return set()
        asked = self.spark.createDataFrame([(k,) for k in keys], f"k {self._key_type()}")
        return {r.b for r in asked.select(self._bucket(F.col("k")).alias("b")).distinct().collect()}

    def _key_type(self) -> str:
        return next(f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schema).schema.fields if f.name == self.key)

    def get(self, *keys) -> DataFrame:
        """Only the keys' buckets are read."""
        return self._read(self._manifest()[1], self._buckets_of(keys)).where(F.col(self.key).isin(*keys))

    # ------------------------------------------------------------ writes

    def _rewrite(self, before: int, folders: dict[int, str], touched: set[int], rows: DataFrame) -> None:
        """rows (with _b) become the whole content of the touched buckets."""
        name, out = uuid.uuid4().hex, dict(folders)
        rows.repartition(F.col("_b"), F.pmod(F.xxhash64(self.key), F.lit(8))).write.partitionBy("_b").parquet(f"{self.path}/data/{name}")
        fs, root = self._fs(f"{self.path}/data/{name}")
        written = {int(s.getPath().getName()[3:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("_b=")}
        for b in touched:
            out.pop(b, None)
        for b in written:
            out[b] = f"data/{name}/_b={b}"
        self._commit(before, out)

    def put(self, rows: DataFrame) -> None:
        """Rows replace those of the same key. Of rows of one key in `rows` any one is kept."""
        before, folders = self._manifest()
        new = rows.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]).dropDuplicates([self.key]).withColumn("_b", self._bucket(F.col(self.key)))
        touched = {r["_b"] for r in new.select("_b").distinct().collect()}  # `buckets` at most
        if not touched and folders:
            return
        old = self._read(folders, touched)
        kept = old.join(new.select(F.col(self.key).alias("_key")), F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").withColumn("_b", self._bucket(F.col(self.key)))
        self._rewrite(before, folders, touched, kept.unionByName(new))

    def _delete(self, touched: set[int], gone: DataFrame) -> None:
        before, folders = self._manifest()
        touched &= set(folders)
        if touched:
            old = self._read(folders, touched)
            self._rewrite(before, folders, touched, old.join(gone, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").withColumn("_b", self._bucket(F.col(self.key))))

    def delete(self, keys: DataFrame) -> None:
        gone = keys.select(F.col(self.key).alias("_key")).distinct()
        self._delete({r.b for r in gone.select(self._bucket(F.col("_key")).alias("b")).distinct().collect()}, gone)

    def delete_keys(self, *keys) -> None:
        if keys:
            self._delete(self._buckets_of(keys), self.spark.createDataFrame([(k,) for k in keys], f"_key {self._key_type()}"))

    def clear(self) -> None:
        self._commit(self._manifest()[0], {})

    def vacuum(self, keep: int = 1) -> None:
        """Removes all versions but the last `keep`, and the folders that only they have."""
        known = self.versions()
        used = {f for v in known[-keep:] for f in self._manifest(v)[1].values()}
        fs, root = self._fs(f"{self.path}/data")
        for v in known[:-keep]:
            fs.delete(self._fs(f"{self.path}/v/{v}.json")[1], False)
        for s in fs.listStatus(root) if fs.exists(root) else []:
            name = s.getPath().getName()
            parts = [p.getPath() for p in fs.listStatus(s.getPath()) if p.getPath().getName().startswith("_b=")]
            for p in parts:
                if f"data/{name}/{p.getName()}" not in used:
                    fs.delete(p, True)
            if not any(f.startswith(f"data/{name}/") for f in used):
                fs.delete(s.getPath(), True)
