"""Catalog operators: search, labels, summaries, guardrails, ordering, duplicates, batches and overrides."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def haystack(*columns: str, tags: Sequence[str] = ()) -> Column:
    """What a search looks in: the columns and the array columns `tags`, lower-cased, joined by spaces."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns], *[F.array_join(F.col(t), " ") for t in tags]))


def search(df: DataFrame, query: str, *columns: str, tags: Sequence[str] = ()) -> DataFrame:
    """Rows whose haystack contains the trimmed, lower-cased query as a literal substring; a blank query keeps all."""
    q = query.strip().lower()
    return df.where(haystack(*columns, tags=tags).contains(q)) if q else df


def label(column: Column, cases: dict[str, str], default: str) -> Column:
    """The first case whose key is a substring of the lower-cased column."""
    out = None
    for key, value in cases.items():
        test = F.lower(column).contains(key)
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(default) if out is None else out.otherwise(default)


def any_flag(*flags: Column) -> Column:
    """Whether any flag is true; null counts as false."""
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def guidance(warnings: Column, most: int = 3) -> Column:
    """The first warnings, joined by a middle dot; null where there are none."""
    return F.when(F.size(warnings) > 0, F.array_join(F.slice(warnings, 1, most), " · "))


def warnings(*cases: tuple[Column, str]) -> Column:
    """The texts of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in cases]))


def meta_value(fields: Column, key: str) -> Column:
    """The value of the first field whose key matches, whatever its case."""
    return F.get(F.filter(fields, lambda x: F.lower(x["key"]) == key.lower()), F.lit(0))["value"]


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def ladder(value: Column, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """The name of the highest threshold that value reaches; steps in any order."""
    out = None
    for least, name in sorted(steps, reverse=True):
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(default)


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank from 1. The rank limit is pushed below the shuffle by Spark."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def natural_key(column: Column) -> Column:
    """A sort key by which digit runs compare as numbers, and letters without case and accents (by their base letters)."""
    parts = F.regexp_extract_all(F.lower(column), F.lit(r"(\d+|\D+)"), 1)
    padded = F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), 20, "0")).otherwise(x))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def probe_duplicates(df: DataFrame, store: DataFrame, key: str, second: Sequence[str], out: str, store_id: str) -> DataFrame:
    """df and, as `out`, the least store_id whose key equals df's, or else the least whose second keys do."""
    first = store.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(store_id).alias("_first"))
    other = store.groupBy(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(second)]).agg(F.min(store_id).alias("_second"))
    match = [F.col(c) == F.col(f"_s{i}") for i, c in enumerate(second)]
    on = match[0]
    for m in match[1:]:
        on = on & m
    joined = df.join(first, F.col(key) == F.col("_k"), "left").join(other, on, "left")
    return joined.withColumn(out, F.coalesce("_first", "_second")).select(*df.columns, out)


def save_unless_duplicate(new: DataFrame, store: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of new whose key the store lacks, the first by `order` of each key."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(store.select(key), key, "left_anti").select(*new.columns)


def merge_queue(old: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """old and those of new whose key neither old nor an earlier row of new has."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_side", order))
    return both.withColumn("_n", rank).where("_side = 0 OR _n = 1").drop("_side", "_n")


def batch_summary(items: DataFrame, status: str, size: str, done: str) -> DataFrame:
    """Rows per status, and the bytes of those done."""
    return items.groupBy(status).agg(F.count("*").alias("n"), F.sum(F.when(F.col(status) == done, F.col(size)).otherwise(F.lit(0))).alias("done_size"))


def retry(items: DataFrame, status: str, failed: str, pending: str) -> DataFrame:
    """Failed rows become pending again."""
    return items.withColumn(status, F.when(F.col(status) == failed, pending).otherwise(F.col(status)))


def override(base: Column, edits: Column) -> Column:
    """Map base with edits on top; an edit to the empty string deletes its key."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(edits, k))
    return F.map_filter(F.map_concat(kept, edits), lambda k, v: v != "")


def keep_first(df: DataFrame, group: Sequence[str], order: str | Sequence[str], keys: Sequence[str]) -> DataFrame:
    """df and `reject` (null, or the key that an earlier kept row of the group has), as if scanned in order.

    A row that is rejected for one key reserves none of its others; a null is no repeat. Rows of a group stream through one task in
    order, nulls last: it holds the keys of the group's kept rows and no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField("reject", T.StringType())])
    arrow, keys, group = to_arrow_schema(schema), list(keys), list(group)

    def values(column: pa.Array) -> list:
        return [v if v == v else "NaN" for v in column.to_pylist()] if pa.types.is_floating(column.type) else column.to_pylist()

    def scan(batches):
        now, seen = None, []
        for b in batches:
            out = []
            for at, row in zip(zip(*map(values, map(b.column, group)), strict=True), zip(*map(values, map(b.column, keys)), strict=True), strict=True):
                if at != now:
                    now, seen = at, [set() for _ in keys]
                bad = None
                for k, v, s in zip(keys, row, seen, strict=True):
                    if v in s:
                        bad = k
                        break
                else:
                    for v, s in zip(row, seen, strict=True):
                        if v is not None:
                            s.add(v)
                out.append(bad)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], schema=arrow)

    return df.repartition(*group).sortWithinPartitions(*group, *[F.col(c).asc_nulls_last() for c in ([order] if isinstance(order, str) else order)]).mapInArrow(scan, schema)


def swap(df: DataFrame, group: str, place: str, at: int) -> DataFrame:
    """The rows at places `at` and at + 1 of each group that has both change places."""
    last = F.max(place).over(Window.partitionBy(group))
    moved = F.when(F.col(place) == at, at + 1).when(F.col(place) == at + 1, at).otherwise(F.col(place))
    return df.withColumn(place, F.when(last > at, moved).otherwise(F.col(place)))


def defaults(rows: DataFrame, album: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """rows with blank or null columns taken from their album's row."""
    side = album.select(F.col(key).alias("_k"), *[F.col(n).alias(f"_{n}") for n in names])
    got = rows.join(side, F.col(key) == F.col("_k"), "left")
    return got.select(*[first_filled(F.col(c), F.col(f"_{c}")).alias(c) if c in names else c for c in rows.columns])


def shuffled(df: DataFrame, key: str, seed: int, first: object = None) -> DataFrame:
    """df in an order that the seed decides, a given row first; the same for the same seed and keys."""
    return df.orderBy(F.when(F.col(key) == F.lit(first), 0).otherwise(1), F.xxhash64(key, F.lit(seed)), key)


def decoded_bytes(frames: Column, channels: Column, width: int = 4) -> Column:
    """Memory of decoded samples."""
    return (F.greatest(frames, F.lit(0)) * F.greatest(channels, F.lit(1)) * width).cast("long")


def has_extension(c: Column, *extensions: str) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions)
