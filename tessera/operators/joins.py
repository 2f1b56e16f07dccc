"""Lookups: as-of, prioritised keys, audits, positions and ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import intervals, scans


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the last right row of its key whose time is at most left's.

    One shuffle: both sides are united and the last right row is carried forward in time, from slice to slice where a key is hot; at equal times
    right rows come first. Of right rows at the same time the one with the greatest values counts.
    """
    one = right.where(F.col(right_time).isNotNull()).groupBy(*key, right_time).agg(F.max(F.struct(*values)).alias("_v"))
    tagged = one.select(*key, F.col(right_time).alias("_t"), "_v", F.lit(0).alias("_side"), F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    rows = left.select(*key, F.col(left_time).alias("_t"), F.lit(None).cast(one.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    found = scans.running(tagged.unionByName(rows), key, ["_t", "_side"], lasts={"_found": F.col("_v")}).where("_side = 1")
    return found.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def first_key(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], take: str, out: str, order: str | None = None) -> DataFrame:
    """left and the `take` of the right row that matches on the first pair of keys that matches any; of several, the last by `order` (by take itself if not given)."""
    got, names = left, []
    for i, (a, b) in enumerate(pairs):
        side = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"_k{i}")).agg(F.max_by(take, order or take).alias(f"_v{i}"))
        got = got.join(side, F.col(a) == F.col(f"_k{i}"), "left")
        names.append(f"_v{i}")
    return got.withColumn(out, F.coalesce(*names)).select(*left.columns, out)


def audit(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Every key of either side with its status: ok, missing or unexpected."""
    a = expected.select(F.col(key).alias("_a")).distinct()
    b = actual.select(F.col(key).alias("_b")).distinct()
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").otherwise("ok").alias("status"))


def by_position(entries: DataFrame, parts: DataFrame, group: str, entry_order: str, part_order: str, value: str, out: str) -> DataFrame:
    """parts and, as out, the value of the entry with the same number in the group; the last entry serves the parts beyond it."""
    e = scans.row_number(entries.select(F.col(group).alias("_g"), F.col(entry_order).alias("_o"), F.col(value).alias(out)), ["_g"], ["_o"], "_e")
    p = scans.row_number(parts, [group], [part_order], "_n")
    n = e.groupBy("_g").agg(F.max("_e").alias("_c"))
    p = p.join(n.withColumnRenamed("_g", "_h"), F.col(group) == F.col("_h"), "left").withColumn("_at", F.least("_n", "_c"))
    return p.join(e.drop("_o"), (F.col(group) == F.col("_g")) & (F.col("_at") == F.col("_e")), "left").select(*parts.columns, out)


def in_range(points: DataFrame, ranges: DataFrame, at: str, early: float = 0.05) -> DataFrame:
    """points with the names of the ranges (name, low, high, looped) that hold them, and loop or stop from high - early on.

    An equi-join on bins, so there may be any number of ranges.
    """
    late = F.col(at) >= F.col("high") - early
    held = intervals.holding(points, ranges.select("name", "low", "high", "looped"), at)
    return held.withColumn("action", F.when(late & F.col("looped"), "loop").when(late, "stop").otherwise("play"))


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the rows of new whose key old lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))
