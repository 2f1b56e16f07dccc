"""Aggregations: folds, fragments, verdicts and signal measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import scans, skew


def fold(df: DataFrame, group: Sequence[str], key: str, value: str, order: str, last: bool = True) -> DataFrame:
    """Per group and key the value that comes last (or first) by order."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*group, key).agg(pick(value, order).alias(value))


def split_text(df: DataFrame, column: str, size: int) -> DataFrame:
    """A row per piece of `size` characters: part (from 0), parts, piece. An empty text is one empty piece."""
    parts = F.greatest(F.ceil(F.length(column) / size), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring(F.col(column), i * size + 1, F.lit(size)))
    return df.withColumn("parts", parts).select("*", F.posexplode(pieces).alias("part", "piece"))


def reassemble(df: DataFrame, group: str, part: str, parts: str, piece: str) -> DataFrame:
    """Per group: the pieces in order, and whether each of 0 .. parts - 1 is there exactly once.

    A group is the pieces of one file, which is a row anyway.
    """
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(part).alias("d"), F.max(parts).alias("p"), F.countDistinct(parts).alias("q"), F.array_sort(F.collect_list(F.struct(part, piece))).alias("a"))
    ok = (F.col("n") == F.col("p")) & (F.col("d") == F.col("p")) & (F.col("q") == 1)
    return g.select(group, ok.alias("complete"), F.when(ok, F.array_join(F.transform("a", lambda x: x[piece]), "")).alias("whole"))


def missing_parts(df: DataFrame, group: str, part: str, count: Column) -> DataFrame:
    """Per group: the numbers of 1 .. count that no row has, and their number."""
    g = df.groupBy(group).agg(F.collect_set(part).alias("seen"), F.max(count).alias("n"))
    return g.select(group, F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("n")), F.col("seen"))).alias("missing"))


def verdict(expected: Column, same: Column) -> list[Column]:
    """Aggregates of three-valued comparisons: none expected is missing; all unknown is unsupported; else ok or failed."""
    some, known, good = F.count_if(expected), F.count_if(same.isNotNull()), F.count_if(same)
    return [F.when(some == 0, "missing").when(known == 0, "unsupported").when(good == known, "ok").otherwise("failed").alias("verdict")]


def peaks(df: DataFrame, index: str, value: str, frames: int, buckets: int = 512) -> DataFrame:
    """The greatest magnitude in each of `buckets` equal runs; frames beyond the last whole run are left out."""
    width = max(1, frames // buckets)
    n = min(buckets, frames)
    return df.where(F.col(index) < width * n).groupBy(F.floor(F.col(index) / width).cast("long").alias("bucket")).agg(F.max(F.abs(value)).alias("peak"))


def peaks_of(df: DataFrame, group: str, order: Sequence[str], value: str, buckets: int = 512) -> DataFrame:
    """The same for each group of rows in their order: group, bucket, peak."""
    rows = scans.running(df.select(group, *order, value), [group], order, {"_i": F.lit(1)}, before=True)
    sizes = df.groupBy(group).agg(F.count("*").alias("_c"))
    rows = skew.lookup(rows, sizes, [group], ["_c"], "_c")
    width, k = F.greatest(F.lit(1), F.floor(F.col("_c") / buckets)), F.least(F.lit(buckets), F.col("_c"))
    return rows.where(F.col("_i") < width * k).groupBy(group, F.floor(F.col("_i") / width).cast("long").alias("bucket")).agg(F.max(F.abs(value)).alias("peak"))


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def snr(signal: Column, error: Column) -> Column:
    """Decibels of signal over error energy: 0 without rows, 120 where the error is nothing."""
    s, e = F.sum(signal * signal), F.sum(error * error)
    return F.when(F.count(signal) == 0, 0.0).when(e < 1e-20, 120.0).otherwise(10 * F.log10(s / e))


def repeat_index(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """How many earlier rows have the same key."""
    return scans.running(df, key, order, {"repeat_index": F.lit(1)}, before=True).withColumn("repeat_index", F.col("repeat_index").cast("int"))


def running_offset(df: DataFrame, group: str, order: Sequence[str], length: str) -> DataFrame:
    """Where each row begins if a group's rows lie end to end."""
    return scans.running(df, [group], order, {"start_offset": F.col(length)}, before=True).withColumn("start_offset", F.col("start_offset").cast("long"))


def rebuilt(df: DataFrame, group: str, order: Sequence[str], difference: str, name: str) -> DataFrame:
    """The values whose first differences these are."""
    return scans.running(df, [group], order, {name: F.col(difference)})


def not_rising(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is less than the one before."""
    return scans.lagged(df, [group], order, value, ["before"]).where(F.col(value) < F.col("before"))


def neighbours(df: DataFrame, group: str, order: str, item: str, readable: Column | None = None, wrap: bool = True) -> DataFrame:
    """Each row's next and previous item (only those that are readable), around the ends if wrap is set.

    Both are last values along the order, up and down; the ends are one row per group, and come back by a lookup.
    """
    good = F.when(F.lit(True) if readable is None else readable, F.struct(F.col(item).alias("i")))
    rows = df.withColumn("_good", good)
    up = scans.running(rows, [group], [order], lasts={"_prev": F.col("_good")}, before=True)
    both = scans.running(up, [group], [order], lasts={"_next": F.col("_good")}, before=True, back=True)
    nxt, prev = F.col("_next"), F.col("_prev")
    if wrap:
        ends = rows.groupBy(group).agg(F.count("*").alias("_n"), F.min_by("_good", F.when(F.col("_good").isNotNull(), F.col(order))).alias("_first"), F.max_by("_good", F.when(F.col("_good").isNotNull(), F.col(order))).alias("_end"))
        both = skew.lookup(both, ends, [group], ["_first", "_end"], "_n")
        nxt, prev = F.coalesce(nxt, F.col("_first")), F.coalesce(prev, F.col("_end"))
    return both.select(*df.columns, nxt["i"].alias("next_item"), prev["i"].alias("prev_item"))


def residuals(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Differences of order 0 to 4 to the values before; a row with fewer before it takes the order that it can."""
    names = [f"_before_{k}" for k in range(1, 5)]
    x = [F.col(value), *map(F.col, names)]
    out, rows = [], [[1], [1, -1], [1, -2, 1], [1, -3, 3, -1], [1, -4, 6, -4, 1]]
    for c in rows:
        full = sum((k * v for k, v in zip(c[1:], x[1:], strict=False)), x[0] * c[0])
        out.append(F.coalesce(full, out[-1]) if out else full)
    return scans.lagged(df, [group], order, value, names).select(*df.columns, *[o.cast("long").alias(f"r{k}") for k, o in enumerate(out)])
