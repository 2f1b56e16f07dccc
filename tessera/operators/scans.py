"""Running sums, last values and values before, along an order within each key, where one key may hold a large share of all rows.

A window function sees a key in one task. Here a key of more than `part` rows is cut along the order into slices of about `part` rows; a slice is a
window partition of its own. What a slice hands on (its sum, its last value, its last few rows) is one row per slice; these rows, as many as there are
`part` rows in hot keys, are carried from slice to slice and broadcast. Keys that aren't hot are one slice, and carry nothing.

Where a slice begins is chosen from a sample by hash; which one it is changes no result. Rows that are equal in key and order
lie in one slice, in any order: make the order unique. Null keys are keys like others, null order values come first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

#: Rows of a key beyond which it is cut, and sampled rows for each slice.
PART, SAMPLE = 1_000_000, 16


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def _named(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def _at(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def _up_to(cuts: Column, at: Column) -> Column:
    """How many of the ascending cuts are at most `at`, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(31))])
    fits = lambda n, w: (n + w <= F.size(cuts)) & (F.get(cuts, (n + w - 1).cast("int")) <= at)
    return F.aggregate(steps, F.lit(0), lambda n, w: F.when(fits(n, w), n + w).otherwise(n))


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: int | None = None) -> tuple[DataFrame, bool]:
    """df with _slice (0 for keys that aren't hot) and _hot, and whether there is any hot key."""
    part = part or PART
    hot = materialize(df.groupBy(*_named(keys)).agg(F.count("*").alias("_n")).where(F.col("_n") > part), "hot")
    names = [f"_k{i}" for i in range(len(keys))]
    if hot.isEmpty():
        return df.withColumns({"_slice": F.lit(0), "_hot": F.lit(False)}), False
    some = F.pmod(F.xxhash64(*keys, *order), F.lit(max(1, part // SAMPLE))) == 0
    chosen = df.where(some).join(F.broadcast(hot.drop("_n")), _same(keys)).select(*names, _at(order).alias("_at")).distinct()
    listed = chosen.groupBy(*names).agg(F.array_sort(F.collect_list("_at")).alias("_all"))  # SAMPLE for each `part` rows of a hot key
    every = F.filter(F.sequence(F.lit(1), F.size("_all")), lambda i: i % min(SAMPLE, part) == 0)
    cuts = materialize(hot.drop("_n").join(listed.select(*[F.col(n).alias(f"{n}_") for n in names], F.transform(every, lambda i: F.element_at("_all", i)).alias("_cuts")), _pairs(names), "left").select(*names, F.coalesce("_cuts", F.slice(F.array(F.lit(None).cast(chosen.schema["_at"].dataType)), 1, 0)).alias("_cuts")), "cuts")
    out = df.join(F.broadcast(cuts), _same(keys), "left")
    out = out.withColumns({"_hot": F.col("_cuts").isNotNull(), "_slice": F.when(F.col("_cuts").isNull(), 0).otherwise(_up_to(F.col("_cuts"), _at(order)))})
    return out.drop(*names, "_cuts"), True


def _pairs(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return out


def _carried(rows: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    """rows with the columns of carry (_k0 .., _s, ...) of their slice, null where there is none."""
    return rows.join(F.broadcast(carry), _same(keys) & (F.col("_slice") == F.col("_s")), "left").drop(*[f"_k{i}" for i in range(len(keys))], "_s")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, before: bool = False, part: int | None = None, back: bool = False) -> DataFrame:
    """df and, within each key along the order (back: against it), running sums (0 at the start) and last values that aren't null, of the rows up to each row (before: without it)."""
    sums, lasts = dict(sums or {}), dict(lasts or {})
    rows, hot = sliced(df, keys, order, part)
    rows = rows.withColumns({**{f"_sum_{n}": c for n, c in sums.items()}, **{f"_last_{n}": c for n, c in lasts.items()}})
    along = [F.col(c).desc_nulls_last() if back else F.col(c).asc_nulls_first() for c in order]
    inside = Window.partitionBy(*keys, "_slice").orderBy(*along).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    if hot:
        latest = F.min_by if back else F.max_by
        own = [F.sum(f"_sum_{n}").alias(f"_s_{n}") for n in sums] + [latest(f"_last_{n}", F.when(F.col(f"_last_{n}").isNotNull(), _at(order))).alias(f"_l_{n}") for n in lasts]
        parts = rows.where("_hot").groupBy(*_named(keys), F.col("_slice").alias("_s")).agg(*own)
        earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(F.desc("_s") if back else F.asc("_s")).rowsBetween(Window.unboundedPreceding, -1)
        carry = parts.select(*[f"_k{i}" for i in range(len(keys))], "_s", *[F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in sums], *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in lasts])
        rows = _carried(rows, keys, materialize(carry, "carry"))
    else:
        rows = rows.withColumns({**{f"_s_{n}": F.lit(None).cast("int") for n in sums}, **{f"_l_{n}": F.lit(None) for n in lasts}})
    found = {n: F.coalesce(F.sum(f"_sum_{n}").over(inside), F.lit(0)) + F.coalesce(f"_s_{n}", F.lit(0)) for n in sums}
    found |= {n: F.coalesce(F.last(f"_last_{n}", ignorenulls=True).over(inside), F.col(f"_l_{n}")) for n in lasts}
    return rows.select(*df.columns, *[c.alias(n) for n, c in found.items()])


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, part: int | None = None) -> DataFrame:
    """df and, as `name`, each row's number in its key, from 1."""
    return running(df, keys, order, {name: F.lit(1)}, part=part)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, names: Sequence[str], part: int | None = None) -> DataFrame:
    """df and the value of the row before (names[0]), of the one before that (names[1]), and so on; null where there is none."""
    rows, hot = sliced(df, keys, order, part)
    inside, k = Window.partitionBy(*keys, "_slice").orderBy(*order), len(names)
    if not hot:
        return rows.select(*df.columns, *[F.lag(value, i + 1).over(inside).alias(n) for i, n in enumerate(names)])
    # a slice hands on its last k values, newest first; each slice has a row at least, so k slices before are enough
    from_end = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    tails = rows.where("_hot").withColumn("_n", from_end).where(F.col("_n") <= k).groupBy(*_named(keys), F.col("_slice").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))).alias("_tail"))
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_s").rowsBetween(-k, -1)
    carry = tails.select(*[f"_k{i}" for i in range(len(keys))], "_s", F.slice(F.flatten(F.reverse(F.collect_list("_tail").over(earlier))), 1, k).alias("_before"))
    rows = _carried(rows, keys, materialize(carry, "tails")).withColumn("_n", F.row_number().over(inside))
    out = [F.when(F.col("_n") > i + 1, F.lag(value, i + 1).over(inside)).otherwise(F.get("_before", (F.lit(i + 1) - F.col("_n")).cast("int"))["v"]).alias(n) for i, n in enumerate(names)]
    return rows.select(*df.columns, *out)
