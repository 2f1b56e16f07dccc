"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has at least one in so many of all rows, so there are no more hot keys than that.
SHARE = 1000


def _same(pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def lookup(rows: DataFrame, values: DataFrame, keys: Sequence[str], take: Sequence[str], weight: str, share: int = SHARE) -> DataFrame:
    """rows and the columns `take` of the one row of values that has its keys (null is a key like others); null where values has none.

    values has each key once and says in `weight` how many rows have it. Keys with at least 1 / share of the total weight are at most `share`:
    they are broadcast, so that rows of a hot key stay where they are; all other rows meet the rest of values in a shuffle on the keys.
    """
    total = values.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * share >= total
    own = {k: f"_key_{i}" for i, k in enumerate(keys)}
    side = values.select(*[F.col(k).alias(n) for k, n in own.items()], F.struct(*take).alias("_found"), is_hot.alias("_hot"))
    hot, cold = side.where("_hot").drop("_hot"), side.where("NOT _hot").drop("_hot")
    pairs = list(own.items())
    met = rows.join(F.broadcast(hot), _same(pairs), "left").drop(*own.values())
    found = met.where(F.col("_found").isNotNull())
    rest = met.where(F.col("_found").isNull()).drop("_found").join(cold, _same(pairs), "left").drop(*own.values())
    return found.unionByName(rest).select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in take])
