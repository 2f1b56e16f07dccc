"""Joins with hot keys."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import skew


def test_lookup(spark):
    keys = ["hot"] * 500 + [None] * 300 + [f"k{i % 90}" for i in range(200)] + ["unlisted"]
    rows = spark.createDataFrame(list(enumerate(keys)), "n long, k string")
    counts = Counter(keys)
    del counts["unlisted"]
    values = spark.createDataFrame([(k, c, f"v-{k}") for k, c in counts.items()], "k string, w long, v string")
    got = skew.lookup(rows, values, ["k"], ["v"], "w", share=10)
    assert {r.n: (r.k, r.v) for r in got.collect()} == {i: (k, None if k == "unlisted" else f"v-{k}") for i, k in enumerate(keys)} and got.count() == len(keys)
    assert skew.lookup(rows, values.limit(0), ["k"], ["v"], "w").where(F.col("v").isNull()).count() == len(keys)
    assert skew.lookup(rows.limit(0), values, ["k"], ["v"], "w").count() == 0
