"""Scans within keys, against plain loops, with a key of most rows cut into slices."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scans


def data(n=900):
    rng = random.Random(4)
    keys = ["hot"] * (n // 2) + [None] * (n // 4) + [f"k{i}" for i in range(n - n // 2 - n // 4)]
    rows = [(i, k, rng.randrange(40) if i % 11 else None, None if rng.random() < 0.6 else rng.randrange(1000)) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        by.setdefault(r[1], []).append(r)
    return by


@pytest.mark.parametrize("part", [10**6, 40, 7])
@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("back", [False, True])
def test_running(spark, part, before, back):
    rows = data()
    df = spark.createDataFrame(rows, "id long, k string, t int, v int")
    got = scans.running(df, ["k"], ["t", "id"], {"n": F.lit(1), "s": F.col("v")}, {"last": F.col("v")}, before, part=part, back=back).collect()
    want = {}
    for group in in_order(rows).values():
        group = group[::-1] if back else group
        n = s = 0
        last = None
        for i, _, _, v in group:
            old = n, s, last
            n, s, last = n + 1, s + (v or 0), last if v is None else v
            want[i] = old if before else (n, s, last)
    assert {r.id: (r.n, r.s, r["last"]) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("part", [10**6, 40, 3])
def test_lagged(spark, part):
    rows = data()
    df = spark.createDataFrame(rows, "id long, k string, t int, v int")
    got = scans.lagged(df, ["k"], ["t", "id"], "v", ["a", "b", "c"], part).collect()
    want = {}
    for group in in_order(rows).values():
        for j, r in enumerate(group):
            want[r[0]] = tuple(group[j - d][3] if j >= d else None for d in (1, 2, 3))
    assert {r.id: (r.a, r.b, r.c) for r in got} == want


def test_a_hot_key_is_spread(spark):
    df = spark.range(6000).select(F.lit("one").alias("k"), "id")
    rows, hot = scans.sliced(df, ["k"], ["id"], 500)
    sizes = [r["count"] for r in rows.groupBy("_slice").count().collect()]
    assert hot and len(sizes) >= 6 and max(sizes) < 2500 and sum(sizes) == 6000
    assert not scans.sliced(df, ["k"], ["id"], 6000)[1] and not scans.sliced(df.limit(0), ["k"], ["id"], 5)[1]


def test_equal_rows_and_no_rows(spark):
    same = spark.createDataFrame([("a", 1)] * 50, "k string, t int")
    assert sorted(r.n for r in scans.row_number(same, ["k"], ["t"], "n", 10).collect()) == list(range(1, 51))
    assert scans.row_number(same.limit(0), ["k"], ["t"], "n").count() == 0 and scans.lagged(same.limit(0), ["k"], ["t"], "t", ["a"]).count() == 0
