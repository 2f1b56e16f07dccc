"""Ranks over a whole table, and scratch tables."""

import os
import threading

from pyspark.sql import functions as F

from tessera import scratch
from tessera.operators import ranking
from tessera.operators.catalog import natural_key


def test_row_numbers(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    got = ranking.row_numbers(df, [F.col("k").desc()], "place").collect()
    assert {r.k: r.place for r in got} == {k: 1000 - k for k in range(1000)}
    assert ranking.row_numbers(df.limit(0), [F.col("k")], "place").count() == 0


def test_natural_order_by_base_letters(spark):
    names = ["Émile 10", "emile 9", "EMILE 2", "zoë 1", "Zoe 02", "Übung 1", "ubung 11", "über", "a", "Á1", "10 a", "9 b"]
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string").withColumn("k", natural_key(F.col("name")))
    got = [r.name for r in ranking.row_numbers(df, [F.col("k"), F.col("i")], "place").orderBy("place").collect()]
    assert got == ["9 b", "10 a", "a", "Á1", "EMILE 2", "emile 9", "Émile 10", "über", "Übung 1", "ubung 11", "zoë 1", "Zoe 02"]


def test_sums_before(spark):
    rows = [(i, i % 5, None if i % 7 == 0 else i) for i in range(300)]
    got = ranking.sums_before(spark.createDataFrame(rows, "i long, g long, v long"), [F.col("g"), F.col("i").desc()], F.col("v"), "s").collect()
    want, so_far = {}, 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], -r[0])):
        want[i], so_far = so_far, so_far + (v or 0)
    assert {r.i: r.s for r in got} == want


def test_no_task_sees_all(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranking.row_numbers(spark.range(5000), [F.col("id")], "place")
        assert placed.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
        assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scopes_are_of_a_thread(spark):
    seen = {}
    with scratch.scratch_scope(spark) as outer:
        other = threading.Thread(target=lambda: seen.update(path=scratch.scratch(spark, "x")))
        other.start()
        other.join()
        written = scratch.materialize(spark.range(3), "n")
        assert written.count() == 3 and written.scratch_path.startswith(outer) and not seen["path"].startswith(outer)
    assert not os.path.exists(outer.removeprefix("file://"))
