"""Tables written to the shared folder."""

import time
from concurrent.futures import ThreadPoolExecutor

from tessera import scratch


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_") and name.endswith(".data")}


def test_written_tables_leave_no_shuffle_files(spark):
    """The files of the writing go, the table is read more than once, and the session's own setting is back."""
    assert spark.conf.get(scratch.CLEANUP, "false") == "false"
    before = _shuffle_files(spark)
    counts = scratch.materialize(spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count(), "counts")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert counts.count() == 100 and counts.where("count = 100").count() == 100
    assert spark.conf.get(scratch.CLEANUP) == "false"


def test_writers_of_many_threads(spark):
    """The setting lasts until the last of several writers ends, and comes back after a failed one."""

    def write(n):
        df = spark.range(200).selectExpr("id % 7 AS k").groupBy("k").count()
        if n % 3 == 2:
            df = df.selectExpr("k", "raise_error('planned') AS count")
        try:
            return scratch.materialize(df, "threads").count()
        except Exception as e:
            return "planned" in str(e)

    for own in ("true", "false"):
        spark.conf.set(scratch.CLEANUP, own)
        with ThreadPoolExecutor(4) as pool:
            assert list(pool.map(write, range(6))) == [7, 7, True] * 2
        assert spark.conf.get(scratch.CLEANUP) == own
