"""The stream that adds new files to the library, and its progress."""

from tessera.kernels import container as ct
from tessera.streaming import ingest


def put(folder, names, extra=b""):
    folder.mkdir(exist_ok=True, parents=True)
    for n in names:
        (folder / f"{n}.bin").write_bytes(ct.write(ct.head_bytes(0, 1, 16, 0, 44100, n), [("title", f"T{n}")], frames=[(0, 0, 0, b"x" * 10 + extra)]))


def test_state_and_progress(spark, tmp_path):
    into, library, state, log = tmp_path / "in", str(tmp_path / "lib"), str(tmp_path / "state"), str(tmp_path / "log")
    listener = ingest.Progress(spark, log)
    spark.streams.addListener(listener)
    try:
        put(into, range(6))
        put(into / "copies", range(3))  # the same bytes under other names
        (into / "bad.bin").write_bytes(b"nothing")
        ingest.watch(spark, str(into), library, state, once=True).awaitTermination()
        first = spark.read.parquet(library)
        assert first.count() == 7 and first.where("parse_error IS NULL").select("total_samples").distinct().count() == 6 and first.where("path LIKE '%copies%'").count() <= 3
        put(into / "more", [1, 2, 7])
        ingest.watch(spark, str(into), library, state, once=True).awaitTermination()
        assert spark.read.parquet(library).count() == 8
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    rows = ingest.progress(spark, log).collect()
    assert {"started", "ended", "rows"} <= {r.stage for r in rows}
    done = sorted((r for r in rows if r.stage == "rows"), key=lambda r: r["at"])
    assert done[0].rows_in == 10 and done[-1].rows_in == 3 and 0 < done[-1].state_updates < done[0].state_updates / 2  # the second batch writes what is new, whatever the library holds


def test_a_library_from_before(spark, tmp_path):
    put(tmp_path / "old", [1, 2])
    ingest.watch(spark, str(tmp_path / "old"), str(tmp_path / "lib"), str(tmp_path / "s1"), once=True).awaitTermination()
    put(tmp_path / "new", [2, 3])
    ingest.watch(spark, str(tmp_path / "new"), str(tmp_path / "lib"), str(tmp_path / "s2"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "lib"))
    assert sorted(r.total_samples for r in got.collect()) == [1, 2, 3]
