"""The pipeline's stages on a small table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] > 0.4 * left[0]
    rejected = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").join(docs, "doc_id").count()
    assert rejected <= 3
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("text").alias("b"))
    assert docs.join(F.broadcast(bench), F.expr("contains(text, b)")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == left[-1]


def test_stages_decide_by_row(spark, tmp_path):
    """Null and repeated ids: one row of each group stays, leaking rows go, other rows with the same id stay."""
    words = [f"w{i}" for i in range(60)]
    text, near, lone = " ".join(words), " ".join(["x", *words]), " ".join(f"y{i}" for i in range(60))
    pair, same = " ".join(f"z{i}" for i in range(60)), " ".join(f"s{i}" for i in range(60))
    leak = " ".join(f"b{i}" for i in range(20)) + ". " + " ".join(f"a{i}" for i in range(8)) + "."
    rows = [(1, text, "a"), (None, text, "b"), (None, near, "c"), (1, text, "d"), (7, near, "e"), (7, lone, "f"), (None, pair, "h"), (None, pair, "g"), (None, None, "i"), (9, " ", "j"), (9, " ", "k"), (5, same, "m"), (5, same, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.source for r in kept) == list("afgijkl")
    assert all((r.doc_id, r.text, r.source) in rows for r in kept)

    spark.createDataFrame([(0, leak), (1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, leak, "a"), (1, lone, "b"), (None, "x " + leak, "c"), (None, lone, "d"), (None, None, "e"), (2, leak, "f"), (2, leak, "g"), (3, pair, "h")]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), str(tmp_path))
    assert sorted(r.source for r in kept.collect()) == list("bdeh")


def test_run_on_odd_rows(spark, tmp_path):
    """The whole run with nulls, repeated rows and ids, a long text, clashing columns, and with no rows at all."""
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").orderBy("doc_id").limit(40)
    texts = [r.text for r in good.collect()]
    long = " ".join(texts) * 60
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, texts[0], 0), (1, texts[2], 0), (1, texts[1], 0), (None, None, 0), (77, "", 0), (78, " \n", 0), (79, long, 0), (80, long + " end", 0)]
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    clash = spark.createDataFrame(rows, "doc_id long, text string, h long").selectExpr("*", "h AS v", "h AS n", "'x' AS bin", "h AS length", "h AS y")
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    kept = clash
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == clash.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = kept.collect()
    assert {(r.doc_id, r.piece) for r in got if r.piece == 0} == {(r.doc_id, 0) for r in want}
    ends = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[0] != b[0] and b[1] == 0 or a[0] == b[0] and b[1] == a[1] + a[2] for a, b in zip(ends, ends[1:]))
    assert len([r for r in want if r.text in (long, long + " end")]) <= 1 and len({r.text for r in want if r.text}) == len([r for r in want if r.text])

    spark.createDataFrame([], clash.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_columns_of_any_name_and_type(spark, tmp_path):
    """Names that the stages use themselves, names with dots, and a column without an order; and no labels at all."""
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(30)
    some = good.unionByName(good.limit(3)).select("doc_id", "text", F.col("source").alias("_h"), F.col("lang").alias("_id"), F.lit(1).alias("_one_stays"), F.lit(2).alias("a.b"), F.create_map(F.lit("k"), "source").alias("m"), F.lit(3).alias("x0"), F.lit(None).cast("int").alias("row"))
    some.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == 33  # nothing is known, so all stay
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.schema.names == docs.schema.names, name
    rows = kept.collect()
    assert len({r.text for r in rows}) == len(rows) and all(r["a.b"] == 2 and r["m"] == {"k": r["_h"]} and r["x0"] == 3 for r in rows)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).schema.names == docs.schema.names
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {r.doc_id for r in good.collect()}
