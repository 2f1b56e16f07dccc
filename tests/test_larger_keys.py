"""Queries over tables with keys as larger copies have them, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import records
from tessera.operators import catalog, timeline
from tessera.plans import library_queries as plans
from tests.oracle import same


@pytest.fixture
def shifted(sf, tmp_path):
    """make(table, key=by, ...): a connection and a folder with the table, its keys moved on."""

    def make(table, **keys):
        con = duckdb.connect()
        con.sql(f"COPY (SELECT * REPLACE ({', '.join(f'{k} + {by} AS {k}' for k, by in keys.items())}) FROM '{sf}/{table}.parquet') TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        return con, str(tmp_path)

    return make


def test_manifest_dedup_beyond_a_million_parts(spark, shifted):
    con, at = shifted("lineitem", l_partkey="l_linenumber % 3 * 1500000")
    df = plans.QUERIES["manifest_dedup"](spark, at)
    same(df, con, plans.ORACLES["manifest_dedup"])
    assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_nulls_are_no_repeats(spark):
    rows = [(1, 1, None, 1.5), (1, 2, None, 2.5), (1, 3, "x", float("nan")), (1, None, "x", 9.0), (1, 4, "y", float("nan")), (None, 1, "x", 1.5), (None, 2, "x", 2.5), (2, 1, "x", 1.5)]
    got = catalog.keep_first(spark.createDataFrame(rows, "g int, i int, a string, b double"), ["g"], ["i"], ["a", "b"]).collect()
    assert {(r.g, r.i): r.reject for r in got} == {(1, 1): None, (1, 2): None, (1, 3): None, (1, None): "a", (1, 4): "b", (None, 1): None, (None, 2): "a", (2, 1): None}


def test_highlights_parse_beyond_99_minutes(spark, shifted):
    con, at = shifted("events", user_id="event_id % 3 * 300000")
    same(plans.QUERIES["highlights_parse"](spark, at), con, plans.ORACLES["highlights_parse"])


def test_json_records_beyond_a_million_parts(spark, shifted):
    con, at = shifted("part", p_partkey="p_size % 3 * 1200000")
    same(plans.QUERIES["json_records"](spark, at), con, plans.ORACLES["json_records"])


def test_long_times_only_where_asked_for(spark):
    df = spark.createDataFrame([(1, "[99:59-100:00] a\n[100:00.5-12345:01.25|share] b\n[9999999999999:00] c\n[100:60] d\n[100:00-99:00] e")], "i int, h string")
    got = {r.n: r for r in timeline.parse_highlights(df, "i", "h", long=True).collect()}
    assert (got[1].start_ms, got[1].end_ms, got[2].start_ms, got[2].end_ms, got[2].use_case) == (5_999_000, 6_000_000, 6_000_500, 740_701_250, "share")
    assert [got[n].error for n in (3, 4, 5)] == ["Line 3: not a range of times", "Line 4: no such time", "Line 5: ends before it begins"]
    assert all(r.error for r in timeline.parse_highlights(df, "i", "h").collect())


def test_barcodes_have_14_digits_unless_asked(spark):
    df = spark.createDataFrame([('{"upc": "00-12 3456 1000000", "ean": "12345678"}',)], "j string")
    r = df.select(records.identifiers(F.col("j")).alias("a"), records.identifiers(F.col("j"), 15).alias("b")).first()
    assert (r.a.upc, r.a.ean, r.b.upc, r.b.ean) == (None, "12345678", "001234561000000", "12345678")
