"""Albums and stems: manifests, the row that plays, gains, karaoke choices, storage and expected hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import basename, hash_or_null, same_hash, unsafe_path
from tessera.operators import skew

MANIFEST = "struct<format:string,version:int,album:struct<title:string,artist:string,year:int>,tracks:array<struct<trackId:string,file:string,trackNumber:int,discNumber:int,title:string,artist:string,durationMs:double>>>"


def parse_manifest(df: DataFrame, text: str, format_name: str) -> DataFrame:
    """df, `manifest` and `problems` (path: message). A text that is no JSON object has a null manifest."""
    j = F.from_json(F.col(text), MANIFEST)
    is_object = F.coalesce(F.get_json_object(F.col(text), "$").isNotNull() & F.trim(F.col(text)).startswith("{"), F.lit(False))
    per_track = F.flatten(
        F.transform(
            F.coalesce(j["tracks"], F.array().cast("array<struct<trackId:string,file:string,trackNumber:int,discNumber:int,title:string,artist:string,durationMs:double>>")),
            lambda t, i: F.array_compact(
                F.array(
                    F.when(F.coalesce(F.trim(t["trackId"]), F.lit("")) == "", F.concat(F.lit("tracks["), i, F.lit("].trackId: missing"))),
                    F.when(F.coalesce(F.trim(t["file"]), F.lit("")) == "", F.concat(F.lit("tracks["), i, F.lit("].file: missing"))),
                    F.when(unsafe_path(t["file"]), F.concat(F.lit("tracks["), i, F.lit("].file: unsafe path"))),
                )
            ),
        )
    )
    whole = F.array_compact(F.array(F.when(j["format"].isNull() | (j["format"] != format_name), F.lit(f"format: expected {format_name}")), F.when(F.size(F.coalesce(j["tracks"], F.array())) == 0, F.lit("tracks: none"))))
    return df.withColumn("manifest", F.when(is_object, j)).withColumn("problems", F.when(is_object, F.concat(whole, per_track)).otherwise(F.array(F.lit("Invalid JSON"))))


def tracks(df: DataFrame, key: str) -> DataFrame:
    """A row per track of df's manifests, with its place by disc (1 where there is none) and number."""
    rows = df.select(key, F.posexplode("manifest.tracks").alias("pos", "t")).select(key, "pos", "t.*", basename(F.lower("t.file")).alias("base"))
    w = Window.partitionBy(key).orderBy(F.coalesce("discNumber", F.lit(1)), F.col("trackNumber").asc_nulls_last(), "pos")
    return rows.withColumn("place", F.row_number().over(w))


def playing(rows: DataFrame, album: str, order: str, keys: Sequence[str], now: DataFrame, item: str) -> DataFrame:
    """For each (album, item) of now the first row of the album that has the item in any of its keys.

    Each key is an equi-join of its own; an OR of keys would be a nested loop.
    """
    long = rows.select(album, order, F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(k).cast("string") for k in keys])))).alias("_k"))
    hit = now.withColumn("_i", F.col(item).cast("string")).join(long.withColumnRenamed(album, "_a"), (F.col(album) == F.col("_a")) & (F.col("_i") == F.col("_k")), "left")
    return hit.groupBy(*now.columns).agg(F.min(order).alias(order))


def gain(stems: DataFrame, group: str, level: Column, muted: Column, solo: Column) -> DataFrame:
    """stems and gain: 0 where muted, or where another stem of the group is solo and this is not."""
    rows = stems.withColumns({"_level": level, "_muted": muted, "_solo": solo})
    groups = rows.groupBy(group).agg(F.bool_or("_solo").alias("_any"), F.count("*").alias("_n"))
    out = skew.lookup(rows, groups, [group], ["_any"], "_n")
    return out.select(*stems.columns, F.when(F.col("_muted"), 0.0).when(F.col("_any") & ~F.col("_solo"), 0.0).otherwise(F.col("_level")).alias("gain"))


def karaoke(stems: DataFrame, group: str, kind: str) -> DataFrame:
    """What a group plays without its voice: its instrumental, else its other stems, else lyrics only."""
    g = stems.groupBy(group).agg(F.bool_or(F.col(kind) == "instrumental").alias("i"), F.bool_or(~F.col(kind).isin("vocals", "instrumental")).alias("o"))
    return g.select(group, F.when(F.col("i"), "instrumental").when(F.col("o"), "stems").otherwise("lyrics").alias("choice"))


def storage(parts: DataFrame, group: str, size: str) -> DataFrame:
    """Number, bytes and largest of each group's parts."""
    return parts.groupBy(group).agg(F.count("*").alias("parts"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def expected_hashes(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """expected (key, sha256) against actual (key, payload): the verdict per key; null where there is nothing to compare."""
    a = actual.select(F.col(key).alias("_k"), F.sha2("payload", 256).alias("_h"))
    return expected.join(a, F.col(key) == F.col("_k"), "left").select(key, same_hash(hash_or_null(F.col("sha256")), F.col("_h")).alias("same"))


def profile(files: DataFrame) -> DataFrame:
    """The compatibility of parsed container files: what each has, and its level."""
    has = lambda *f: F.forall(F.array(*map(F.lit, f)), lambda x: F.array_contains("optional", x))
    basic = F.col("parse_error").isNull() & (F.col("n_frames") > 0)
    titled = F.exists("meta", lambda m: F.lower(m["key"]) == "title")
    return files.select("path", F.coalesce(basic, F.lit(False)).alias("playable"), F.coalesce(titled, F.lit(False)).alias("titled"), F.coalesce(has("LYRC"), F.lit(False)).alias("lyrics"), F.coalesce(has("STEM"), F.lit(False)).alias("stems"), F.when(~F.coalesce(basic, F.lit(False)), "unreadable").when(~F.coalesce(titled, F.lit(False)), "basic").when(F.coalesce(has("LYRC") & has("STEM"), F.lit(False)), "full").otherwise("standard").alias("level"))
