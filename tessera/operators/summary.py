"""What a library shows of a file without its bytes: twenty columns from the parsed file and its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import records
from tessera.functions.names import codec_label
from tessera.kernels.container import CRC_FLAG, OPTIONAL
from tessera.operators.catalog import first_filled, meta_value

# Fixed values of the format: codecs by number, the largest cover that is kept as a thumbnail, and what is said of codecs.
CODEC_NAMES = ["pcm", "mp5c", "mp5l", "mp5h", "passthrough"]
PCM, LOSSY, LOSSLESS, HYBRID = 0, 1, 2, 3
THUMBNAIL = 48 * 1024
LAB = "Lab/research codec. May add audible hiss on all presets. Not recommended for normal listening."
NO_CORRECTION = "MP5-H without CORR: playback uses MP5-C base only and may contain hiss or artifacts."
NOT_ENHANCED = "CORR chunk present but enhanced decode was not used."
NOT_DEFAULT = "Not the default MP5-L v3 listening mode."
NOTICES = [("explicit", "Explicit"), ("strongLanguage", "Strong language"), ("matureThemes", "Mature themes")]
COMFORT = [("SAFE", "Listener comfort"), ("SENS", "Sensitive themes"), ("RECV", "Recovery / haven")]


def texts(chunks: DataFrame) -> DataFrame:
    """path and `texts`, a map from FourCC to text, of chunk rows: the first of each optional chunk whose CRC holds."""
    good = chunks.where(F.col("fourcc").isin(*OPTIONAL) & ((F.col("flags").bitwiseAND(CRC_FLAG) == 0) | (F.crc32("payload") == F.col("stored_crc"))))
    first = good.groupBy("path", "fourcc").agg(F.min_by("payload", "repeat_index").alias("p"))
    text = F.decode(F.col("p"), "UTF-8")
    return first.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("fourcc", text.alias("text")))).alias("texts"))  # 17 at most


def format_warnings(codec: Column, has_correction: Column) -> Column:
    return F.array_compact(F.array(F.when(codec == LOSSY, LAB), F.when(codec == HYBRID, F.when(has_correction, NOT_ENHANCED).otherwise(NO_CORRECTION)), F.when(~codec.isin(LOSSLESS, PCM), NOT_DEFAULT)))


def summary(files: DataFrame) -> DataFrame:
    """path and twenty columns per file. files: path, parse_error, meta, codec_id, sample_rate, total_samples, n_corr, cover, cover_mime, and texts (a map, or null).

    A file that can't be read has a title from its name and the error; every other column is empty then. Each record is parsed once.
    """
    plain = files.withColumn("texts", F.coalesce("texts", F.create_map().cast("map<string,string>")))
    rows = records.read_all(plain, "texts", "r", strict=False)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.mp5$", "")
    meta = lambda k: meta_value(F.col("meta"), k)
    has = lambda k: F.map_contains_key("texts", F.lit(k))
    none = F.array().cast("array<string>")
    expl = F.col("r.expl")
    notice = F.coalesce(F.exists(F.array(*[expl[f] for f in records.GUIDANCE["EXPL"][0] if f != "aiGenerated"]), lambda x: x) | (F.size(expl["contentWarnings"]) > 0), F.lit(False))
    said = F.array_compact(F.concat(F.array(*[F.when(expl[f], t) for f, t in NOTICES]), F.coalesce(F.slice(expl["contentWarnings"], 1, 3), none), F.array(*[F.when(has(k), t) for k, t in COMFORT])))
    seconds = F.when((F.col("sample_rate") > 0) & (F.col("total_samples") > 0), F.col("total_samples") / F.col("sample_rate"))
    cover = F.coalesce(F.octet_length("cover"), F.lit(0))
    small = cover.between(1, THUMBNAIL)
    identity = F.col("r.fing.identity")
    return rows.select(
        "path", F.coalesce(meta("title"), first_filled(name), F.lit("Untitled")).alias("title"), *[F.coalesce(meta(k), F.lit("")).alias(k) for k in ("artist", "album", "genre")],
        seconds.alias("duration_sec"), F.when(F.col("codec_id").isNull(), "—").otherwise(codec_label(F.coalesce(F.get(F.array(*map(F.lit, CODEC_NAMES)), F.col("codec_id")), F.col("codec_id").cast("string")))).alias("codec_label"),
        F.coalesce("r.mood.tags", none).alias("mood_tags"), F.coalesce("r.vibe.tags", none).alias("vibe_tags"),
        (notice | has("SAFE") | has("SENS") | has("RECV")).alias("has_guidance"), F.array_join(said, " · ").alias("guidance"),
        (cover > 0).alias("has_cover"), has("LYRC").alias("has_lyrics"), (F.coalesce(F.size("r.stem"), F.lit(0)) > 0).alias("has_stems"), F.greatest(F.coalesce(F.size("r.stem"), F.lit(0)), F.lit(0)).alias("stem_count"),
        F.when(F.col("codec_id").isNull(), none).otherwise(format_warnings(F.col("codec_id"), F.col("n_corr") > 0)).alias("format_warnings"), "parse_error",
        identity.alias("fingerprint_key"), F.col("r.fing").isNotNull().alias("has_fingerprint"),
        F.when(small, F.col("cover")).alias("thumbnail"), F.when(small, first_filled(F.col("cover_mime"), F.lit("image/jpeg"))).alias("thumbnail_mime"),
    )
