"""Library and album operators: predicates, summaries, guardrails, import lists, verdicts and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import codec_class, number_in_name, source_seconds
from tessera.operators.catalog import haystack, natural_key

MB = 1024 * 1024
# From where a size, a duration, a queue or a store is warned of, and from where it is refused.
SOURCE_BYTES, SOURCE_SECONDS, FILE_BYTES = (80 * MB, 256 * MB), (12 * 60, 45 * 60), 120 * MB
QUEUE, STORE_SHARE = (12, 48), (0.85, 0.98)
# Stems that may be prepared at once, bytes of one and of all (warn, refuse), bytes at which all are refused.
STEMS, STEM_BYTES, SELECTED_BYTES, ALL_BYTES = 32, 128 * MB, (96 * MB, 384 * MB), 512 * MB
STDA_BYTES = 48 * MB
THUMBNAIL = 48 * 1024


def filter_library(df: DataFrame, query: str = "", codec: str = "all", guidance: bool = False, cover: bool = False, lyrics: bool = False, words: Sequence[str] = (), tags: Sequence[str] = ()) -> DataFrame:
    """Rows (codec_label, has_guidance, has_cover, has_lyrics, ...) that meet all five predicates.

    The query is a literal substring of the columns `words` and the array columns `tags`, without case; a blank one holds for all.
    """
    tests = [F.lit(True)]
    if codec != "all":
        tests.append(codec_class(F.col("codec_label")) == codec)
    tests += [F.col(c) for c, asked in (("has_guidance", guidance), ("has_cover", cover), ("has_lyrics", lyrics)) if asked]
    if q := query.strip().lower():
        tests.append(haystack(*words, tags=tags).contains(q))
    for t in tests:
        df = df.where(t)
    return df


def playable(error: Column, file: Column) -> Column:
    return (error.isNull() | (error == "")) & file.isNotNull()


def thumbnail(cover: Column, most: int = THUMBNAIL) -> Column:
    """The cover if it isn't empty or too large for a list; else null."""
    return F.when(F.octet_length(cover).between(1, most), cover)


def step(value: Column, at: tuple[float, float]) -> Column:
    """block, warn or null, by two thresholds."""
    return F.when(value >= at[1], "block").when(value >= at[0], "warn")


def worst(*levels: Column) -> Column:
    """block before warn before info; null where there is none."""
    some = F.array(*levels)
    return F.when(F.array_contains(some, "block"), "block").when(F.array_contains(some, "warn"), "warn").when(F.array_contains(some, "info"), "info")


def source_level(size: Column) -> Column:
    """struct(size, duration): the levels of a source file by its bytes and by how long it may last."""
    return F.struct(step(size, SOURCE_BYTES).alias("size"), step(source_seconds(size), SOURCE_SECONDS).alias("duration"))


def file_level(size: Column) -> Column:
    return F.when(size >= FILE_BYTES, "warn")


def queue_level(pending: Column, total: Column) -> Column:
    """By all entries; a queue that isn't long itself is warned of for those that wait."""
    return F.coalesce(step(total, QUEUE), F.when(pending >= QUEUE[0], "warn"))


def store_level(used: Column, quota: Column) -> Column:
    """Null without a quota."""
    return F.when(quota > 0, step(used / quota, STORE_SHARE))


def stem_safety(stems: DataFrame, group: str, codec: str, frames: str, channels: str) -> DataFrame:
    """Per group: n, bytes (decoded, two a sample), level and reason of preparing its stems together.

    In the order of the rules: all stems too large, too many stems, a codec that isn't decoded or one stem too large,
    the sum too large; then a warning for the sum.
    """
    size = F.greatest(F.col(frames), F.lit(0)) * F.greatest(F.col(channels), F.lit(1)) * 2
    g = stems.groupBy(group).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"), F.max(size).alias("_one"), F.count_if(F.col(codec) == "mp5c").alias("_lab"))
    reason = (
        F.when(F.col("bytes") > ALL_BYTES, "all").when(F.col("n") > STEMS, "count").when(F.col("_lab") > 0, "codec").when(F.col("_one") > STEM_BYTES, "single")
        .when(F.col("bytes") > SELECTED_BYTES[1], "sum").when(F.col("bytes") > SELECTED_BYTES[0], "large")
    )
    return g.withColumn("reason", reason).withColumn("level", F.when(F.col("reason") == "large", "warn").when(F.col("reason").isNotNull(), "block").otherwise("ok")).drop("_one", "_lab")


def completed(items: DataFrame) -> DataFrame:
    """Batch rows that are done and have an output."""
    return items.where("status = 'complete' AND output IS NOT NULL AND output <> ''")


def next_pending(items: DataFrame, group: str, order: str) -> DataFrame:
    """The first waiting row of each batch."""
    return items.where("status = 'pending'").groupBy(group).agg(F.min(order).alias(order)).join(items, [group, order])


def cancel(status: Column, running: Sequence[str] = ("decoding", "encoding", "packaging")) -> Column:
    """Rows at work become cancelled."""
    return F.when(status.isin(*running), "cancelled").otherwise(status)


def by_track_number(rows: DataFrame, group: str, number: str, name: str) -> DataFrame:
    """rows and place: by the given number, or the one that the file name begins with, or 999; then by name."""
    given = F.regexp_extract(F.trim(F.col(number).cast("string")), r"^([+-]?\d+)", 1)
    n = F.coalesce(F.nullif(given, F.lit("")).cast("int"), number_in_name(F.col(name)), F.lit(999))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(n, natural_key(F.col(name)), name)))


def partition_imports(files: DataFrame, existing: DataFrame, group: str, order: str, name: str, supported: Sequence[str]) -> DataFrame:
    """files and fate: unsupported by extension, duplicate of an existing name or an earlier supported one (without case), or import."""
    ok = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*supported)
    have = existing.select(F.col(group).alias("_g"), F.lower(name).alias("_k")).distinct()
    j = files.withColumn("_key", F.lower(name)).withColumn("_ok", ok)
    j = j.join(have, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_key") == F.col("_k")), "left")
    n = F.row_number().over(Window.partitionBy(group, "_key", "_ok").orderBy(order))
    fate = F.when(~F.col("_ok"), "unsupported").when(F.col("_k").isNotNull() | (n > 1), "duplicate").otherwise("import")
    return j.withColumn("fate", fate).select(*files.columns, "fate")


def active_stems(stems: DataFrame, solo_mode: Column) -> DataFrame:
    """Stems (selected, solo, decoded) that sound: decoded ones that are soloed in solo mode, else those selected."""
    return stems.where(F.col("decoded") & F.when(solo_mode, F.col("solo")).otherwise(F.col("selected")))


def sidecar_status(refs: DataFrame, files: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """refs and status: missing, found-no-hash, found-verified or found-mismatch."""
    have = files.select(F.col(key).alias("_k"), F.lower(actual).alias("_h"))
    j = refs.join(have, F.col(key) == F.col("_k"), "left")
    want = F.when(F.trim(expected).rlike("^[A-Fa-f0-9]{64}$"), F.lower(F.trim(expected)))
    status = F.when(F.col("_k").isNull(), "missing").when(want.isNull() | F.col("_h").isNull(), "found-no-hash").when(want == F.col("_h"), "found-verified").otherwise("found-mismatch")
    return j.withColumn("status", status).select(*refs.columns, "status")


def album_verdict(rows: DataFrame, group: str, status: str, warnings: Column) -> DataFrame:
    """Per album: n and verdict: sidecar-missing, hash-warning (a mismatch, or warnings), informational (a file without a hash) or ok."""
    has = lambda s: F.bool_or(F.col(status) == s)
    verdict = F.when(has("missing"), "sidecar-missing").when(has("found-mismatch") | (F.sum(warnings) > 0), "hash-warning").when(has("found-no-hash"), "informational").otherwise("ok")
    return rows.groupBy(group).agg(F.count("*").alias("n"), verdict.alias("verdict"))


def album_preview(rows: DataFrame, group: str, size: str, title: str, artist: str, features: Sequence[str], embedded: bool = True) -> DataFrame:
    """Per album: tracks, bytes, tracks with each feature, without title or artist, and the estimated bytes of a package."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    total = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    more = F.ceil(total * 0.02) + 4096 if embedded else F.lit(0)
    return rows.groupBy(group).agg(F.count("*").alias("tracks"), total.alias("bytes"), *[F.count_if(F.col(f)).alias(f"with_{f}") for f in features], F.count_if(blank(title)).alias("missing_title"), F.count_if(blank(artist)).alias("missing_artist"), (total + more).cast("long").alias("estimated_bytes"))


def export_sizes(parts: DataFrame, group: str, size: str, limit: int = STDA_BYTES) -> DataFrame:
    """Per file: stems, their bytes, the largest, and the storage that these call for."""
    g = parts.groupBy(group).agg(F.count("*").alias("stems"), F.sum(size).cast("long").alias("bytes"), F.max(size).cast("long").alias("largest"))
    return g.withColumn("storage", F.when(F.col("bytes") > limit, "stdf-v1").otherwise("stda-v1"))


def integrity(checks: DataFrame, group: str, kind: str, ok: str) -> DataFrame:
    """Per file of checks (kind: file, pcm, audi, meta, HASH, FING or another chunk; ok: true, false or null): verdict.

    In this order: missing without a check (all kinds null); mismatch if the audio or any chunk differs; audio_verified if the
    payload is equal and the whole file differs, since its hash is taken before the hashes are embedded; unsupported if nothing
    is known; mismatch if the whole file or the metadata differs; else verified.
    """
    k, v = F.col(kind), F.col(ok)
    chunk = ~k.isin("file", "pcm", "audi", "meta")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = checks.groupBy(group).agg(
        F.count(kind).alias("n"),
        F.count_if(k.isNotNull() & v.isNotNull()).alias("known"),
        any_(k.isin("pcm", "audi") & ~v).alias("audio_bad"),
        any_(chunk & ~v).alias("chunk_bad"),
        any_((k == "audi") & v).alias("payload"),
        any_((k == "file") & ~v).alias("file_bad"),
        any_((k == "meta") & ~v).alias("meta_bad"),
    )
    verdict = (
        F.when(F.col("n") == 0, "missing")
        .when(F.col("audio_bad") | F.col("chunk_bad"), "mismatch")
        .when(F.col("payload") & F.col("file_bad"), "audio_verified")
        .when(F.col("known") == 0, "unsupported")
        .when(F.col("file_bad") | F.col("meta_bad"), "mismatch")
        .otherwise("verified")
    )
    return g.select(group, verdict.alias("verdict"))


def gates(rows: DataFrame, group: str, tests: dict[str, Column]) -> DataFrame:
    """Per group: how many rows pass each test, whether all rows pass all, and whether some row does."""
    whole = F.lit(True)
    for t in tests.values():
        whole = whole & F.coalesce(t, F.lit(False))
    return rows.groupBy(group).agg(*[F.count_if(t).alias(f"{n}_pass") for n, t in tests.items()], F.bool_and(whole).alias("all_pass"), F.bool_or(whole).alias("any_pass"))


def hiss_score(quiet_floor_db: Column, hf_error: Column, worst_snr_db: Column) -> Column:
    """The lower, the less a decoded track hisses: its quiet noise floor, error of high frequencies, and worst second."""
    zero = F.lit(0.0)
    return F.greatest(-quiet_floor_db, zero) * 0.5 + hf_error * 1000 * 2.0 + F.greatest(40 - worst_snr_db, zero) * 0.3


def likeness(left: Column, right: Column) -> list[Column]:
    """Aggregates: the uncentred cosine of two signals, and the RMS of their mid and side."""
    cosine = F.sum(left * right) / (F.sqrt(F.sum(left * left) * F.sum(right * right)) + 1e-12)
    return [cosine.alias("cosine"), F.sqrt(F.avg(F.pow((left + right) / 2, 2))).alias("mid_rms"), F.sqrt(F.avg(F.pow((left - right) / 2, 2))).alias("side_rms")]


def mid_side_safe(cosine: Column, mid: Column, side: Column) -> Column:
    """Whether coding by mid and side loses nothing that is heard."""
    return (cosine > 0.87) & (side < mid * 0.42) & (mid > 1e-5)


def clipping(decoded: Column, original: Column) -> list[Column]:
    """Aggregates over 16-bit samples: those at full scale, the greatest difference, and whether none differs."""
    return [F.count_if(F.abs(decoded) >= 32767).alias("clipped"), F.max(F.abs(decoded - original)).cast("long").alias("max_diff"), F.bool_and(decoded == original).alias("bit_exact")]


def worst_window(samples: DataFrame, group: str, index: str, signal: str, decoded: str, window: int, at_most: float = 120.0) -> DataFrame:
    """Per group: the window of `window` samples, at every quarter of it, with the lowest SNR, its start and that SNR in dB.

    Quarters are summed first, so a row of the window function is a quarter. window must be a multiple of 4. Groups shorter
    than a window have one window, all of them.
    """
    s, e = F.col(signal).cast("double"), F.col(signal).cast("double") - F.col(decoded)
    q = samples.groupBy(group, F.floor(F.col(index) / (window // 4)).cast("long").alias("_q")).agg(F.sum(s * s).alias("_s"), F.sum(e * e).alias("_e"), F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_q")
    four, whole = w.rowsBetween(0, 3), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    q = q.select(group, "_q", *[F.sum(c).over(four).alias(c) for c in ("_s", "_e", "_n")], F.sum("_n").over(whole).alias("_all"), *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("_s", "_e")])
    short = F.col("_all") < window
    q = q.where(F.col("_n") == window).unionByName(q.where(short & (F.col("_q") == 0)).withColumn("_s", F.col("_s_all")).withColumn("_e", F.col("_e_all")))
    snr = F.when(F.col("_e") <= 0, at_most).otherwise(F.least(F.lit(at_most), 10 * F.log10(F.greatest(F.col("_s"), F.lit(1e-20)) / F.col("_e"))))
    return q.withColumn("snr", snr).groupBy(group).agg(F.min("snr").alias("worst_snr"), (F.min_by("_q", F.struct("snr", "_q")) * (window // 4)).alias("start"))


# Fixed values of the format: bytes of a file and of a chunk, chunks of a file.
MOST_FILE, MOST_CHUNK, MOST_CHUNKS = 2 * 1024 * MB, 64 * MB, 256


def limits(chunks: DataFrame, path: str, fourcc: str, size: str, file_size: str) -> DataFrame:
    """Per file of chunk rows: problems, in the order in which a reader meets them; empty for a file within all limits.

    A file, a chunk or their number too large; no header, no audio.
    """
    g = chunks.groupBy(path).agg(F.max(file_size).alias("f"), F.max(size).alias("c"), F.count(fourcc).alias("n"), F.count_if(F.col(fourcc) == "HEAD").alias("h"), F.count_if(F.col(fourcc) == "AUDI").alias("a"))
    cases = [("file-size", F.col("f") > MOST_FILE), ("chunk-size", F.col("c") > MOST_CHUNK), ("chunk-count", F.col("n") > MOST_CHUNKS), ("no-head", F.col("h") == 0), ("no-audio", F.col("a") == 0)]
    return g.select(path, F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in cases])).alias("problems"))


def known_optional(present: Column, known: Sequence[str]) -> tuple[Column, Column]:
    """Which of an array of chunk names a reader knows, and which not, each sorted."""
    names = F.array(*map(F.lit, known))
    return F.array_sort(F.array_intersect(present, names)), F.array_sort(F.array_except(present, names))
