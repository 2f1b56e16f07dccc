"""What a person or a source file says about a track: tags, the form's timed texts as overrides, and the summary of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import codec_label
from tessera.operators import timeline
from tessera.operators.summary import CODEC_NAMES

# Fixed values of the format: which of a source's tags, in this order, a field is taken from.
TAGS = {
    "title": ("title", "track"), "artist": ("artist", "album_artist"), "album": ("album",), "albumartist": ("album_artist", "albumartist"), "genre": ("genre",), "date": ("date", "year"), "tracknumber": ("track", "tracknumber"),
    "discnumber": ("disc", "discnumber"), "composer": ("composer",), "comment": ("comment", "description"), "lyrics": ("lyrics", "lyric", "unsyncedlyrics"),
}


def source_tags(df: DataFrame, text: str) -> DataFrame:
    """df with a column per field of TAGS, and year, from lines `key=value` of text; null where no tag has it.

    Keys are lower-cased; of lines with one key the last counts; lines that begin with ; or #, or have no key or no value, are passed over.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    pairs = F.transform(F.filter(lines, lambda x: ~x.rlike("^[;#]") & (F.instr(x, "=") > 1)), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^=]*=([\s\S]*)$", 1)).alias("v")))
    said = df.withColumn("_tags", F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "")))
    one = lambda k: F.try_element_at(F.filter("_tags", lambda p: p["k"] == k), F.lit(-1))["v"]
    found = {name: F.coalesce(*map(one, keys)) for name, keys in TAGS.items()}
    return said.select(*df.columns, *[c.alias(n) for n, c in found.items()], F.coalesce(one("year"), F.substring(found["date"], 1, 4)).alias("year"))


def _timed(df: DataFrame, key: str, text: str, rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """key, `name` and `name`_action: remove (no text), set (every line is good), or keep (a line isn't, so the whole text counts for nothing)."""
    good = rows.groupBy(key).agg(F.count("error").alias("_bad"), F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct(*fields)))).alias("_rows"))  # lines of one text
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    said = df.select(key, blank.alias("_blank")).join(good, key, "left")
    valid = (F.coalesce("_bad", F.lit(0)) == 0) & (F.size("_rows") > 0)
    action = F.when(F.col("_blank"), "remove").when(valid, "set").otherwise("keep")
    return said.select(key, F.when(~F.col("_blank") & valid, F.col("_rows")).alias(name), action.alias(f"{name}_action"))


def timed_overrides(df: DataFrame, key: str, unsynced: str, synced: str, sections: str, highlights: str) -> DataFrame:
    """What a form's timed texts change, per row of df (key is unique): sections, highlights and lyrics (unsynced, synced), each with its action, and the hook's start.

    One line that can't be read discards its whole text: sections and highlights are then kept as they were; lyrics are set without their timed lines, if there are
    others, and else removed. Sections that are set bring the hook with them.
    """
    sect_rows = timeline.parse_sections(df, key, sections)
    sect = _timed(df, key, sections, sect_rows, ["start_ms", "end_ms", "type", "title"], "sections")
    hilt = _timed(df, key, highlights, timeline.parse_highlights(df, key, highlights), ["n", "start_ms", "end_ms", "use_case", "label"], "highlights")
    lines = _timed(df, key, synced, timeline.parse_lyrics(df, key, synced), ["time_ms", "section", "text"], "synced")
    hook = timeline.hooks(sect_rows.where("error IS NULL"), key).withColumnRenamed("start_ms", "_hook")
    plain = df.select(key, F.nullif(F.trim(unsynced), F.lit("")).alias("unsynced"))
    out = plain.join(lines, key).join(sect, key).join(hilt, key).join(hook, key, "left")
    some = F.col("unsynced").isNotNull() | F.col("synced").isNotNull()
    return out.select(key, "unsynced", "synced", F.when(some, "set").otherwise("remove").alias("lyrics_action"), "sections", "sections_action", F.when(F.col("sections_action") == "set", F.col("_hook")).alias("hook_ms"), "highlights", "highlights_action")


def export_summary(files: DataFrame) -> DataFrame:
    """Per exported file: codec_label, vs_pcm_percent, has_tags, has_cover, has_lyrics, has_guidance, stem_count, besides path and sizes.

    files: path, output_bytes, source_bytes, codec_id, total_samples, channels, bits, meta, cover_bytes, unsynced, optional (names), stem_count.
    """
    pcm = F.col("total_samples") * F.col("channels") * F.col("bits") / 8
    has = lambda k: F.coalesce(F.array_contains("optional", k), F.lit(False))
    name = F.get(F.array(*map(F.lit, CODEC_NAMES)), F.coalesce("codec_id", F.lit(0)))
    filled: Column = F.coalesce(F.exists("meta", lambda m: F.coalesce(F.trim(m["value"]) != "", F.lit(False))), F.lit(False))
    return files.select(
        "path", "output_bytes", "source_bytes", codec_label(F.coalesce(name, F.col("codec_id").cast("string"))).alias("codec_label"), F.when((F.col("output_bytes") > 0) & (pcm > 0), F.col("output_bytes") / pcm * 100).alias("vs_pcm_percent"), filled.alias("has_tags"),
        (F.coalesce("cover_bytes", F.lit(0)) > 0).alias("has_cover"), (has("LYRC") | (F.coalesce("unsynced", F.lit("")) != "")).alias("has_lyrics"), (has("EXPL") | has("SAFE") | has("SENS") | has("RECV")).alias("has_guidance"), F.coalesce("stem_count", F.lit(0)).alias("stem_count"),
    )
