"""Lyrics and section text to rows and errors, what is current at a time, and steps between sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import timecode, timecode_ms
from tessera.functions.records import SECTION_TYPES

TIME, LONG_TIME, TAG = r"^\d{1,2}:\d{2}(\.\d{1,3})?$", r"^\d{1,12}:\d{2}(\.\d{1,3})?$", r"^[A-Za-z][A-Za-z0-9 _-]{0,31}$"
# Section names of lyrics that have a spelling of their own.
LYRIC_SECTIONS = {"intro": "Intro", "verse": "Verse", "chorus": "Chorus", "bridge": "Bridge", "outro": "Outro", "pre-chorus": "Pre-Chorus", "prechorus": "Pre-Chorus", "hook": "Hook"}


def bracketed(line: Column) -> tuple[Column, Column, Column]:
    """Of "[stamp|tag] rest": the stamp (null where the line has no bracket), the tag (null without one) and the rest."""
    end = F.instr(line, "]")
    inside = F.when(line.startswith("[") & (end > 0), F.substring(line, F.lit(2), end - 2))
    parts = F.split(inside, r"\|", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.trim(F.substring(line, end + 1, F.length(line)))


def lyric_section(tag: Column) -> Column:
    """The spelling of a known section, else the tag, cut to 48 characters; null if blank."""
    t = F.trim(tag)
    known = F.create_map(*[F.lit(x) for kv in LYRIC_SECTIONS.items() for x in kv])
    return F.nullif(F.coalesce(F.element_at(known, F.lower(t)), F.substring(t, 1, 48)), F.lit(""))


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line that is neither blank nor a comment: key, n (from 1), line."""
    rows = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    return rows.select(key, (F.col("n") + 1).alias("n"), F.trim("line").alias("line")).where("line <> '' AND NOT startswith(line, '#')")


def _error(*cases: tuple[Column, str]) -> Column:
    """The first case that holds, with the line's number."""
    out = F.lit(None).cast("string")
    for test, what in reversed(cases):
        out = F.when(test, F.concat(F.lit("Line "), F.col("n"), F.lit(f": {what}"))).otherwise(out)
    return out


def parse_lyrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, time_ms, section, text, error of lines "[mm:ss.f|section] text"; a section alone is its own text.

    A line of another form, with a second over 59, or with neither has an error instead.
    """
    stamp, tag, rest = bracketed(F.col("line"))
    ms, section = timecode_ms(stamp), lyric_section(tag)
    formed = F.coalesce(stamp.rlike(TIME) & (tag.isNull() | tag.rlike(TAG)), F.lit(False))
    error = _error((~formed, "not a timed line"), (ms.isNull(), "no such time"), ((rest == "") & section.isNull(), "nothing to sing"))
    rows = text_lines(df, key, text).withColumn("error", error)
    ok = F.col("error").isNull()
    return rows.select(key, "n", F.when(ok, ms).alias("time_ms"), F.when(ok, section).alias("section"), F.when(ok, F.coalesce(F.nullif(rest, F.lit("")), section)).alias("text"), "error")


def format_lyrics(rows: DataFrame, key: str) -> DataFrame:
    """key, lyrics: the text of rows (n, time_ms, section, text) in the order of time, as parse_lyrics reads it."""
    line = F.rtrim(F.concat(F.lit("["), timecode(F.col("time_ms")), F.coalesce(F.concat(F.lit("|"), F.col("section")), F.lit("")), F.lit("] "), F.col("text")))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("time_ms", "n", line.alias("line")))).alias("l"))
    return g.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lyrics"))


def _spans(df: DataFrame, key: str, text: str, long: bool = False) -> DataFrame:
    """key, n, start_ms, end_ms, tag, rest, error of lines "[start-end|tag] rest"; the end may be left out.

    The format's reader takes minutes of two digits, though its writer puts out more of them; long: they are taken too.
    """
    stamp, tag, rest = bracketed(F.col("line"))
    form, digits = (LONG_TIME, 12) if long else (TIME, 3)
    rows = text_lines(df, key, text).withColumns({"_times": F.split(stamp, "-", 2), "_tag": tag, "_rest": rest})
    first, last = F.get("_times", F.lit(0)), F.get("_times", F.lit(1))
    rows = rows.withColumns({"_start": timecode_ms(first, digits), "_end": timecode_ms(last, digits)})  # each is used more than once
    start, end = F.col("_start"), F.col("_end")
    formed = F.coalesce(first.rlike(form) & (last.isNull() | last.rlike(form)), F.lit(False))
    error = _error((~formed, "not a range of times"), (start.isNull() | (last.isNotNull() & end.isNull()), "no such time"), (end <= start, "ends before it begins"))
    rows = rows.withColumn("error", error)
    ok = F.col("error").isNull()
    return rows.select(key, "n", *[F.when(ok, c).alias(x) for c, x in ((start, "start_ms"), (end, "end_ms"), (F.nullif(F.trim("_tag"), F.lit("")), "tag"), (F.nullif(F.col("_rest"), F.lit("")), "rest"))], "error")


def parse_sections(df: DataFrame, key: str, text: str, long: bool = False) -> DataFrame:
    """key, n, start_ms, end_ms, type, title, error, of lines "[start-end|type] title"; long: of 100 minutes and more too."""
    kind = F.lower("tag")
    kind = F.when(F.col("error").isNull(), F.when(kind.isin(*SECTION_TYPES), kind).otherwise("custom"))
    return _spans(df, key, text, long).select(key, "n", "start_ms", "end_ms", kind.alias("type"), F.col("rest").alias("title"), "error")


def parse_highlights(df: DataFrame, key: str, text: str, long: bool = False) -> DataFrame:
    """key, n, start_ms, end_ms, use_case, label, error, of lines "[start-end|use] label"; long: of 100 minutes and more too."""
    return _spans(df, key, text, long).select(key, "n", "start_ms", "end_ms", F.lower("tag").alias("use_case"), F.col("rest").alias("label"), "error")


def format_sections(rows: DataFrame, key: str) -> DataFrame:
    """key, sections: the text of rows (n, start_ms, end_ms, type, title) in the order of their starts, as parse_sections reads it."""
    span = F.concat(F.lit("["), timecode(F.col("start_ms")), F.coalesce(F.concat(F.lit("-"), timecode(F.col("end_ms"))), F.lit("")), F.lit("|"), F.col("type"), F.lit("] "))
    line = F.rtrim(F.concat(span, F.coalesce("title", F.lit(""))))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_ms", "n", line.alias("line")))).alias("l"))
    return g.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("sections"))


def steps(sections: DataFrame, key: str) -> DataFrame:
    """Each section with the starts of the one before and after, held at the ends."""
    w = Window.partitionBy(key).orderBy("start_ms")
    return sections.withColumn("prev_ms", F.coalesce(F.lag("start_ms").over(w), F.col("start_ms"))).withColumn("next_ms", F.coalesce(F.lead("start_ms").over(w), F.col("start_ms")))


def hooks(sections: DataFrame, key: str) -> DataFrame:
    """The first section of type hook, else chorus, else any but the intro: key, start_ms."""
    rank = F.when(F.col("type") == "hook", 0).when(F.col("type") == "chorus", 1).when(F.col("type") != "intro", 2)
    return sections.withColumn("_r", rank).where("_r IS NOT NULL").groupBy(key).agg(F.min_by("start_ms", F.struct("_r", "start_ms")).alias("start_ms"))
