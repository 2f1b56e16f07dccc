"""Text, name, colour, time and size functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.urls import href


def sanitize(c: Column, most: int = 8192) -> Column:
    """Without control characters (tab and line breaks stay), cut to `most` characters."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, most)


def web_url(c: Column, most: int = 2048) -> Column:
    """The URL in the standard's form if it is http or https without credentials, else null."""
    return href(sanitize(c, most), most)


def hash_or_null(c: Column) -> Column:
    """64 hex digits, lower-cased, else null."""
    return F.when(F.trim(c).rlike("^[A-Fa-f0-9]{64}$"), F.lower(F.trim(c)))


def same_hash(a: Column, b: Column) -> Column:
    """Null where either is null."""
    return F.lower(a) == F.lower(b)


def preview(c: Column) -> Column:
    """The first 12 characters and an ellipsis; null under 8."""
    return F.when(F.length(c) >= 8, F.concat(F.substring(c, 1, 12), F.lit("…")))


def mime(c: Column) -> Column:
    """The image type of a binary column by its first bytes."""
    h = F.hex(F.substring(c, 1, 12))
    return F.when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("89504E47"), "image/png").when(h.startswith("47494638"), "image/gif").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")


def hex_color(c: Column) -> Column:
    """#rgb, #rgba, #rrggbb or #rrggbbaa as #rrggbb, lower-cased; else null."""
    t = F.lower(F.trim(c))
    short = F.concat(F.lit("#"), *[F.repeat(F.substring(t, k, 1), 2) for k in (2, 3, 4)])
    return F.when(t.rlike("^#[0-9a-f]{3,4}$"), short).when(t.rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), F.substring(t, 1, 7))


def luminance(color: Column) -> Column:
    """Relative luminance of #rrggbb."""

    def part(at: int) -> Column:
        v = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def timecode_ms(c: Column, digits: int = 3) -> Column:
    """Milliseconds of mm:ss or mm:ss.f to mm:ss.fff, with so many digits of minutes at most, in brackets or not; null for anything else."""
    p = rf"^\s*\[?(\d{{1,{digits}}}):([0-5]?\d)(?:\.(\d{{1,3}}))?\]?\s*$"
    n = [F.regexp_extract(c, p, k) for k in (1, 2, 3)]
    return F.when(c.rlike(p), n[0].cast("long") * 60000 + n[1].cast("long") * 1000 + F.rpad(n[2], 3, "0").cast("long"))


def timecode(ms: Column) -> Column:
    """mm:ss.cc; the hundredths are rounded and may read 100."""
    m = F.greatest(ms, F.lit(0)).cast("long")
    return F.format_string("%02d:%02d.%02d", F.floor(m / 60000).cast("long"), F.floor(m / 1000).cast("long") % 60, F.floor((m % 1000) / 10 + 0.5).cast("long"))


def clock(seconds: Column) -> Column:
    """m:ss."""
    s = F.floor(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0))).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)


def byte_size(n: Column) -> Column:
    """B, KB or MB by 1024."""
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, r"[/\\]"), -1)


def unsafe_path(c: Column) -> Column:
    """Absolute, or with a step to the parent."""
    return c.rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")


def track_number(c: Column) -> Column:
    """The number that leads a file name ("01 - Name", "track 7"), or null."""
    name = basename(c)
    n = F.coalesce(F.nullif(F.regexp_extract(name, r"^\s*(\d{1,3})(?=[\s._-])", 1), F.lit("")), F.nullif(F.regexp_extract(F.lower(name), r"track\s*(\d{1,3})", 1), F.lit("")))
    return n.cast("int")


def tag_list(c: Column, most: int = 32) -> Column:
    """Split at commas and semicolons, trimmed, without blanks."""
    return F.slice(F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def isrc(c: Column) -> Column:
    t = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    return F.when(t.rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"), t)
