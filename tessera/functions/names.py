"""File names, labels, keys, credits, ranges and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import contrast, hex_color, sanitize

# Fixed values of the format: spellings of metadata keys, and what each stands for.
META_KEYS = {
    "title": "title", "artist": "artist", "album": "album", "album_artist": "albumartist", "albumartist": "albumartist", "genre": "genre", "date": "date", "year": "year",
    "track": "tracknumber", "tracknumber": "tracknumber", "disc": "discnumber", "discnumber": "discnumber", "composer": "composer", "comment": "comment", "description": "comment", "lyrics": "comment",
}
# Fixed values of the format: chunks whose hashes may be listed.
HASHED_CHUNKS = "HEAD META AUDI COVR LYRC SEEK WAVE INFO CORR STEM STDA STDF SECT HOOK HILT VISU CRDT LICN IDEN EXPL SAFE SENS RECV MOOD VIBE FING".split()
# What a file name says about a stem; the first pattern that is found decides.
STEM_TYPES = [
    (r"\b(lead[\s_-]?vox|lead[\s_-]?vocal|lead vocal)\b", "lead_vocals"),
    (r"\b(bg[\s_-]?vox|bg[\s_-]?vocal|background[\s_-]?vocal|harmony|harmonies|backing[\s_-]?vocal|bgv)\b", "background_vocals"),
    (r"\b(808|sub[\s_-]?bass)\b", "bass"),
    (r"\bsub\b", "bass"),
    (r"\bbass\b", "bass"),
    (r"\bkick\b", "percussion"),
    (r"\b(snare|clap|snares?[\s_-]?(and|&|n)[\s_-]?claps?)\b", "percussion"),
    (r"\b(hat|hats|hi[\s_-]?hat|hihat)\b", "percussion"),
    (r"\bdrums?\b", "drums"),
    (r"\b(synths?|keys|keyboard)\b", "synths"),
    (r"\bguitar\b", "guitar"),
    (r"\bpiano\b", "piano"),
    (r"\b(fx|effects|vocal[\s_-]?fx)\b", "effects"),
    (r"\bvox\b", "lead_vocals"),
    (r"\bvocal\b", "lead_vocals"),
    (r"\binstrumental\b", "instrumental"),
    (r"\b(acapella|a[\s_-]?cappella)\b", "acapella"),
    (r"\bstrings?\b", "strings"),
]
# Codec names by id, preset names by number.
CODECS = {"mp5c": "MP5-C (experimental / lab)", "mp5l": "MP5-L v3 (lossless · default)", "mp5h": "MP5-H (hybrid · not default)", "pcm": "PCM (reference / debug)", "passthrough": "Passthrough"}
PRESETS = ["Low", "Standard", "High", "Extreme"]
#: Bytes a second of 44.1 kHz stereo in 16 bits; what a track may last at most.
SOURCE_RATE, LONGEST_MS = 176_400, 24 * 3600 * 1000


def _cases(column: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column), default)


def stem_of(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]+$", "")


def meta_key(c: Column) -> Column:
    """The standard spelling of a metadata key; an unknown key is cleaned and lower-cased."""
    return _cases(F.lower(F.regexp_replace(c, r"\s+", "")), META_KEYS, F.lower(F.trim(sanitize(c))))


def fourcc(c: Column) -> Column:
    """Four letters or digits, upper-cased, if chunks of that name may be listed with a hash; else null."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^[A-Z0-9]{4}$") & t.isin(*HASHED_CHUNKS), t)


def barcode(c: Column, most: int = 14) -> Column:
    """The digits, if there are 8 to `most` of them."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits).between(8, most), digits)


def identifier(c: Column, most: int = 128) -> Column:
    """Cleaned and cut; null if blank or with markup."""
    t = F.trim(sanitize(c, most))
    return F.when((t != "") & ~t.rlike("[<>&]"), t)


def people(names: Column, most: int = 32, longest: int = 128) -> Column:
    """The first names of an array, cleaned, without blanks and names with markup."""
    return F.filter(F.transform(F.slice(names, 1, most), lambda x: F.trim(sanitize(x, longest))), lambda x: (x != "") & ~x.rlike("[<>&]"))


def lines(c: Column, most: int = 32) -> Column:
    """The lines of a text, trimmed, without blanks."""
    return F.slice(F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def performers(c: Column) -> Column:
    """Lines "name | instrument" as structs; lines without a name are left out."""

    def one(x: Column) -> Column:
        parts = F.split(x, r"\|", 2)
        return F.struct(F.trim(F.get(parts, F.lit(0))).alias("name"), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("instrument"))

    return F.filter(F.transform(lines(c), one), lambda x: x["name"] != "")


def format_performers(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(" | ", x["name"], x["instrument"])), "\n")


def credits(c: Column) -> Column:
    """Lines "role: name, name; name" as structs (role, names); lines without a role or names are left out."""

    def one(x: Column) -> Column:
        parts = F.split(x, ":", 2)
        names = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "[,;]+"), lambda n: F.trim(n)), lambda n: n != "")
        return F.struct(F.trim(F.get(parts, F.lit(0))).alias("role"), F.slice(names, 1, 32).alias("names"))

    return F.filter(F.transform(lines(c, 48), one), lambda x: (x["role"] != "") & (F.size(x["names"]) > 0))


def format_credits(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x["role"], F.lit(": "), F.array_join(x["names"], ", "))), "\n")


# ---------------------------------------------------------------- file names


def file_part(c: Column, most: int = 120) -> Column:
    """With an underscore for each character that a file name can't hold, blanks merged."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"\s+", " ")), 1, most)


def export_name(artist: Column, title: Column, source: Column, variant: str = "") -> Column:
    """ "artist - title", or what there is of both, or the source's name, or "track"; with the variant in brackets."""
    some = [F.nullif(F.trim(c), F.lit("")) for c in (artist, title)]
    base = F.coalesce(F.nullif(F.concat_ws(" - ", *some), F.lit("")), F.nullif(stem_of(source), F.lit("")), F.lit("track"))
    return F.concat(F.coalesce(F.nullif(file_part(base), F.lit("")), F.lit("track")), F.lit(f" ({variant}).mp5" if variant else ".mp5"))


def extract_name(number: Column, title: Column) -> Column:
    """ "NN - title.mp5"."""
    safe = F.substring(F.trim(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1F]', "")), 1, 80)
    digits = F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
    base = F.concat(digits, F.lit(" - "), F.coalesce(F.nullif(safe, F.lit("")), F.lit("Track")))
    return F.when(F.lower(base).endswith(".mp5"), base).otherwise(F.concat(base, F.lit(".mp5")))


def _numbered(name: Column) -> tuple[Column, Column]:
    """The digits that a trimmed name begins with, after the word track if it is there, and what follows them; both null unless there are one or two digits, a gap and more."""
    bare = F.when(name.rlike(r"^(?i)track\s*\d"), F.ltrim(F.regexp_replace(F.substring(name, 6, 10_000), r"^\s+", ""))).otherwise(name)
    digits = F.regexp_extract(bare, r"^\d+", 0)
    after = bare.substr(F.length(digits) + 1, F.length(bare))
    found = F.length(digits).between(1, 2) & after.rlike(r"^[\s._-]") & (F.length(after) > 1)
    gapless = F.regexp_replace(F.regexp_replace(after, r"^\s+", ""), r"^[._-]\s*", "")
    rest = F.when(gapless == "", F.substring(after, 2, 10_000)).otherwise(gapless)
    return F.when(found, digits.cast("int")), F.when(found, F.trim(rest))


def number_in_name(name: Column) -> Column:
    """1 to 99 where a file name begins with a track number, else null."""
    n = _numbered(F.trim(stem_of(name)))[0]
    return F.when(n.between(1, 99), n)


def title_in_name(name: Column) -> Column:
    """What follows the track number of a file name, or the whole name, or "Untitled"."""
    base = F.trim(stem_of(name))
    return F.coalesce(F.nullif(_numbered(base)[1], F.lit("")), F.nullif(base, F.lit("")), F.lit("Untitled"))


def album_of_path(path: Column) -> Column:
    """The first folder of a relative path; null without one or where it is hidden."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda x: x != "")
    first = F.trim(F.get(parts, F.lit(0)))
    return F.when((F.size(parts) >= 2) & (first != "") & ~first.startswith("."), first)


def stem_type(name: Column) -> Column:
    """The stem type that a file name tells; custom if none."""
    n = F.regexp_replace(F.lower(stem_of(name)), "[._-]+", " ")
    out = None
    for pattern, kind in STEM_TYPES:
        out = F.when(n.rlike(pattern), kind) if out is None else out.when(n.rlike(pattern), kind)
    return out.otherwise("custom")


# ---------------------------------------------------------------- labels


def title_case(c: Column) -> Column:
    """lead_vocals as Lead Vocals."""
    return F.array_join(F.transform(F.split(c, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


def section_label(c: Column) -> Column:
    """pre_chorus as Pre-chorus."""
    t = F.replace(c, F.lit("_"), F.lit("-"))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1000))


def codec_label(c: Column) -> Column:
    return _cases(c, CODECS, F.concat(F.lit("Unknown codec ("), c, F.lit(")")))


def codec_class(label: Column) -> Column:
    """Which codec a label names: mp5l, mp5c, mp5h, pcm or other."""
    t = F.lower(label)
    return F.when(t.contains("mp5-l"), "mp5l").when(t.contains("mp5-c"), "mp5c").when(t.contains("mp5-h"), "mp5h").when(t.contains("pcm"), "pcm").otherwise("other")


def preset_label(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, PRESETS)), number.cast("int")), F.concat(F.lit("Preset "), number.cast("string")))


def version_label(version: Column) -> Column:
    return F.when(version.isNull(), "unknown").when(version == 2, "v2 (legacy raw PCM blocks)").when(version == 3, "v3 (LPC + delta + varint)").otherwise(F.concat(F.lit("v"), version.cast("string")))


def byte_size(n: Column, units: tuple[str, str] = ("KB", "MB"), places: int = 2) -> Column:
    """As "12 B", "1.5 KB", "2.25 MB": places are those of the largest unit; null or negative as a dash."""
    small, large = (F.format_string(f"%.{p}f {u}", n / d) for u, d, p in ((units[0], 1024.0, 1), (units[1], 1048576.0, places)))
    return F.when(n.isNull() | (n < 0), "—").when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1048576, small).otherwise(large)


def readable_text(background: Column, preferred: Column, least: float = 4.5) -> Column:
    """The preferred colour if its contrast reaches `least`, else the dark or the light one that stands out more."""
    dark, light = F.lit("#111827"), F.lit("#f3f4f6")
    good = hex_color(preferred)
    return F.when(contrast(good, background) >= least, good).when(contrast(light, background) >= contrast(dark, background), light).otherwise(dark)


def with_alpha(color: Column, alpha: Column) -> Column:
    """#rrggbbaa; what is no colour stays as it is."""
    a = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)) * 255 + 0.5).cast("int")
    return F.coalesce(F.concat(hex_color(color), F.lpad(F.lower(F.hex(a)), 2, "0")), color)


# ---------------------------------------------------------------- ranges and durations


def range_seconds(start_ms: Column, end_ms: Column) -> Column:
    """struct(start, end) in seconds; end is null for an open range; null if it begins before 0 or ends where it begins or before."""
    good = (start_ms >= 0) & (end_ms.isNull() | (end_ms > start_ms))
    return F.when(good, F.struct((start_ms / 1000.0).alias("start"), (end_ms / 1000.0).alias("end")))


def highlight_range(start_ms: Column, end_ms: Column, label: Column, use: Column, index: Column, kind: str = "play") -> Column:
    """What plays a highlight: struct(id, start, end, mode, label); null for an open or broken range."""
    r = range_seconds(start_ms, end_ms)
    name = F.coalesce(label, F.replace(F.nullif(use, F.lit("")), F.lit("_"), F.lit(" ")), F.lit("highlight"))
    return F.when(r["end"].isNotNull(), F.struct(F.concat(F.lit(f"hilt-{kind}-"), index.cast("string")).alias("id"), r["start"].alias("start"), r["end"].alias("end"), F.lit("preview").alias("mode"), name.alias("label")))


def trusted_ms(manifest: Column, head: Column, longest: int = LONGEST_MS) -> Column:
    """The manifest's duration if it lies within a tenth of the header's, else the header's; values out of reason count as null."""
    m, h = (F.when(c.between(1, longest), c) for c in (manifest, head))
    return F.when(h.isNull(), m).when(m.isNull() | (m / h < 0.9) | (m / h > 1.1), h).otherwise(m)


def source_seconds(size: Column) -> Column:
    """How long a source file of this many bytes may last."""
    return F.when(size > 0, size / SOURCE_RATE).otherwise(F.lit(0.0))
