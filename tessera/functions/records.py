"""JSON records of the optional chunks as normalised structs, null where they are no object.

A record is parsed once, to a VARIANT, and its fields are taken from that by name and type: a number is no text and "true" is no flag. Functions take the JSON
text, or a Record that has been parsed; `read_all` parses each record of a row in one projection and reads it in the next, so no text is parsed twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import barcode, fourcc, identifier, people
from tessera.functions.text import hash_or_null, hex_color, isrc, sanitize, web_url

#: Fixed value of the format: bytes of a record.
MOST = 64 * 1024


@dataclass(frozen=True)
class Record:
    """A parsed record: its VARIANT (null where the text is no object) and the text."""

    value: Column
    text: Column


def parse(j: Column) -> Column:
    """The VARIANT of a JSON object of at most MOST bytes; null for everything else."""
    return F.when((F.octet_length(j) <= MOST) & F.ltrim(j).startswith("{"), F.try_parse_json(j))


def record(j: Column | Record) -> Record:
    return j if isinstance(j, Record) else Record(parse(j), j)


def is_object(j: Column | Record) -> Column:
    return record(j).value.isNotNull()


def _text(c: Column, most: int) -> Column:
    """Cleaned and trimmed; null where nothing is left."""
    t = F.trim(sanitize(c, most))
    return F.when(t != "", t)


def _kind(v: Column, name: str) -> Column:
    """The type of a field: STRING, BOOLEAN, BIGINT, ... (of one leaf: this doesn't look into the others)."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def string(v: Column, name: str) -> Column:
    return F.when(_kind(v, name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def number(v: Column, name: str) -> Column:
    return F.when(_kind(v, name).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{name}", "double"))


def listed(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def strings(v: Column, name: str, most: int, length: int) -> Column:
    """The texts of an array, the first `most`, cleaned, blanks dropped; null where it is no array."""
    texts = F.filter(listed(v, name), lambda x: F.schema_of_variant(x) == "STRING")
    return F.filter(F.transform(F.slice(texts, 1, most), lambda x: _text(x.cast("string"), length)), lambda x: x.isNotNull())


def flag(j: Column | Record, name: str) -> Column:
    """True only for the JSON value true; the string "true" is not."""
    v = record(j).value
    return F.coalesce(F.when(_kind(v, name) == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean")), F.lit(False))


def tags(j: Column | Record, name: str = "tags", most: int = 32, length: int = 128) -> Column:
    return strings(record(j).value, name, most, length)


def _unit(v: Column, name: str) -> Column:
    """A number held in 0 to 1."""
    n = number(v, name)
    return F.when(n.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), n)))


def _ms(n: Column) -> Column:
    return F.when(n >= 0, F.floor(n).cast("long"))


def mood(j: Column | Record) -> Column:
    """Null without tags."""
    v = record(j).value
    t = tags(j)
    return F.when(F.size(t) > 0, F.struct(t.alias("tags"), number(v, "intensity").alias("intensity"), number(v, "energy").alias("energy"), _text(string(v, "source"), 64).alias("source")))


def vibe(j: Column | Record) -> Column:
    """Null without tags."""
    t = tags(j)
    return F.when(F.size(t) > 0, F.struct(t.alias("tags"), _text(string(record(j).value, "source"), 64).alias("source")))


# Fixed values of the format: who may have given a warning; the flags of each guidance record, and the name of its list.
SOURCES = ("artist", "user", "ai", "unknown")
GUIDANCE = {
    "EXPL": (("explicit", "cleanVersionAvailable", "strongLanguage", "sexualContent", "violence", "drugReferences", "alcoholReferences", "selfHarmThemes", "traumaThemes", "matureThemes", "aiGenerated"), "contentWarnings"),
    "SAFE": (("griefThemes", "traumaThemes", "panicHeavy", "distressingThemes", "aiGenerated"), "tags"),
    "RECV": (("recoverySafe", "groundingFriendly", "panicFriendly", "drugReferences", "alcoholReferences", "relapseThemes", "cravingTriggers", "aiGenerated"), "triggers"),
    "SENS": (("suddenLoudSounds", "intenseBass", "harshFrequencies", "sensoryOverloadRisk", "aiGenerated"), "warnings"),
}


def guidance(j: Column | Record, *flags: str, list_name: str = "warnings") -> Column:
    """Flags (strictly true), a list of texts, who said so, and how sure that is (0 to 1)."""
    r = record(j)
    source = string(r.value, "warningSource")
    some = F.coalesce(tags(r, list_name), F.array().cast("array<string>"))
    return F.when(is_object(r), F.struct(*[flag(r, f).alias(f) for f in flags], some.alias(list_name), F.when(source.isin(*SOURCES), source).otherwise("unknown").alias("warningSource"), _unit(r.value, "confidence").alias("confidence")))


def lyrics(j: Column | Record) -> Column:
    """Lines in order of time; a line has timeMs, or time in seconds. Text that is no JSON object is unsynced, with source legacy. Null without any text."""
    r = record(j)
    made = F.transform(F.slice(listed(r.value, "synced"), 1, 2000), lambda x: F.struct(F.floor(F.coalesce(number(x, "timeMs"), number(x, "time") * 1000)).cast("long").alias("timeMs"), _text(string(x, "text"), 512).alias("text"), _text(string(x, "section"), 48).alias("section")))
    lines = F.array_sort(F.filter(made, lambda x: (x["timeMs"] >= 0) & x["text"].isNotNull()))
    unsynced = _text(string(r.value, "unsynced"), 8192)
    legacy = _text(r.text, 8192)
    return F.when(is_object(r), F.when(unsynced.isNotNull() | (F.size(lines) > 0), F.struct(unsynced.alias("unsynced"), lines.alias("synced"), F.coalesce(_text(string(r.value, "source"), 64), F.lit("unknown")).alias("source")))).when(
        legacy.isNotNull(), F.struct(legacy.alias("unsynced"), F.array().cast("array<struct<timeMs:bigint,text:string,section:string>>").alias("synced"), F.lit("legacy").alias("source"))
    )


SECTION_TYPES = ("intro", "verse", "chorus", "bridge", "hook", "outro", "custom")


def sections(j: Column | Record, most: int = 256) -> Column:
    """Sections in order of start; startMs may be called start; an unknown type is custom; confidence lies in 0 to 1. Null without any."""
    raw = F.slice(listed(record(j).value, "sections"), 1, most)
    made = F.transform(
        raw,
        lambda x, i: F.struct(
            F.floor(F.coalesce(number(x, "startMs"), number(x, "start"))).cast("long").alias("startMs"),
            F.floor(F.coalesce(number(x, "endMs"), number(x, "end"))).cast("long").alias("endMs"),
            F.coalesce(_text(string(x, "sectionId"), 64), F.concat(F.lit("sect-"), i + 1)).alias("sectionId"),
            F.when(F.lower(string(x, "type")).isin(*SECTION_TYPES), F.lower(string(x, "type"))).otherwise("custom").alias("type"),
            _text(string(x, "title"), 128).alias("title"),
            _unit(x, "confidence").alias("confidence"),
        ),
    )
    good = F.array_sort(F.filter(made, lambda x: x["startMs"] >= 0))
    return F.when(F.size(good) > 0, good)


def hook(j: Column | Record) -> Column:
    """Null without a start."""
    v = record(j).value
    start = _ms(number(v, "startMs"))
    return F.when(start.isNotNull(), F.struct(_text(string(v, "sectionId"), 64).alias("sectionId"), start.alias("startMs"), _ms(number(v, "endMs")).alias("endMs"), _text(string(v, "label"), 128).alias("label")))


def theme(j: Column | Record, *names: str) -> Column:
    """Colours as #rrggbb; null where none is one."""
    colors = [hex_color(string(record(j).value, n)) for n in names]
    return F.when(F.coalesce(*colors).isNotNull(), F.struct(*[c.alias(n) for c, n in zip(colors, names, strict=True)]))


# Fixed values of the format: what a fingerprint may be of, and who may have made it.
FINGERPRINTS, MAKERS = ("sha256-pcm", "sha256-audi", "sha256-file", "none", "experimental-acoustic"), ("encoder", "app", "user", "unknown")


def fingerprint(j: Column | Record) -> Column:
    """Hashes in lower case, sizes, and the identity key: the first of PCM, fingerprint, audio and file hash. Null without a hash or a size.

    Where the fingerprint itself is missing, its type says which hash stands for it: audio, file, or else the first of PCM, audio and file.
    """
    v = record(j).value
    names = ("pcmHash", "audiHash", "metaHash", "fileHash")
    h = {n: hash_or_null(string(v, n)) for n in names}
    said = F.lower(_text(string(v, "audioFingerprintType"), 32))
    kind = F.when(said.isin(*FINGERPRINTS), said)
    stands = F.when(kind == "sha256-audi", h["audiHash"]).when(kind == "sha256-file", h["fileHash"]).otherwise(F.coalesce(h["pcmHash"], h["audiHash"], h["fileHash"]))
    print_ = F.coalesce(hash_or_null(string(v, "audioFingerprint")), stands)
    kind = F.coalesce(kind, F.when(h["pcmHash"].isNotNull(), "sha256-pcm").when(h["audiHash"].isNotNull(), "sha256-audi"))
    sizes = {n: _ms(number(v, n)) for n in ("fileSize", "durationMs", "sampleRate", "channels")}
    made = string(v, "source")
    rest = [_text(string(v, "generatedBy"), 128).alias("generatedBy"), _text(string(v, "generatedAt"), 40).alias("generatedAt"), F.when(made.isin(*MAKERS), made).alias("source")]
    some = F.coalesce(print_, *h.values(), *[s.cast("string") for s in sizes.values()]).isNotNull()
    out = [kind.alias("audioFingerprintType"), print_.alias("audioFingerprint"), *[c.alias(n) for n, c in (h | sizes).items()], *rest]
    return F.when(some, F.struct(*out, F.coalesce(h["pcmHash"], print_, h["audiHash"], h["fileHash"]).alias("identity")))


def highlights(j: Column | Record, most: int = 64) -> Column:
    """Moments in their own order; startMs may be called start. Null where no moment has a start."""
    v = record(j).value
    time = lambda x, a, b: _ms(F.coalesce(number(x, a), number(x, b)))
    made = F.transform(F.slice(listed(v, "highlights"), 1, most), lambda x: F.struct(time(x, "startMs", "start").alias("startMs"), time(x, "endMs", "end").alias("endMs"), _text(string(x, "label"), 128).alias("label"), _text(string(x, "useCase"), 32).alias("useCase"), _text(string(x, "sectionId"), 64).alias("sectionId")))
    good = F.filter(made, lambda x: x["startMs"].isNotNull())
    return F.when(F.size(good) > 0, F.struct(good.alias("highlights"), _text(string(v, "source"), 64).alias("source")))


# Fixed values of the format: the types that a stem may have; the roles of a credit record.
STEM_TYPES = "full_mix lead_vocals background_vocals drums bass guitar piano synths strings percussion instrumental acapella effects custom".split()
ROLES = "primaryArtist featuredArtists producer songwriter composer lyricist mixingEngineer masteringEngineer recordingEngineer label publisher copyrightHolder".split()


def stems(j: Column | Record, most: int = 32) -> Column:
    """Stems that have an id and a name, with defaults for what is missing or out of range. Null without any."""
    floor = lambda c, low: F.greatest(F.lit(low), F.floor(c)).cast("long")

    def one(x: Column) -> Column:
        length = F.coalesce(floor(number(x, "dataLength"), 0), F.lit(0).cast("long"))
        kind, codec = string(x, "stemType"), number(x, "codecId")
        return F.struct(
            _text(string(x, "stemId"), 64).alias("stemId"),
            _text(string(x, "stemName"), 128).alias("stemName"),
            F.when(kind.isin(*STEM_TYPES), kind).otherwise("custom").alias("stemType"),
            F.when(codec.between(0, 255), codec.cast("int")).alias("codecId"),
            F.coalesce(floor(number(x, "sampleRate"), 1), F.lit(44100).cast("long")).alias("sampleRate"),
            F.coalesce(F.least(F.lit(8), floor(number(x, "channels"), 1)), F.lit(2).cast("long")).alias("channels"),
            F.coalesce(floor(number(x, "durationSamples"), 0), F.lit(0).cast("long")).alias("durationSamples"),
            F.coalesce(floor(number(x, "dataOffset"), 0), F.lit(0).cast("long")).alias("dataOffset"),
            length.alias("dataLength"),
            F.coalesce(floor(number(x, "byteLength"), 0), length).alias("byteLength"),
            F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(2.0), number(x, "defaultVolume"))), F.lit(1.0)).alias("defaultVolume"),
            flag(Record(x, x), "requiredForPlayback").alias("requiredForPlayback"),
            _text(string(x, "checksum"), 16).alias("checksum"),
        )

    good = F.filter(F.transform(F.slice(listed(record(j).value, "stems"), 1, most), one), lambda x: x["stemId"].isNotNull() & x["stemName"].isNotNull())
    return F.when(F.size(good) > 0, good)


def credits(j: Column | Record) -> Column:
    """Names by role, performers and further credits, without names that hold markup. Null without any."""
    v = record(j).value
    roles = [F.coalesce(people(strings(v, r, 64, 128)), F.array().cast("array<string>")) for r in ROLES]
    performers = F.filter(F.transform(listed(v, "performers"), lambda x: F.struct(_text(string(x, "name"), 128).alias("name"), _text(string(x, "instrument"), 64).alias("instrument"))), lambda x: x["name"].isNotNull())
    more = F.transform(F.slice(listed(v, "additionalCredits"), 1, 48), lambda x: F.struct(identifier(string(x, "role"), 64).alias("role"), people(strings(x, "names", 64, 128)).alias("names")))
    more = F.coalesce(F.filter(more, lambda x: x["role"].isNotNull() & (F.size(x["names"]) > 0)), F.array().cast("array<struct<role:string,names:array<string>>>"))
    performers = F.coalesce(F.slice(performers, 1, 32), F.array().cast("array<struct<name:string,instrument:string>>"))
    notes = _text(string(v, "notes"), 4096)
    some = notes.isNotNull()
    for c in (*roles, performers, more):
        some = some | (F.size(c) > 0)
    return F.when(is_object(j) & some, F.struct(*[c.alias(r) for c, r in zip(roles, ROLES, strict=True)], performers.alias("performers"), more.alias("additionalCredits"), notes.alias("notes")))


def _tri(v: Column, name: str) -> Column:
    s = string(v, name)
    return F.when(_kind(v, name) == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "string")).when(s.isin("true", "false"), s).when(s.isin("unknown", "unspecified"), "unknown")


def rights(j: Column | Record) -> Column:
    """Notice, license and permissions (true, false, unknown or null). Null without any."""
    v = record(j).value
    texts = [_text(string(v, n), 512).alias(n) for n in ("copyrightNotice", "licenseType")]
    rest = [web_url(string(v, "licenseUrl")).alias("licenseUrl"), _text(string(v, "usageNotes"), 4096).alias("usageNotes"), *[_tri(v, n).alias(n) for n in ("remixAllowed", "commercialUseAllowed", "attributionRequired")]]
    return F.when(F.coalesce(*texts, *rest).isNotNull(), F.struct(*texts, *rest))


def identifiers(j: Column | Record, digits: int = 14) -> Column:
    """Codes (a barcode has so many digits at most), catalogue numbers, links and dates of a release. Null without any."""
    v = record(j).value
    out = [isrc(string(v, "isrc")).alias("isrc"), *[barcode(string(v, n), digits).alias(n) for n in ("upc", "ean")], *[identifier(string(v, n), 64).alias(n) for n in ("catalogNumber", "releaseId")]]
    out += [*[web_url(string(v, n)).alias(n) for n in ("artistUrl", "albumUrl", "sourceUrl")], _text(string(v, "distributor"), 128).alias("distributor"), *[_text(string(v, n), 32).alias(n) for n in ("releaseDate", "originalReleaseDate")]]
    return F.when(F.coalesce(*out).isNotNull(), F.struct(*out))


def integrity_hashes(j: Column | Record, most: int = 48) -> Column:
    """The file's hash and those of known chunks. Null without any."""
    v = record(j).value
    size = lambda x: F.when(number(x, "size") >= 0, F.floor(number(x, "size")).cast("long"))
    made = F.transform(F.slice(listed(v, "chunks"), 1, most), lambda x: F.struct(fourcc(string(x, "fourcc")).alias("fourcc"), hash_or_null(string(x, "sha256")).alias("sha256"), size(x).alias("size")))
    chunks = F.filter(made, lambda x: x["fourcc"].isNotNull() & x["sha256"].isNotNull())
    chunks = F.when(F.size(chunks) > 0, chunks)
    whole = hash_or_null(string(v, "fileSha256"))
    return F.when(F.coalesce(whole.isNotNull() | chunks.isNotNull(), F.lit(False)), F.struct(F.lit("sha256").alias("algorithm"), whole.alias("fileSha256"), chunks.alias("chunks")))


def _guided(name: str) -> Callable[[Column | Record], Column]:
    flags, list_name = GUIDANCE[name]
    return lambda j: guidance(j, *flags, list_name=list_name)


#: The records of the optional chunks that need no further names.
RECORDS = {
    "LYRC": lyrics, "EXPL": _guided("EXPL"), "SAFE": _guided("SAFE"), "RECV": _guided("RECV"), "SENS": _guided("SENS"), "MOOD": mood, "VIBE": vibe, "STEM": stems, "SECT": sections, "HOOK": hook, "HILT": highlights, "CRDT": credits, "LICN": rights, "IDEN": identifiers, "FING": fingerprint, "HASH": integrity_hashes,
}


def read_all(df: DataFrame, chunks: str, name: str, strict: bool = True, readers: dict[str, Callable[[Column | Record], Column]] | None = None) -> DataFrame:
    """df and, as `name`, the struct of all records of its map from FourCC to JSON text; readers: others than those of RECORDS.

    strict: as the format's reader has it, one record of more than MOST bytes makes all records of its row null; text that is no JSON nulls its own record only.
    """
    read_by = RECORDS | (readers or {})
    text = {k: F.try_element_at(F.col(chunks), F.lit(k)) for k in read_by}
    parsed = df.withColumns({f"_v_{k}": parse(text[k]) for k in read_by})
    read = F.struct(*[f(Record(F.col(f"_v_{k}"), text[k])).alias(k.lower()) for k, f in read_by.items()])
    if strict:
        long = F.exists(F.array(*[F.coalesce(F.octet_length(t), F.lit(0)) for t in text.values()]), lambda n: n > MOST)
        read = F.when(~long, read)
    return parsed.withColumn(name, read).drop(*[f"_v_{k}" for k in read_by])


def encode(record: Column) -> Column:
    """A record as the JSON text that its reader takes; null fields are left out."""
    return F.to_json(record)
