"""http(s) URLs in the form of the URL standard, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the standard: what is percent-encoded in a path, a query and a fragment (besides controls and all beyond ASCII), what no host may hold, dot segments.
PATH, QUERY, FRAGMENT = r'\x20"#<>?^`{}', "\\x20\"#<>'", r'\x20"<>`'
FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
DOT, DOTS = r"^(?i)(\.|%2e)$", r"^(?i)(\.|%2e)(\.|%2e)$"


def _with(value: Column, made) -> Column:
    """made(value), with value computed once however often it is used there."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _encoded(c: Column, signs: str) -> Column:
    """Percent-encodes controls, what is beyond ASCII, and signs; what is encoded already stays as it is."""
    odd = rf"[\x00-\x1F\x7F{signs}]|[^\x00-\x7F]"
    pieces = F.regexp_extract_all(c, F.lit(rf"((?:{odd})+|[^{signs}\x00-\x1F\x7F-\x{{10FFFF}}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^(?:{odd})"), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))).otherwise(p)), "")


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its segments `.` and `..` resolved, however they are written."""
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        end = F.when(x["last"], F.array(F.lit(""))).otherwise(empty)
        return F.when(x["s"].rlike(DOTS), F.concat(shorter, end)).when(x["s"].rlike(DOT), F.concat(done, end)).otherwise(F.concat(done, F.array(x["s"])))

    def joined(parts: Column) -> Column:
        marked = F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == F.size(parts) - 1).alias("last")))
        return F.array_join(F.aggregate(marked, empty, step), "/")

    return F.concat(F.lit("/"), _with(F.split(F.substring(path, 2, 1 << 20), "/"), joined))


def _ipv4_part(c: Column) -> Column:
    """A number in decimal, octal (0...) or hexadecimal (0x...); null for anything else."""
    low = F.lower(c)
    hexadecimal = F.conv(F.when(low == "0x", "0").otherwise(F.substring(low, 3, 20)), 16, 10).cast("decimal(20,0)")
    return F.when(low.rlike("^0x[0-9a-f]{0,12}$"), hexadecimal).when(c.rlike("^0[0-7]{1,18}$"), F.conv(c, 8, 10).cast("decimal(20,0)")).when(c.rlike("^(0|[1-9][0-9]{0,15})$"), c.cast("decimal(20,0)"))


def _ipv4(host: Column) -> Column:
    """A host whose last label is a number, as four decimal numbers; null if it is none of the forms of an IPv4 address."""
    powers = F.array(*[F.lit(256**k) for k in (3, 2, 1, 0)])

    def address(parts: Column) -> Column:
        n, tail = F.size(parts), F.element_at(parts, -1)
        first = F.slice(parts, F.lit(1), n - 1)
        room = F.element_at(F.array(*[F.lit(256 ** (5 - k)).cast("decimal(20,0)") for k in range(1, 5)]), F.least(n, F.lit(4)))
        good = (n <= 4) & F.forall(parts, lambda p: p.isNotNull()) & F.forall(first, lambda p: p <= 255) & (tail < room)
        value = F.aggregate(F.transform(first, lambda p, i: p.cast("long") * F.get(powers, i)), F.lit(0).cast("long"), lambda a, x: a + x) + tail.cast("long")
        return F.when(good, _with(value, lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])))

    return _with(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _ipv4_part), address)


def _host(raw: Column) -> Column:
    """The host in lower case and ASCII; null if it can't be one. An IPv6 address stays as it is written, in lower case."""

    def checked(plain: Column) -> Column:
        number = plain.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
        return F.when(plain.rlike(FORBIDDEN) | (plain == ""), F.lit(None)).when(number, _ipv4(plain)).otherwise(plain)

    def ascii_of(x: Column) -> Column:
        return F.when(x.rlike(r"[^\x00-\x7F]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.lower(x))).otherwise(F.lower(x))

    decoded = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    return F.when(raw.rlike(r"^\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]$"), F.lower(raw)).otherwise(_with(_with(decoded, ascii_of), checked))


def href(c: Column, most: int = 2048) -> Column:
    """The URL as the standard serialises it, cut to `most` characters; null unless it is http or https, without credentials, with a host and port that can be.

    Tabs and line breaks go, backslashes before the query are slashes, missing or further slashes after the scheme don't matter; the default port, `.` and `..` are taken out; what the
    standard encodes is percent-encoded; hosts beyond ASCII are put into ASCII by IDNA 2003.
    """

    def split(t: Column) -> Column:
        front = F.replace(F.regexp_extract(t, r"^[^?#]*", 0), F.lit("\\"), F.lit("/"))
        authority = F.regexp_extract(front, r"^(?i)https?:/*([^/]*)", 1)
        return F.struct(
            F.lower(F.regexp_extract(t, r"^(?i)(https?):", 1)).alias("scheme"), F.regexp_extract(authority, r"^([\s\S]*)@", 1).alias("credentials"), F.regexp_extract(authority, r"([^@]*)$", 1).alias("address"),
            F.regexp_extract(front, r"^(?i)https?:/*[^/]*([\s\S]*)$", 1).alias("path"), F.regexp_extract(t, r"^[^?#]*(\?[^#]*)", 1).alias("query"), F.regexp_extract(t, r"^[^#]*(#[\s\S]*)$", 1).alias("fragment"),
        )

    def ported(u: Column) -> Column:
        port = F.regexp_extract(u["address"], r":([^:\]]*)$", 1)
        number = F.when(port == "", F.lit(-1)).when(port.rlike("^0*[0-9]{1,5}$"), F.regexp_replace(port, "^0+(?=[0-9])", "").cast("int"))
        return F.struct(u.alias("u"), _host(F.regexp_replace(u["address"], r":[^:\]]*$", "")).alias("host"), number.alias("port"))

    def joined(x: Column) -> Column:
        u, default = x["u"], F.when(x["u"]["scheme"] == "http", 80).otherwise(443)
        shown = F.when((x["port"] == -1) | (x["port"] == default), "").otherwise(F.concat(F.lit(":"), x["port"].cast("string")))
        path = F.when(u["path"] == "", "/").otherwise(u["path"])
        whole = F.concat(u["scheme"], F.lit("://"), x["host"], shown, _encoded(_without_dots(path), PATH), _encoded_after(u["query"], QUERY), _encoded_after(u["fragment"], FRAGMENT))
        return F.when((u["scheme"] != "") & u["credentials"].rlike("^:?$") & x["port"].between(-1, 65535), F.substring(whole, 1, most))

    trimmed = F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return _with(_with(_with(trimmed, split), ported), joined)


def _encoded_after(c: Column, signs: str) -> Column:
    """A query or fragment with its first sign, which stays."""
    return F.when(c == "", "").otherwise(F.concat(F.substring(c, 1, 1), _encoded(F.substring(c, 2, 1 << 20), signs)))
