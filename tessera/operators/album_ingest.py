"""Albums from what is dropped into a folder: which files are what, which file each manifest entry means, and the saved albums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import basename
from tessera.operators.store import Store

# Fixed values of the format.
CONTAINER, ALBUM = ".mp5", ".mp5p"
MOST_TRACK_MS, LARGE_PACKAGE, LARGE_TRACK, LARGE_COVER = 24 * 3600 * 1000, 512 << 20, 256 << 20, 2_000_000


def file_kind(name: Column) -> Column:
    """container, album or other, by the ending of a file's name."""
    low = F.lower(name)
    return F.when(low.endswith(CONTAINER), "container").when(low.endswith(ALBUM), "album").otherwise("other")


def first_album(files: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Per folder: the album file that comes first by order (null if there is none), and how many containers and other files there are."""
    kind = file_kind(F.col(name))
    g = files.groupBy(folder).agg(F.min_by(name, F.when(kind == "album", F.col(order))).alias("album_file"), F.count_if(kind == "container").alias("containers"), F.count_if(kind == "other").alias("others"))
    return g.select(folder, "album_file", "containers", "others")


def _key(name: Column) -> Column:
    return F.lower(basename(name))


def resolve(entries: DataFrame, tracks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """entries with what plays for each: the track whose id is the entry's track_id, or else the one whose file name is that of its file.

    entries: album, pos, track_id, file, title, artist, duration_ms, album_artist. tracks: id, name, title, artist, duration_ms, parse_error, seq. Of tracks with
    one id or name (without folders, case aside) the last by seq counts; those with a parse_error don't. scope: columns of both within which they are looked for.

    All keys of an entry go into one equi-join, ranked; the best rank per entry is kept. An entry's own title, artist and duration come before the
    track's. Adds: display_title, display_artist, duration (ms, null if unknown), missing, found_id, found_by (id, name or null).
    """
    good = tracks.where(F.col("parse_error").isNull())
    info = F.struct("id", F.col("title").alias("t"), F.col("artist").alias("a"), F.col("duration_ms").alias("d"))
    keys = F.array(F.struct(F.lit(0).alias("rank"), F.col("id").cast("string").alias("key")), F.struct(F.lit(1).alias("rank"), _key(F.col("name")).alias("key")))
    listed = good.select(*scope, "seq", info.alias("found"), F.explode(keys).alias("k")).where("k.key IS NOT NULL")
    listed = listed.groupBy(*scope, F.col("k.rank").alias("rank"), F.col("k.key").alias("key")).agg(F.max_by("found", "seq").alias("found"))
    asked = F.array(F.struct(F.lit(0).alias("rank"), F.col("track_id").cast("string").alias("key")), F.struct(F.lit(1).alias("rank"), _key(F.col("file")).alias("key")))
    long = entries.select("album", "pos", *scope, F.explode(asked).alias("k")).select("album", "pos", *scope, "k.*")
    hits = long.join(listed, [*scope, "rank", "key"])
    best = hits.groupBy("album", "pos").agg(F.min(F.struct("rank", "found")).alias("hit"))
    out = entries.join(best, ["album", "pos"], "left")
    found = F.col("hit.found")
    stem = F.regexp_replace(basename(F.col("file")), r"(?i)\.mp5$", "")
    return out.select(
        *entries.columns, F.coalesce("title", found["t"], stem).alias("display_title"), F.coalesce("artist", found["a"], "album_artist", F.lit("")).alias("display_artist"), F.coalesce("duration_ms", F.round(found["d"])).cast("long").alias("duration"),
        F.col("hit").isNull().alias("missing"), found["id"].alias("found_id"), F.when(F.col("hit.rank") == 0, "id").when(F.col("hit.rank") == 1, "name").alias("found_by"),
    )


def totals(resolved: DataFrame) -> DataFrame:
    """Per album: resolved_count, missing_count, total_duration (of those known and over 0, else null), found_files and missing_files in the order of entries."""
    ordered = lambda here: F.transform(F.array_sort(F.collect_list(F.when(here, F.struct("pos", "file")))), lambda x: x["file"])  # noqa: E731  an album is one manifest
    g = resolved.groupBy("album")
    return g.agg(F.count_if(~F.col("missing")).alias("resolved_count"), F.count_if("missing").alias("missing_count"), F.sum(F.when(F.col("duration") > 0, F.col("duration"))).alias("total_duration"), ordered(~F.col("missing")).alias("found_files"), ordered(F.col("missing")).alias("missing_files"))


def directory_problems(manifest: DataFrame, directory: DataFrame) -> DataFrame:
    """Per album of manifest (album, pos, track_id) or directory (album, pos, track_id; pos from 0 in both): ok, count (numbers differ), or order (another id at some place).

    A full join on album and place, so an album of any size is spread over tasks.
    """
    a = manifest.select("album", "pos", F.col("track_id").alias("a"))
    b = directory.select("album", "pos", F.col("track_id").alias("b"))
    both = a.join(b, ["album", "pos"], "full").groupBy("album").agg(F.count("a").alias("n"), F.count("b").alias("m"), F.count_if(F.col("a") != F.col("b")).alias("odd"))
    return both.select("album", F.when(F.col("n") != F.col("m"), "count").when(F.col("odd") > 0, "order").otherwise("ok").alias("problem"))


def package_totals(fragments: DataFrame, album: str, track: str, size: str) -> DataFrame:
    """Per package: tracks, fragments, bytes, and what is large enough to warn of (package, or tracks)."""
    by_track = fragments.groupBy(album, track).agg(F.count("*").alias("_f"), F.sum(size).alias("_b"))
    g = by_track.groupBy(album).agg(F.count("*").alias("tracks"), F.sum("_f").alias("fragments"), F.sum("_b").alias("bytes"), F.count_if(F.col("_b") > LARGE_TRACK).alias("large_tracks"))
    return g.withColumn("large_package", F.col("bytes") > LARGE_PACKAGE)


SAVED = "id string, name string, imported_at timestamp, kind string, manifest string, file_size long, blob_id string"
BLOBS = "id string, filename string, imported_at timestamp, content binary"


class SavedAlbums:
    """Saved manifests, and saved packages whose bytes lie in the library's own store under blob_id."""

    def __init__(self, spark, path: str, buckets: int = 16):
        self.albums = Store(spark, f"{path.rstrip('/')}/albums", "id", SAVED, buckets)
        self.blobs = Store(spark, f"{path.rstrip('/')}/blobs", "id", BLOBS, buckets)

    def save(self, rows: DataFrame) -> None:
        """rows (id, name, imported_at, manifest, content): with content it is a package, else a manifest. A name that is missing is the manifest's title."""
        embedded = F.col("content").isNotNull()
        title = F.coalesce(F.get_json_object("manifest", "$.album.title"), F.lit("album"))
        name = F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.concat(title, F.lit(ALBUM))).otherwise(F.col("name"))
        blob = F.when(embedded, F.concat(F.lit("blob-"), "id"))
        self.blobs.put(rows.where(embedded).select(blob.alias("id"), name.alias("filename"), "imported_at", "content"))
        self.albums.put(rows.select("id", name.alias("name"), "imported_at", F.when(embedded, "embedded").otherwise("manifest").alias("kind"), "manifest", F.octet_length("content").cast("long").alias("file_size"), blob.alias("blob_id")))

    def list(self) -> DataFrame:
        return self.albums.all().orderBy(F.desc("imported_at"), "id")

    def get(self, *ids) -> DataFrame:
        return self.albums.get(*ids)

    def content(self, *ids) -> DataFrame:
        """id and bytes of saved packages; an album without a blob gives no row."""
        return self.albums.get(*ids).select(F.col("id").alias("album_id"), F.col("blob_id").alias("id")).join(self.blobs.all().select("id", "content"), "id").select(F.col("album_id").alias("id"), "content")

    def delete(self, *ids) -> None:
        """Albums and their blobs; ids that aren't there are passed over."""
        gone = self.albums.get(*ids).select("id", "blob_id").collect()  # as many as ids
        self.albums.delete_keys(*[r.id for r in gone])
        self.blobs.delete_keys(*[r.blob_id for r in gone if r.blob_id])
