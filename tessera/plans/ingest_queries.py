"""Album ingest and the library's store over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import album_ingest, scans
from tessera.operators.store import Store
from tessera.plans.queries import ORACLES, QUERIES, query  # noqa: F401  (they are registered there)
from tessera.scratch import scratch


@query(
    "WITH e AS (SELECT l_orderkey AS album, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS pos, l_partkey, l_returnflag, l_linestatus FROM lineitem), "
    "p AS (SELECT p_partkey, p_name, p_brand, CAST(round(p_retailprice * 1000) AS BIGINT) AS ms FROM part WHERE p_size > 1), "
    "j AS (SELECT e.*, coalesce(a.p_name, b.p_name) AS t, coalesce(a.p_brand, b.p_brand) AS b, coalesce(a.ms, b.ms) AS ms, CASE WHEN a.p_partkey IS NOT NULL THEN 'id' WHEN b.p_partkey IS NOT NULL THEN 'name' END AS found_by "
    "FROM e LEFT JOIN p a ON l_returnflag = 'R' AND a.p_partkey = l_partkey LEFT JOIN p b ON l_linestatus = 'O' AND b.p_partkey = l_partkey) "
    "SELECT album, pos, coalesce(t, 'Part-' || l_partkey) AS display_title, coalesce(b, 'nobody') AS display_artist, ms AS duration, found_by IS NULL AS missing, found_by FROM j"
)
def album_ingest_entries(t):
    # lines as entries: returned ones name their part by id, open ones by a file of another case and folder, others by nothing that is there
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus"]
    e = scans.row_number(t("lineitem").select("l_orderkey", *order), ["l_orderkey"], order, "pos")
    ident = F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")).otherwise("no-such-id")
    folder = F.when(F.col("l_linestatus") == "O", r"disc\Part-").otherwise("disc/lost/Part-")
    file = F.concat(folder, F.col("l_partkey"), F.when(F.col("l_linestatus") == "O", ".MP5").otherwise(".mp5"))
    file = F.when(F.col("l_linestatus") == "O", file).otherwise(F.concat(F.lit("x/Part-"), "l_partkey", F.lit(".mp5.mp5")))
    none = F.lit(None).cast("string")
    entries = e.select(F.col("l_orderkey").alias("album"), "pos", ident.alias("track_id"), file.alias("file"), none.alias("title"), none.alias("artist"), F.lit(None).cast("double").alias("duration_ms"), F.lit("nobody").alias("album_artist"))
    p = t("part")
    tracks = p.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("in/part-"), "p_partkey", F.lit(".mp5")).alias("name"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), (F.col("p_retailprice") * 1000).alias("duration_ms"), F.when(F.col("p_size") <= 1, "unreadable").alias("parse_error"), F.col("p_partkey").alias("seq"))
    out = album_ingest.resolve(entries, tracks)
    return out.select("album", "pos", F.regexp_replace("display_title", r"\.mp5$", "").alias("display_title"), "display_artist", "duration", "missing", "found_by")


@query(
    "WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, role FROM conversations) "
    "SELECT a.conv_id AS album, CASE WHEN count(CASE WHEN a.role <> b.role THEN 1 END) > 0 THEN 'order' ELSE 'ok' END AS problem FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.pos = a.n - 1 - b.pos GROUP BY 1"
)
def album_directory(t):
    # a dialogue's roles against themselves from the end
    c = scans.row_number(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "n").select(F.col("conv_id").alias("album"), (F.col("n") - 1).alias("pos"), F.col("role").alias("track_id"))
    n = c.groupBy("album").agg(F.count("*").alias("n"))
    turned = c.join(n, "album").select("album", (F.col("n") - 1 - F.col("pos")).alias("pos"), "track_id")
    return album_ingest.directory_problems(c, turned)


@query("SELECT source AS album, count(DISTINCT lang) AS tracks, count(*) AS fragments, sum(strlen(text))::BIGINT AS bytes, false AS large_package FROM documents GROUP BY 1")
def album_package_totals(t):
    d = t("documents").select("source", "lang", F.octet_length("text").cast("long").alias("size"))
    return album_ingest.package_totals(d, "source", "lang", "size").select(F.col("source").alias("album"), "tracks", "fragments", "bytes", "large_package")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN upper(source) ELSE source END AS source, n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0")
def store_changes(t):
    # all documents are put, those of good quality put again, toxic ones deleted
    d, labels = t("documents").select("doc_id", "source", "n_chars"), t("labels")
    store = Store(d.sparkSession, scratch(d.sparkSession, "store"), "doc_id", "doc_id long, source string, n_chars long", 8)
    store.put(d)
    store.put(d.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").withColumn("source", F.upper("source")))
    store.delete(labels.where("toxic = 1").select("doc_id"))
    return store.all()


@query(
    "SELECT p_partkey, p_name AS title, p_brand AS artist, CASE WHEN p_size % 2 = 0 THEN p_type END AS album, p_brand AS albumartist, (2000 + p_size) || '-01-02' AS date, (2000 + p_size)::VARCHAR AS year, 'a=b' AS comment FROM part"
)
def source_tags(t):
    # tags as a decoder writes them, with remarks, empty values and a key that comes twice
    from tessera.operators import forms

    text = F.concat(F.lit(";FFMETADATA1\r\nTITLE=first\ntitle = "), "p_name", F.lit("\n# album=no\nalbum="), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("  "), F.lit("\n=x\nalbum_artist="), "p_brand", F.lit("\ndate="), (F.col("p_size") + 2000).cast("string"), F.lit("-01-02\ndescription=a=b\nno sign"))
    return forms.source_tags(t("part").select("p_partkey", text.alias("tags")), "tags").select("p_partkey", "title", "artist", "album", "albumartist", "date", "year", "comment")


@query(
    "WITH c AS (SELECT conv_id, bool_or(length(text) % 17 = 0) AS bad, count(*) AS n, min(turn) AS first FROM conversations GROUP BY 1) "
    "SELECT conv_id, CASE WHEN bad THEN 'keep' ELSE 'set' END AS sections_action, CASE WHEN NOT bad THEN n END AS n_sections, CASE WHEN NOT bad THEN first * 1000 END AS hook_ms, CASE WHEN conv_id % 2 = 0 THEN 'remove' ELSE 'set' END AS highlights_action, "
    "CASE WHEN conv_id % 3 = 0 OR NOT bad THEN 'set' ELSE 'remove' END AS lyrics_action, CASE WHEN NOT bad THEN n END AS n_lines FROM c"
)
def form_overrides(t):
    # dialogues as a form's texts; a turn whose length 17 divides gives a line that can't be read
    from tessera.functions.text import timecode
    from tessera.operators import forms

    c, bad = t("conversations"), F.length("text") % 17 == 0
    at = timecode(F.col("turn") * 1000)
    line = F.when(bad, "oops").otherwise(F.concat(F.lit("["), at, F.lit("|chorus] x")))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    forms_of = g.select("conv_id", F.when(F.col("conv_id") % 3 == 0, " la ").otherwise(" ").alias("unsynced"), F.col("lines").alias("synced"), F.col("lines").alias("sections"), F.when(F.col("conv_id") % 2 == 0, "").otherwise("[00:01-00:02|share] x").alias("highlights"))
    out = forms.timed_overrides(forms_of, "conv_id", "unsynced", "synced", "sections", "highlights")
    n = lambda name: F.when(F.col(name).isNotNull(), F.size(name))
    return out.select("conv_id", "sections_action", n("sections").alias("n_sections"), "hook_ms", "highlights_action", "lyrics_action", n("synced").alias("n_lines"))


@query(
    "SELECT 'doc-' || doc_id AS path, CASE n_chars % 4 WHEN 0 THEN 'PCM (reference / debug)' WHEN 1 THEN 'MP5-C (experimental / lab)' WHEN 2 THEN 'MP5-L v3 (lossless · default)' ELSE 'MP5-H (hybrid · not default)' END AS codec_label, CASE WHEN strlen(text) > 0 AND n_chars > 0 THEN round(strlen(text) / (n_chars * 4.0) * 100, 6) END AS vs_pcm_percent, "
    "coalesce(source, '') <> '' AS has_tags, n_chars % 5 = 0 AS has_cover, n_chars % 2 = 0 AS has_lyrics, n_chars % 2 = 1 AS has_guidance FROM documents"
)
def export_summary(t):
    from tessera.operators import forms

    d, n = t("documents"), F.col("n_chars")
    files = d.select(F.concat(F.lit("doc-"), "doc_id").alias("path"), F.octet_length("text").alias("output_bytes"), F.lit(None).cast("long").alias("source_bytes"), (n % 4).cast("int").alias("codec_id"), n.alias("total_samples"), F.lit(2).alias("channels"), F.lit(16).alias("bits"), F.array(F.struct(F.lit("album").alias("key"), F.col("source").alias("value"))).alias("meta"), F.when(n % 5 == 0, 9).alias("cover_bytes"), F.lit(None).cast("string").alias("unsynced"), F.when(n % 2 == 0, F.array(F.lit("LYRC"))).otherwise(F.array(F.lit("SENS"), F.lit("X"))).alias("optional"), F.lit(None).cast("int").alias("stem_count"))
    return forms.export_summary(files).select("path", "codec_label", F.round("vs_pcm_percent", 6).alias("vs_pcm_percent"), "has_tags", "has_cover", "has_lyrics", "has_guidance")
