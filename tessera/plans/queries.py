"""The library's operators applied to the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import catalog as cat
from tessera.operators import folds, intervals, joins, ranking, scans
from tessera.operators import library as lib

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


# ---------------------------------------------------------------- filters and projections


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'heth')")
def library_filter(t):
    return cat.search(t("documents"), " Heth ", "source", "lang", "text").select("doc_id", "lang", "source", "n_chars")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'lossless' WHEN contains(lower(p_type), 'brass') THEN 'lossy' WHEN contains(lower(p_type), 'copper') THEN 'hybrid' ELSE 'pcm' END AS codec FROM part")
def codec_label_map(t):
    return t("part").select("p_partkey", cat.label(F.col("p_type"), {"steel": "lossless", "brass": "lossy", "copper": "hybrid"}, "pcm").alias("codec"))


@query("SELECT d.doc_id, substr(text, 1, 40) AS title, source AS artist, coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 AS notice, l.doc_id IS NOT NULL AS labelled, nullif(concat_ws(' · ', CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low quality' END, CASE WHEN n_chars < 100 THEN 'short' END), '') AS guidance FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def summary_projection(t):
    d = t("documents").join(t("labels").withColumnRenamed("doc_id", "_l"), F.col("doc_id") == F.col("_l"), "left")
    notes = cat.warnings((F.col("toxic") == 1, "toxic"), (F.col("quality") == 0, "low quality"), (F.col("n_chars") < 100, "short"))
    return d.select("doc_id", F.substring("text", 1, 40).alias("title"), F.col("source").alias("artist"), cat.any_flag(F.col("toxic") == 1, F.col("quality") == 0).alias("notice"), F.col("_l").isNotNull().alias("labelled"), cat.guidance(notes).alias("guidance"))


@query("SELECT doc_id, CASE WHEN n_chars >= 10000 THEN 'block' WHEN n_chars >= 3000 THEN 'warn' WHEN n_chars >= 1000 THEN 'info' ELSE 'ok' END AS level FROM documents")
def guardrail_ladder(t):
    return t("documents").select("doc_id", cat.ladder(F.col("n_chars"), [(1000, "info"), (3000, "warn"), (10000, "block")], "ok").alias("level"))


@query("SELECT user_id, count(*) AS n, sum(CASE WHEN value > 100 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS load, CASE WHEN sum(CASE WHEN value > 100 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END) >= 20 THEN 'block' WHEN sum(CASE WHEN value > 100 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END) >= 5 THEN 'warn' ELSE 'ok' END AS level FROM events GROUP BY user_id")
def mix_safety(t):
    load = F.when(F.col("value") > 100, 2).when(F.col("value") > 50, 1).otherwise(0)
    g = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(load).alias("load"))
    return g.withColumn("level", cat.ladder(F.col("load"), [(5, "warn"), (20, "block")], "ok"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'P' ELSE o_orderstatus END AS status, o_orderstatus IN ('F', 'P') AS retryable FROM orders")
def batch_retry(t):
    o = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderstatus").isin("F", "P").alias("retryable"))
    return cat.retry(o, "status", "F", "P").select("o_orderkey", "status", "retryable")


@query("SELECT p_partkey, p_brand AS brand, CASE WHEN p_size > 25 THEN 'large' END AS size_tag, p_name AS name FROM part")
def metadata_override(t):
    base = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.lit("old"), F.lit("name"), F.col("p_name"))
    edits = F.create_map(F.lit("size"), F.when(F.col("p_size") > 25, "large").otherwise(""))
    m = t("part").select("p_partkey", cat.override(base, edits).alias("m"))
    return m.select("p_partkey", F.col("m")["brand"].alias("brand"), F.try_element_at("m", F.lit("size")).alias("size_tag"), F.col("m")["name"].alias("name"))


@query("SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS title, coalesce(max(CASE WHEN role = 'system' THEN text END), max(CASE WHEN turn = 0 THEN text END)) AS shown FROM conversations GROUP BY conv_id")
def display_fallback(t):
    g = t("conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("title"), F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system"))
    return g.select("conv_id", "title", F.coalesce("system", "title").alias("shown"))


# ---------------------------------------------------------------- order and limits


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def library_newest(t):
    return t("orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@query("SELECT lang, doc_id, n_chars, rank FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 5")
def topk_per_group(t):
    return cat.top_per_group(t("documents").select("lang", "doc_id", "n_chars"), "lang", [F.desc("n_chars"), F.col("doc_id")], 5)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY CAST(regexp_extract(s_name, '(\\d+)', 1) AS BIGINT), s_suppkey)::INT AS place FROM supplier")
def natural_order(t):
    s = t("supplier").select("s_suppkey", cat.natural_key(F.col("s_name")).alias("k"))
    return ranking.row_numbers(s, [F.col("k"), F.col("s_suppkey")], "place").select("s_suppkey", F.col("place").cast("int").alias("place"))


@query("SELECT conv_id, list_aggregate(list_slice(list(role ORDER BY turn), 1, 3), 'string_agg', ',') AS first_roles FROM conversations GROUP BY conv_id")
def first_n_array(t):
    c = cat.top_per_group(t("conversations"), "conv_id", [F.col("turn")], 3)
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("first_roles"))


# ---------------------------------------------------------------- lookups


@query("WITH d AS (SELECT doc_id, sha256(text) AS h, source, n_chars FROM documents), a AS (SELECT h, min(doc_id) AS m FROM d GROUP BY 1), b AS (SELECT source, n_chars, min(doc_id) AS m FROM d GROUP BY 1, 2) SELECT d.doc_id, coalesce(a.m, b.m) AS duplicate_of FROM d LEFT JOIN a USING (h) LEFT JOIN b ON d.source = b.source AND d.n_chars = b.n_chars")
def dup_probe(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"), "source", "n_chars")
    return cat.probe_duplicates(d, d, "h", ["source", "n_chars"], "duplicate_of", "doc_id").select("doc_id", "duplicate_of")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id)) GROUP BY text")
def save_unless_dup(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return cat.save_unless_duplicate(d, d.join(t("labels").select("doc_id"), "doc_id").select("h"), "h", "doc_id")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def album_resolve(t):
    return joins.first_key(t("lineitem"), t("part"), [("l_partkey", "p_partkey")], "p_name", "p_name").select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT p_partkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS missing FROM part")
def album_missing(t):
    used = t("lineitem").where("l_quantity > 45").select("l_partkey").distinct()
    return t("part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.col("l_partkey").isNull().alias("missing"))


@query("SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nationkey, CASE WHEN s.s_nationkey IS NULL THEN 'missing' WHEN c.c_nationkey IS NULL THEN 'unexpected' ELSE 'ok' END AS status FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 5000) c FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 3000) s ON c.c_nationkey = s.s_nationkey")
def stem_audit(t):
    a = t("customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nationkey"))
    return joins.audit(a, t("supplier").where("s_acctbal < 3000").select(F.col("s_nationkey").alias("nationkey")), "nationkey")


@query("WITH e AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WHERE role = 'user'), p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') SELECT p.conv_id, p.turn, e.text AS prompt FROM p LEFT JOIN (SELECT DISTINCT conv_id, c FROM e) k ON p.conv_id = k.conv_id LEFT JOIN e ON e.conv_id = p.conv_id AND e.n = least(p.n, k.c)")
def hash_by_ordinal(t):
    c = t("conversations")
    return joins.by_position(c.where("role = 'user'"), c.where("role = 'assistant'").select("conv_id", "turn"), "conv_id", "turn", "turn", "text", "prompt")


@query("WITH m AS (SELECT user_id, ts, max(value) AS mark FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, m.mark FROM events e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts")
def asof_line(t):
    e = t("events").select("event_id", "user_id", "ts")
    marks = t("events").where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("mark"))
    return joins.as_of(e, marks, ["user_id"], "ts", "ts", ["mark"]).select("event_id", "mark")


@query("SELECT event_id, name, CASE WHEN value >= high - 0.05 AND looped THEN 'loop' WHEN value >= high - 0.05 THEN 'stop' ELSE 'play' END AS action FROM events JOIN (VALUES ('intro', 0.0, 10.0, true), ('verse', 10.0, 50.0, false), ('hook', 40.0, 90.0, true)) r(name, low, high, looped) ON value >= low AND value < high")
def range_tick(t):
    e = t("events")
    r = e.sparkSession.createDataFrame([("intro", 0.0, 10.0, True), ("verse", 10.0, 50.0, False), ("hook", 40.0, 90.0, True)], "name string, low double, high double, looped boolean")
    return joins.in_range(e, r, "value").select("event_id", "name", "action")


@query(
    "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 200 AS low, l_extendedprice / 200 + l_tax * l_quantity / 100 + 0.001 AS high FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_partkey, event_id FROM events JOIN r ON value >= low AND value < high"
)
def many_ranges(t):
    # a range for each line item, from a thousandth to four wide
    low = F.col("l_extendedprice") / 200
    r = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", low.alias("low"), (low + F.col("l_tax") * F.col("l_quantity") / 100 + 0.001).alias("high"))
    return intervals.sweeping(t("events").select("event_id", "value"), r, "value", columns=["l_orderkey", "l_linenumber", "l_partkey", "event_id"])


@query("SELECT c_custkey, c_name FROM customer")
def append_without_repeats(t):
    c = t("customer").select("c_custkey", "c_name")
    return joins.append_new(t("customer").where("c_acctbal > 5000").select("c_custkey", "c_name"), c, "c_custkey")


@query("SELECT user_id, min(ts) AS first_at, (arg_min(event_id, (ts, event_id))) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id")
def first_section_of_type(t):
    e = t("events").where("event_type = 'click'")
    return e.groupBy("user_id").agg(F.min("ts").alias("first_at"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# ---------------------------------------------------------------- aggregates and distinct


@query("SELECT o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS done_size FROM orders GROUP BY 1")
def batch_summary(t):
    return cat.batch_summary(t("orders"), "o_orderstatus", "o_totalprice", "F").withColumn("done_size", F.round("done_size", 2))


@query("SELECT count(*) AS n, sum(strlen(text))::BIGINT AS bytes, avg(n_chars) AS mean_chars FROM documents")
def library_total(t):
    return t("documents").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.avg("n_chars").alias("mean_chars"))


@query("SELECT o_orderkey, count(l_orderkey) AS resolved, sum(CASE WHEN l_quantity > 25 THEN l_quantity END) AS duration, CASE WHEN count(l_orderkey) = 0 THEN 'empty' WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) > 0 THEN 'partial' ELSE 'complete' END AS verdict FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def album_totals(t):
    j = t("orders").select("o_orderkey").join(t("lineitem").select("l_orderkey", "l_quantity", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    g = j.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("resolved"), F.sum(F.when(F.col("l_quantity") > 25, F.col("l_quantity"))).alias("duration"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return g.select("o_orderkey", "resolved", "duration", F.when(F.col("resolved") == 0, "empty").when(F.col("r") > 0, "partial").otherwise("complete").alias("verdict"))


@query(
    "WITH RECURSIVE i AS (SELECT l_orderkey, (l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS k, (l_partkey % 3)::INT AS a, (l_suppkey % 4)::INT AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), "
    "s AS (SELECT l_orderkey, k, n, [a] AS sa, [b] AS sb, NULL::VARCHAR AS reject FROM i WHERE n = 1 UNION ALL "
    "SELECT i.l_orderkey, i.k, i.n, CASE WHEN list_contains(sa, a) OR list_contains(sb, b) THEN sa ELSE list_append(sa, a) END, CASE WHEN list_contains(sa, a) OR list_contains(sb, b) THEN sb ELSE list_append(sb, b) END, "
    "CASE WHEN list_contains(sa, a) THEN 'a' WHEN list_contains(sb, b) THEN 'b' END FROM s JOIN i ON i.l_orderkey = s.l_orderkey AND i.n = s.n + 1) SELECT l_orderkey, k, reject FROM s"
)
def manifest_dedup(t):
    # lines of an order as entries of a manifest, with two keys that repeat; k itself is not in their order where a part has seven digits
    place = ["l_linenumber", "l_partkey", "l_suppkey"]
    c = t("lineitem").select("l_orderkey", *place, (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("k"), (F.col("l_partkey") % 3).cast("int").alias("a"), (F.col("l_suppkey") % 4).cast("int").alias("b"))
    return cat.keep_first(c, ["l_orderkey"], place, ["a", "b"]).select("l_orderkey", "k", "reject")


@query("SELECT doc_id, source, n_chars FROM documents WHERE source = 'web' UNION ALL SELECT min(doc_id), source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.source = 'web' AND o.source = d.source AND o.n_chars = d.n_chars) GROUP BY source, n_chars")
def queue_merge(t):
    d = t("documents").select("doc_id", "source", "n_chars")
    return cat.merge_queue(d.where("source = 'web'"), d, ["source", "n_chars"], "doc_id")


@query("SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2")
def fold_last_wins(t):
    return folds.fold(t("conversations"), ["conv_id"], "role", "text", "turn")


@query("SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations GROUP BY 1, 2")
def fold_first_wins(t):
    return folds.fold(t("conversations"), ["conv_id"], "role", "text", "turn", last=False)


@query("SELECT doc_id, greatest(ceil(length(text) / 500.0), 1)::INT AS parts, t.i::INT AS part, substr(text, t.i::INT * 500 + 1, 500) AS piece FROM documents, unnest(range(0, greatest(ceil(length(text) / 500.0), 1)::BIGINT)) AS t(i)")
def fragment_split(t):
    return folds.split_text(t("documents").select("doc_id", "text"), "text", 500).select("doc_id", "parts", "part", "piece")


@query("SELECT doc_id, true AS complete, sha256(text) AS whole FROM documents")
def fragment_reassemble(t):
    cut = folds.split_text(t("documents").select("doc_id", "text"), "text", 500)
    return folds.reassemble(cut, "doc_id", "part", "parts", "piece").select("doc_id", "complete", F.sha2("whole", 256).alias("whole"))


@query("WITH g AS (SELECT l_orderkey, max(l_linenumber) AS n, list(DISTINCT l_linenumber) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT l_orderkey, array_to_string(list_sort(list_filter(range(1, n + 1), lambda x: NOT list_contains(s, x))), ',') AS missing FROM g")
def missing_parts(t):
    m = folds.missing_parts(t("lineitem").where("l_returnflag <> 'R'"), "l_orderkey", "l_linenumber", F.col("l_linenumber"))
    return m.select("l_orderkey", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@query("WITH j AS (SELECT source, toxic IS NOT NULL AS known, CASE WHEN toxic IS NOT NULL THEN toxic = 0 END AS same FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT source, CASE WHEN count(*) = 0 THEN 'missing' WHEN count(same) = 0 THEN 'unsupported' WHEN count(CASE WHEN same THEN 1 END) = count(same) THEN 'ok' ELSE 'failed' END AS verdict FROM j GROUP BY 1")
def integrity_verdict(t):
    j = t("documents").join(t("labels"), "doc_id", "left")
    return j.groupBy("source").agg(*folds.verdict(F.lit(True), F.col("toxic") == 0))


@query("SELECT o_orderkey, array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(coalesce(s, []), x))), ',') AS missing FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT l_returnflag) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def required_missing(t):
    s = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    j = t("orders").select("o_orderkey").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    need = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return j.select("o_orderkey", F.array_join(F.array_sort(F.array_except(need, F.coalesce("s", F.array().cast("array<string>")))), ",").alias("missing"))


@query("SELECT lang, count(*) AS files, count(CASE WHEN quality = 1 THEN 1 END) AS basic, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS full_profile, CASE WHEN count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) = count(*) THEN 'full' WHEN count(CASE WHEN quality = 1 THEN 1 END) > 0 THEN 'partial' ELSE 'none' END AS level FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def compat_ladder(t):
    j = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left").groupBy("lang")
    g = j.agg(F.count("*").alias("files"), F.count_if(F.col("quality") == 1).alias("basic"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("full_profile"))
    return g.withColumn("level", F.when(F.col("full_profile") == F.col("files"), "full").when(F.col("basic") > 0, "partial").otherwise("none"))


# ---------------------------------------------------------------- signal measures


@query("WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events), w AS (SELECT *, greatest(1, c // 8) AS width, least(8, c) AS k FROM n) SELECT user_id, (i // width)::BIGINT AS bucket, max(abs(value)) AS peak FROM w WHERE i < width * k GROUP BY 1, 2")
def waveform_peaks(t):
    return folds.peaks_of(t("events"), "user_id", ["ts", "event_id"], "value", 8).select("user_id", "bucket", "peak")


@query("SELECT event_type, max(abs(value)) AS peak, round(sqrt(avg(value * value)), 4) AS rms FROM events GROUP BY 1")
def peak_rms(t):
    return t("events").groupBy("event_type").agg(F.max(F.abs("value")).alias("peak"), F.round(folds.rms(F.col("value")), 4).alias("rms"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), q AS (SELECT vec_id, v, CASE WHEN v < 0 THEN -floor(abs(v) / 0.01 + 0.5) ELSE floor(abs(v) / 0.01 + 0.5) END * 0.01 AS w FROM x) SELECT vec_id, round(CASE WHEN sum((v - w) * (v - w)) < 1e-20 THEN 120 ELSE 10 * log10(sum(v * v) / sum((v - w) * (v - w))) END, 4) AS snr_db, round(max(abs(v - w)), 6) AS peak_error FROM q GROUP BY 1")
def snr_quantized(t):
    v = t("embeddings").select("vec_id", F.explode("embedding").alias("v")).select("vec_id", F.col("v").cast("double").alias("v"))
    n = F.floor(F.abs("v") / 0.01 + 0.5)
    q = v.withColumn("e", F.col("v") - F.when(F.col("v") < 0, -n).otherwise(n) * F.lit(0.01))
    return q.groupBy("vec_id").agg(F.round(folds.snr(F.col("v"), F.col("e")), 4).alias("snr_db"), F.round(F.max(F.abs("e")), 6).alias("peak_error"))


@query("WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events) SELECT user_id, round(sqrt(avg(x * x)), 4) AS hf_rms FROM d WHERE x IS NOT NULL GROUP BY 1")
def hf_error(t):
    d = scans.lagged(t("events"), ["user_id"], ["ts", "event_id"], "value", ["before"]).withColumn("x", F.col("value") - F.col("before"))
    return d.where("x IS NOT NULL").groupBy("user_id").agg(F.round(folds.rms(F.col("x")), 4).alias("hf_rms"))


@query(
    "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS l, unnest(embedding[2:] || embedding[1:1])::DOUBLE AS r FROM embeddings), "
    "g AS (SELECT label, sum(l * r) / (sqrt(sum(l * l) * sum(r * r)) + 1e-12) AS c, sqrt(avg(((l + r) / 2) ** 2)) AS m, sqrt(avg(((l - r) / 2) ** 2)) AS s FROM x GROUP BY 1) "
    "SELECT label, round(c, 4) AS cosine, round(m, 5) AS mid_rms, round(s, 5) AS side_rms, c > 0.87 AND s < m * 0.42 AND m > 1e-5 AS safe FROM g"
)
def mid_side(t):
    # each entry of a vector with the next, around the end, as left and right
    turned = F.concat(F.slice("embedding", F.lit(2), F.size("embedding")), F.slice("embedding", 1, 1))
    x = t("embeddings").select("label", F.explode(F.arrays_zip(F.col("embedding").alias("l"), turned.alias("r"))).alias("x")).select("label", F.col("x.l").cast("double").alias("l"), F.col("x.r").cast("double").alias("r"))
    g = x.groupBy("label").agg(*lib.likeness(F.col("l"), F.col("r")))
    return g.select("label", F.round("cosine", 4).alias("cosine"), F.round("mid_rms", 5).alias("mid_rms"), F.round("side_rms", 5).alias("side_rms"), lib.mid_side_safe(F.col("cosine"), F.col("mid_rms"), F.col("side_rms")).alias("safe"))



# ---------------------------------------------------------------- windows


@query("WITH e AS (SELECT user_id, event_id, CAST(floor(value * 100) AS BIGINT) AS x, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), l AS (SELECT *, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b, lag(x, 3) OVER w AS c, lag(x, 4) OVER w AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n)) SELECT event_id, x AS r0, coalesce(x - a, x) AS r1, coalesce(x - 2 * a + b, x - a, x) AS r2, coalesce(x - 3 * a + 3 * b - c, x - 2 * a + b, x - a, x) AS r3, coalesce(x - 4 * a + 6 * b - 4 * c + d, x - 3 * a + 3 * b - c, x - 2 * a + b, x - a, x) AS r4 FROM l")
def predictor_residuals(t):
    e = t("events").withColumn("x", F.floor(F.col("value") * 100).cast("long"))
    return folds.residuals(e, "user_id", ["ts", "event_id"], "x").select("event_id", "r0", "r1", "r2", "r3", "r4")


@query("SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS rebuilt FROM events")
def delta_prefix_sum(t):
    e = t("events").withColumn("x", F.floor(F.col("value") * 100).cast("long"))
    r = folds.residuals(e, "user_id", ["ts", "event_id"], "x")
    return folds.rebuilt(r.select("event_id", "user_id", "ts", "r1"), "user_id", ["ts", "event_id"], "r1", "rebuilt").select("event_id", "rebuilt")


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM lineitem")
def chunk_offsets(t):
    x = t("lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return folds.running_offset(x, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"], "q").select("l_orderkey", "l_linenumber", "start_offset")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT - 1 AS repeat_index FROM events")
def repeat_index(t):
    return folds.repeat_index(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "repeat_index")


@query("SELECT o_orderkey, o_orderdate FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE o_orderdate < b")
def seek_monotonic(t):
    return folds.not_rising(t("orders"), "o_custkey", ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_orderdate")


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER w, first_value(turn) OVER w) AS next_item, coalesce(lag(turn) OVER w, last_value(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_item FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def queue_next_prev(t):
    return folds.neighbours(t("conversations").select("conv_id", "turn"), "conv_id", "turn", "turn")


@query("WITH h AS (SELECT user_id, date_trunc('day', ts) AS d, sum(value * value) AS e, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, d, sqrt(sum(e) OVER w / sum(n) OVER w) AS r, count(*) OVER w AS c FROM h WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT user_id, arg_min(d, (r, d)) AS quietest, round(min(r), 4) AS rms FROM s WHERE c = 4 GROUP BY 1")
def quietest_window(t):
    h = t("events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d")).agg(F.sum(F.col("value") * F.col("value")).alias("e"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("d").rowsBetween(0, 3)
    s = h.select("user_id", "d", F.sqrt(F.sum("e").over(w) / F.sum("n").over(w)).alias("r"), F.count("*").over(w).alias("c"))
    return s.where("c = 4").groupBy("user_id").agg(F.min_by("d", F.struct("r", "d")).alias("quietest"), F.round(F.min("r"), 4).alias("rms"))


@query("SELECT name, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS peak FROM events JOIN (VALUES ('open', 0, 400), ('quiet', 200, 900), ('end', 800, 1000000000000)) s(name, low, high) ON event_id >= low AND event_id < high GROUP BY 1")
def named_sections(t):
    e = t("events")
    s = e.sparkSession.createDataFrame([("open", 0, 400), ("quiet", 200, 900), ("end", 800, 10**12)], "name string, low long, high long")
    j = intervals.holding(e, s, "event_id")
    mean = F.avg(F.col("value").cast("decimal(18,4)")).cast("double")  # exact, in whatever order rows come
    return j.groupBy("name").agg(F.count("*").alias("n"), F.round(mean, 4).alias("mean"), F.max("value").alias("peak"))


@query(
    "WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v, round(value) AS d, count(*) OVER (PARTITION BY user_id) AS n FROM events), "
    "s AS (SELECT DISTINCT user_id, i AS start, n FROM x WHERE i % 4 = 0 AND (i + 16 <= n OR n < 16 AND i = 0)), "
    "w AS (SELECT s.user_id, s.start, sum(v * v) AS p, sum((v - d) ** 2) AS e FROM s JOIN x ON x.user_id = s.user_id AND x.i >= s.start AND (x.i < s.start + 16) GROUP BY 1, 2), "
    "r AS (SELECT user_id, start, CASE WHEN e <= 0 THEN 120.0 ELSE least(120.0, 10 * log10(greatest(p, 1e-20) / e)) END AS snr FROM w) "
    "SELECT user_id, round(min(snr), 4) AS worst_snr, arg_min(start, (snr, start))::BIGINT AS start FROM r GROUP BY 1"
)
def sliding_worst(t):
    # values as samples, rounded ones as decoded, windows of 16 at every fourth
    x = scans.row_number(t("events"), ["user_id"], ["event_id"], "n").select("user_id", (F.col("n") - 1).alias("i"), "value", F.round("value").alias("decoded"))
    return lib.worst_window(x, "user_id", "i", "value", "decoded", 16).select("user_id", F.round("worst_snr", 4).alias("worst_snr"), "start")



# ---------------------------------------------------------------- functions


@query("SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), 1, 200) AS clean FROM documents")
def sanitize_text(t):
    return t("documents").select("doc_id", fn.sanitize(F.col("text"), 200).alias("clean"))


@query("SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https?://[^/?#@\\s]+([/?#]\\S*)?$') THEN trim(url) END AS web_url FROM pages")
def url_scheme(t):
    return t("pages").select("page_id", fn.web_url(F.col("url")).alias("web_url"))


@query(
    "WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages) "
    "SELECT page_id, 'http://' || lower(host) || path AS plain, 'https://' || lower(host) || ':8080/a%20b' || path || '?q=%22x%22&k=%C3%A9#%3Ctop%3E' AS odd, NULL::VARCHAR AS with_name FROM p"
)
def url_canonical(t):
    # hosts in capitals, default ports, dot segments, backslashes and signs that are encoded
    host, path = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    p = t("pages").select("page_id", F.upper(host).alias("h"), path.alias("p"))
    plain = F.concat(F.lit(" HTTP:\\\\"), "h", F.lit(":080/x/%2E%2e/."), "p", F.lit("\n"))
    odd = F.concat(F.lit("https:/"), "h", F.lit(":08080/a b"), "p", F.lit('?q="x"&k=é#<top>'))
    return p.select("page_id", fn.web_url(plain).alias("plain"), fn.web_url(odd).alias("odd"), fn.web_url(F.concat(F.lit("http://me:pw@"), "h", "p")).alias("with_name"))


@query("SELECT doc_id, '#' || substr(sha256(text), 1, 6) AS full_color, '#' || repeat(substr(sha256(text), 1, 1), 2) || repeat(substr(sha256(text), 2, 1), 2) || repeat(substr(sha256(text), 3, 1), 2) AS short_color FROM documents")
def hex_color(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.select("doc_id", fn.hex_color(F.concat(F.lit("#"), F.upper(F.substring("h", 1, 8)))).alias("full_color"), fn.hex_color(F.concat(F.lit("#"), F.substring("h", 1, 3))).alias("short_color"))


@query("SELECT event_id, (extract(minute FROM ts) * 60000 + extract(second FROM ts) * 1000)::BIGINT AS ms FROM events")
def timecode_roundtrip(t):
    ms = (F.minute("ts") * 60000 + F.second("ts") * 1000).cast("long")
    return t("events").select("event_id", fn.timecode_ms(fn.timecode(ms)).alias("ms"))


@query("SELECT o_orderkey, (o_totalprice::BIGINT // 60) || ':' || lpad((o_totalprice::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def clock_format(t):
    return t("orders").select("o_orderkey", fn.clock(F.col("o_totalprice")).alias("clock"))


@query("SELECT doc_id, CASE WHEN n_chars * n < 1024 THEN (n_chars * n) || ' B' WHEN n_chars * n < 1048576 THEN printf('%.1f KB', floor(n_chars * n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars * n / 1048576.0 * 10 + 0.5) / 10) END AS size, n FROM documents, (VALUES (1), (1000)) s(n)")
def byte_format(t):
    d = t("documents").select("doc_id", "n_chars", F.explode(F.array(F.lit(1), F.lit(1000))).alias("n"))
    return d.select("doc_id", fn.byte_size(F.col("n_chars") * F.col("n")).alias("size"), "n")



@query("SELECT doc_id, sha256(text) AS fingerprint, substr(sha256(text), 1, 12) || '…' AS preview, lower(sha256(text)) = upper(sha256(text)) OR sha256(text) = lower(upper(sha256(text))) AS same FROM documents")
def hash_fields(t):
    h = F.sha2("text", 256)
    return t("documents").select("doc_id", fn.hash_or_null(F.upper(h)).alias("fingerprint"), fn.preview(h).alias("preview"), fn.same_hash(h, F.upper(h)).alias("same"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.session') AS session FROM events")
def json_normalize(t):
    return t("events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.session").alias("session"))



@query("SELECT p_partkey, p_partkey % 100 AS n FROM part")
def track_from_name(t):
    name = F.concat(F.lit("Album/"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(" - "), F.col("p_name"))
    return t("part").select("p_partkey", fn.track_number(name).cast("long").alias("n"))
