"""Chat formatting by perspective rotation: each dialogue once per participant, with that speaker as the assistant.

A message is rendered as "<|im_start|>HEAD\\n", the text, "<|im_end|>\\n". HEAD is "assistant" for the speaker whose view it is, "user
name=SPEAKER" for the others, and "system" for the role system, which is nobody's view. The mask has the character spans that the
loss counts: the assistant's texts with their end marks. In texts and speakers' names "<|" becomes "< |", and a line break in a name a space, so that no message
can open or close a turn.

A row is a block of at most TURNS messages of one dialogue in one view; a dialogue of up to TURNS messages is one row per view, a longer one
has more rows (block 0, 1, ...), so a dialogue that holds a third of all rows is no row or task of its own. start is where a block's
text begins in the view's whole rendering, which is the blocks' texts one after another; a mask's spans count from there. Messages are
numbered without windows over whole dialogues: rows are sorted by range, each range counts its own, and the counts of the
ranges that a dialogue spans are added up.

Messages are in the order of turn (nulls first), then role, then text; repeated rows are messages. A null text is empty; a null role speaks
as "unknown". A null conv_id is a dialogue of its own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _apart(c: Column) -> Column:
    """A text in which no mark begins."""
    return F.replace(c.cast("string"), F.lit("<|"), F.lit("< |"))


def numbered(messages: DataFrame) -> DataFrame:
    """messages and n, each one's number in its dialogue, from 0."""
    spark = messages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    placed = materialize(messages.repartitionByRange(tasks, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("conv_id", "range").agg(F.count("*").alias("c"))
    # a row per dialogue and range that has some of it
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).where("before > 0")
    here = placed.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")) - 1)
    old = before.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), "before")
    return here.join(old, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")), "left").select(*messages.columns, (F.col("n") + F.coalesce("before", F.lit(0))).cast("long").alias("n"))


def rotate(messages: DataFrame, turns: int = TURNS) -> DataFrame:
    """messages (conv_id, turn, role, text): conv_id, speaker, block, n_messages, start, text, mask (spans "start-end", joined by commas)."""
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.replace(_apart(F.col("role")), F.lit("\n"), F.lit(" ")), F.lit("unknown")).alias("role"), F.coalesce(_apart(F.col("text")), F.lit("")).alias("text"))
    placed = materialize(numbered(messages).withColumn("block", F.floor(F.col("n") / turns).cast("int")), "numbered")
    blocks = placed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("m"))  # turns messages at most
    views = messages.where("role <> 'system'").select(F.col("conv_id").alias("_c"), F.col("role").alias("speaker")).distinct()
    both = blocks.join(views, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def head(x: Column) -> Column:
        return F.when(x.role == F.col("speaker"), F.lit("assistant")).when(x.role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), x.role))

    parts = F.transform("m", lambda x: F.struct(F.concat(F.lit(OPEN), head(x), F.lit("\n")).alias("head"), F.concat(x.text, F.lit(CLOSE)).alias("body"), (x.role == F.col("speaker")).alias("own")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc.at + F.length(x.head)
        end = start + F.length(x.body)
        return F.struct(end.alias("at"), F.when(x.own, F.concat(acc.spans, F.array(F.concat_ws("-", start, end)))).otherwise(acc.spans).alias("spans"))

    out = both.withColumn("parts", parts)
    # a row per dialogue and block: how long its texts are in a view, but for the heads, which differ by view
    lengths = placed.groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "role").agg(F.count("*").alias("k"), F.sum(F.length("text")).alias("size"))
    lengths = lengths.join(views.select(F.col("_c").alias("_v"), "speaker"), F.col("_c").eqNullSafe(F.col("_v")))
    marks = len(OPEN) + 1 + len(CLOSE)
    named = F.when(F.col("role") == F.col("speaker"), len("assistant")).when(F.col("role") == "system", len("system")).otherwise(F.length("role") + len("user name="))
    lengths = lengths.groupBy("_c", "_b", "speaker").agg(F.sum(F.col("size") + F.col("k") * (named + marks)).alias("size"))
    earlier = Window.partitionBy("_c", "speaker").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("_c", "_b", F.col("speaker").alias("_s"), F.coalesce(F.sum("size").over(earlier), F.lit(0).cast("long")).alias("start")).where("start > 0")
    out = out.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")) & (F.col("speaker") == F.col("_s")), "left")
    return out.select("conv_id", "speaker", "block", F.size("m").cast("long").alias("n_messages"), F.coalesce("start", F.lit(0).cast("long")).alias("start"), F.array_join(F.transform("parts", lambda x: F.concat(x.head, x.body)), "").alias("text"), F.array_join(F.aggregate("parts", zero, add).spans, ",").alias("mask"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH m AS (SELECT conv_id, turn, coalesce(replace(replace(role, '<|', '< |'), chr(10), ' '), 'unknown') AS role, coalesce(replace(text, '<|', '< |'), '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n FROM m),
v AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
p AS (SELECT n.conv_id, speaker, (n // 256)::INT AS block, n, role = speaker AS own,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
    text || '<|im_end|>' || chr(10) AS body
  FROM n JOIN v ON n.conv_id IS NOT DISTINCT FROM v.conv_id),
q AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, block ORDER BY n) AS stop,
    sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY n) - length(head) - length(body) AS place FROM p)
SELECT conv_id, speaker, block, count(*) AS n_messages, min(place)::BIGINT AS start, string_agg(head || body, '' ORDER BY n) AS text,
  coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY n) FILTER (WHERE own), '') AS mask
FROM q GROUP BY 1, 2, 3
"""
