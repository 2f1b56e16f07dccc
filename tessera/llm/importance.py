"""Importance resampling towards a target: hashed n-gram features, integer weights, and the exact highest scores by a histogram.

1. Words are runs of characters other than ASCII signs, A to Z lower-cased; features are all runs of 1 to 3 words, joined by a space,
   counted by the CRC-32 of their bytes modulo BUCKETS. A task adds up its own array; BUCKETS sums of the corpus and of the target reach
   the driver and become an array of integer gains.
2. A document's weight is the sum of its features' gains; its score adds noise of its own (Gumbel, from its doc_id's hash).
3. A histogram of the integer scores is summed up from the highest down, range by range, so each score knows how many rows stand above it.
   The lowest score with room is the cutoff; only rows from there up are ranked, by doc_id within their score. A score of more than
   PART rows is counted, and ranked, by doc_id and part as well, so no task ranks more than that many rows.

A feature's CRC is made from those of its words: the CRC of a + b is that of a, moved on by b's length, xor that of b; so a text of any
length is read once, in windows, with arrays that follow the window.

Null and empty texts have no words: no features, weight 0. A null doc_id's noise is that of the empty name, and it comes last among equal scores. Repeated rows
are rows of their own: of rows with the same score and doc_id any may come first, since they are alike in all that is returned. Without a target all t are 0. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WINDOW, lowered, materialize, runs, slices, table
from tessera.operators.ranking import sums_before

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, (5, 100), 42
#: Rows of one score that are ranked together.
PART = 1_000_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 48
#: The reflected CRC-32 polynomial (fixed).
POLYNOMIAL = 0xEDB88320


# ---------------------------------------------------------------- CRC-32 of many strings at once


@cache
def _step() -> np.ndarray:
    """What a byte does to the register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


@cache
def _moves() -> list[np.ndarray]:
    """For each k the linear map of a register by 2**k zero bytes, as four tables of its bytes' images."""

    def tables(apply) -> np.ndarray:
        return np.stack([apply(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])

    out = [tables(lambda c: _step()[c & 255] ^ (c >> 8))]
    for _ in range(40):
        out.append(tables(lambda c, t=out[-1]: _apply(t, _apply(t, c))))
    return out


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc (uint32) after n further zero bytes, without the final inversion's share: moved(crc(a), len(b)) ^ crc(b) is crc(a + b)."""
    crc = crc.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> k & 1)
        crc[at] = _apply(_moves()[k], crc[at])
    return crc


def crc_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of data."""
    length, out = end - start, np.empty(len(start), np.uint32)
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    short = np.flatnonzero(length <= LONG_WORD)
    short = short[np.argsort(-length[short], kind="stable")]
    at, sizes = start[short], length[short]
    state, step = np.full(len(short), 0xFFFFFFFF, np.uint32), _step()
    for j in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -j, "left"))  # those longer than j
        c = state[:n]
        state[:n] = step[(c ^ data[at[:n] + j]) & 255] ^ (c >> 8)
    out[short] = ~state
    return out


# ---------------------------------------------------------------- features


@cache
def _inside() -> np.ndarray:
    """True for the bytes of words: digits, a to z and all beyond ASCII."""
    out = np.zeros(256, bool)
    out[48:58] = out[97:123] = out[128:] = True
    return out


def _windows(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Lower-cased bytes, offsets, and whether they go on with the text before: short texts whole, a long one in windows that end between words."""
    if len(data) <= 2 * WINDOW or len(off) > 2:
        yield lowered()[data], off, False
        return
    a = 0
    while a < len(data):
        b = min(a + WINDOW, len(data))
        if b < len(data):
            gaps = np.flatnonzero(~_inside()[lowered()[data[a:b]]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:  # a word longer than the window
                while b < len(data) and _inside()[lowered()[data[b : b + WINDOW]]].all():
                    b += WINDOW
                b = min(len(data), b)
                if b < len(data):
                    b += int(np.argmin(_inside()[lowered()[data[b : b + WINDOW]]]))
        yield lowered()[data[a:b]], np.array([0, b - a]), a > 0
        a = b


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each window: the words' text numbers, and (text numbers, CRCs) of the runs of 1, 2 and 3 words that end in it."""
    kept = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    space = np.uint32(zlib.crc32(b" "))
    for low, cut, goes_on in _windows(data, off):
        start, end, text = runs(_inside()[low], cut)
        crc, length = crc_spans(low, start, end), end - start
        skip = len(kept[0]) if goes_on else 0
        if skip:
            crc, length, text = np.concatenate((kept[0], crc)), np.concatenate((kept[1], length)), np.concatenate((np.zeros(skip, text.dtype), text))
        spaced = moved(np.full(len(crc), space), length) ^ crc
        out, run = [(text[skip:], crc[skip:])], crc
        for k in range(1, LONGEST):
            run = moved(run[:-1], length[k:] + 1) ^ spaced[k:]
            keep = text[: len(run)] == text[k:]
            keep[: max(0, skip - k)] = False
            out.append((text[: len(run)][keep], run[keep]))
        kept = crc[-(LONGEST - 1) :], length[-(LONGEST - 1) :]
        yield text[skip:], out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, off in slices(batch):
                for _, grams in features(data, off):
                    for _, crc in grams:
                        total += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of how much likelier it is in the target), both counts smoothed by one."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per document: doc_id, n_words, n_features and weight, the sum of its features' gains."""

    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch):
                n = rows.num_rows
                words, count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                for of_words, grams in features(data, off):
                    words += np.bincount(of_words, minlength=n)
                    for text, crc in grams:
                        count += np.bincount(text, minlength=n)
                        weight += np.bincount(text, gain[crc % len(gain)], n)  # whole numbers far under 2**53
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(words), pa.array(count), pa.array(weight.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


# ---------------------------------------------------------------- the draw


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights and score: weight + floor(1000 * Gumbel noise), the noise from the SHA-256 of `seed:doc_id`."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weights.withColumn("score", F.col("weight") + noise)


def draw(rows: DataFrame, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """rows (doc_id, n_words, score; read twice, so written before) and rank: 1, 2, 3... by falling score, ties to the smaller doc_id, of the
    floor(share * N) highest of the N rows with enough words; null for the others."""
    spark = rows.sparkSession
    able = F.col("n_words") >= least_words
    n_able = rows.where(able).count()
    most = share[0] * n_able // share[1]
    # a score of more than PART rows, of which there are n_able / PART at most, is counted by doc_id and part
    hot = [(r.score, -(-r.n // PART)) for r in rows.where(able).groupBy("score").agg(F.count("*").alias("n")).where(F.col("n") > PART).collect()]
    keyed = rows.where(able)
    if hot:
        keyed = keyed.join(F.broadcast(spark.createDataFrame(hot, "score long, parts int")), "score", "left")
        keyed = keyed.withColumn("named", F.when(F.col("parts").isNotNull(), F.col("doc_id"))).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        keyed = materialize(keyed, "keyed")
    else:
        keyed = keyed.withColumns({"named": F.lit(None).cast("long"), "part": F.lit(0)})
    key = ["score", "named", "part"]
    histogram = keyed.groupBy(*key).agg(F.count("*").alias("n"))
    order = [F.col("score").desc(), F.col("named").asc_nulls_last(), F.col("part")]
    above = materialize(sums_before(histogram, order, F.col("n"), "above").where(F.col("above") < most), "above")
    cutoff = above.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    spots = above.select(F.col("score").alias("_s"), F.col("named").alias("_n"), F.col("part").alias("_p"), "above")
    same = (F.col("score") == F.col("_s")) & F.col("named").eqNullSafe(F.col("_n")) & (F.col("part") == F.col("_p"))
    inside = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last())
    top = keyed.where(F.col("score") >= cutoff).join(spots, same, "left").withColumn("place", F.col("above") + F.row_number().over(inside))
    top = top.withColumn("rank", F.when(F.col("place") <= most, F.col("place")).cast("long")).select(*rows.columns, "rank")
    rest = rows.where(~F.coalesce(able & (F.col("score") >= cutoff), F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """Per document of docs: doc_id, n_words, n_features, weight, score and rank (null if not drawn), towards the texts of target."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return draw(materialize(scored(weighed(docs, gain), seed), "scored"), least_words, share)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
