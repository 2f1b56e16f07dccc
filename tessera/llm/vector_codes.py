"""Product codes of vectors: weighted Lloyd over the distinct integer parts of each position, codes joined back to the vectors.

Vectors become integers (floor(scale * x)) and are cut into equal consecutive parts. Equal parts of a position are one row with a
weight, so a vector that a third of all rows share costs as much as any other. Each round reads the distinct rows once; a task adds up
weight and components per entry of the codebook, and only these sums (positions * entries rows) reach the driver. Codes and
errors of the distinct rows are then joined back on position and part, hot parts by a broadcast of at most skew.SHARE rows.

The codebook of a position begins as that part of the vectors with the smallest vec_ids (null ids last, ties by the integers); fewer vectors
make a smaller codebook. All sums are exact in 64 bits: components beyond +-2^b are clamped to it, where b = (60 - log2 of the dimension) / 2
is the largest with which no error can overflow (27 at 64 dimensions, so only components of more than 32,768 are touched).

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of another length than the longest, or a length that the number
of parts doesn't divide, are filled with zeros. Repeated rows and vec_ids are rows of their own. Labels may be null: nulls share one sum.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.operators import skew

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Distinct parts that are compared with a codebook at once.
AT_ONCE = 4096


def integer_vectors(rows: DataFrame, parts: int = PARTS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """Kept rows: row (a number of its own, ascending within a file only), vec_id, label and values (array<int>, all of one length that parts divides)."""
    kept = rows.select("vec_id", "label", F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(parts, -(-longest // parts) * parts)
    most = 1 << int((60 - np.log2(width)) // 2)
    integers = F.transform("v", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x)) * scale))).cast("int"))
    fill = F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.concat(integers, fill).alias("values"))


def cut(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """A row per part of each vector: row, vec_id, label, position (from 0), part."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("values", i * width + 1, width))
    return vectors.select("row", "vec_id", "label", F.posexplode(pieces).alias("position", "part"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of part the index of the nearest row of book (the lowest of equals) and its squared distance, exact in int64."""
    index, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for a in range(0, len(part), AT_ONCE):
        gap = part[a : a + AT_ONCE, None, :] - book[None]
        square = np.einsum("ijk,ijk->ij", gap, gap)
        index[a : a + AT_ONCE] = square.argmin(1)
        error[a : a + AT_ONCE] = square.min(1)
    return index, error


def _by_position(batch: pa.RecordBatch, books: np.ndarray):
    """position, rows of the batch, matrix of their parts, their codes and errors, for each position that the batch has."""
    position, part = batch.column("position").to_numpy(), _matrix(batch.column("part"), books.shape[2])
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        yield int(p), at, part[at], *nearest(part[at], books[p])


def sums(distinct: DataFrame, books: np.ndarray) -> list:
    """Per position and entry: weight and weighted sum of the distinct parts that are nearest to it."""

    def run(batches):
        weight, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            n = b.column("weight").to_numpy()
            for p, at, part, code, _ in _by_position(b, books):
                np.add.at(weight[p], code, n[at])
                np.add.at(total[p], code, part * n[at][:, None])
        p, e = np.nonzero(weight)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(weight[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["position", "entry", "weight", "total"])

    found = distinct.mapInArrow(run, "position int, entry int, weight long, total array<long>")
    each = [F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(books.shape[2])]
    return found.groupBy("position", "entry").agg(F.sum("weight").alias("weight"), *each).collect()  # positions * entries rows


def train(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component) after so many rounds: entries become the floor of their parts' mean; unused ones stay."""
    for _ in range(rounds):
        books = books.copy()
        for r in sums(distinct, books):
            books[r.position, r.entry] = [t // r.weight for t in r[3:]]
    return books


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """distinct with code and error."""

    def run(batches):
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for _, at, _, c, e in _by_position(b, books):
                code[at], error[at] = c, e
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array(error)], [*b.schema.names, "code", "error"])

    return distinct.mapInArrow(run, "position int, part array<int>, weight long, code int, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Per kept row: vec_id, label, codes (array<int>, a code per part) and error; and the codebooks (position, entry, component)."""
    vectors = materialize(integer_vectors(rows, parts, scale), "vectors")
    first = vectors.select("vec_id", "values").orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(entries).collect()
    if not first:
        return vectors.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 1), np.int64)
    start = np.array([r["values"] for r in first], np.int64)
    width = start.shape[1] // parts
    pieces = cut(vectors, parts, width)
    distinct = materialize(pieces.groupBy("position", "part").agg(F.count("*").alias("weight")), "parts")
    books = train(distinct, start.reshape(len(start), parts, width).transpose(1, 0, 2), rounds)
    found = skew.lookup(pieces, materialize(coded(distinct, books), "codes"), ["position", "part"], ["code", "error"], "weight")
    each = found.groupBy("row", "vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("position", "code"))).alias("c"), F.sum("error").alias("error"))  # a row per part
    return each.select("vec_id", "label", F.col("c.code").alias("codes"), "error"), books


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    out = materialize(out, "coded")
    by_label = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return skew.lookup(out, by_label, ["label"], ["label_error"], "n").select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds written out one after another."""
    gap = "list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assign(r: int) -> str:
        return f"a{r} AS MATERIALIZED (SELECT p.n, p.pos, arg_min(b.entry, ({gap}) * 16 + b.entry) AS entry, min({gap}) AS err FROM parts p JOIN b{r} b USING (pos) GROUP BY p.n, p.pos)"

    steps = []
    for r in range(ROUNDS):
        steps.append(assign(r))
        mean = f"SELECT pos, entry, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT a.pos, a.entry, unnest(p.part) AS v, unnest(range(len(p.part))) AS i FROM a{r} a JOIN parts p USING (n, pos)) GROUP BY pos, entry, i"
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM b{r} b LEFT JOIN (SELECT pos, entry, list(v ORDER BY i) AS part FROM ({mean}) GROUP BY pos, entry) m USING (pos, entry))")
    steps.append(assign(ROUNDS))
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT n, pos, v[pos * len(v) // 8 + 1:(pos + 1) * len(v) // 8] AS part FROM kept, range(8) t(pos)
), b0 AS MATERIALIZED (SELECT pos, n - 1 AS entry, part FROM parts WHERE n <= 16),
{", ".join(steps)},
coded AS (SELECT n, string_agg(printf('%02x', entry::INT), '' ORDER BY pos) AS code, CAST(sum(err) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY n),
books AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (n), books
"""


ORACLE = _oracle()
