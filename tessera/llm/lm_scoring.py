"""Language-model scoring by cross-entropy difference.

Two bigram models that back off to unigrams are counted over whole texts: the target model on documents labelled good
(quality 1, not toxic), the background model on all documents. A document is scored by models that haven't seen it: its own counts are taken
out of the background's, and out of the target's if it is one of the target's documents. So a good document scores alike whether or not its label was known.

The models are matched: they share one vocabulary, the lower-cased words of all documents, and the background's counts are scaled to the
target's number of tokens before both are smoothed alike (EVEN of the unigrams' mass is spread evenly over the words; a context's bigrams have the weight of
their count against BACKOFF tokens of the unigram model). So the difference doesn't measure which model is larger, though the background is counted
over every document. A document's score is the mean over its tokens of target loss minus background loss, in bits: the lower, the more it resembles the target.

Each word, context and bigram has a count of its own, under its 64-bit hash; there are as many as the input has. Documents are
written in chunks of CHUNK text bytes. A chunk sends its distinct hashes with their counts to ranges of the hash space (RANGE text
bytes each, so a range doesn't grow with the input), where they are added up; each range sends the totals of what a chunk asked for back
to the chunk, in the order of the chunk's hashes. So a common word is one entry per chunk, and nothing but a few sums is collected.
Every token of every document is counted and scored.

Null and empty texts have no tokens, and null losses and score. The context of a text's first word is the text's start. A
doc_id whose labels differ is target if any label says so. Rows that repeat a doc_id count as often as they occur.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, mix, slices, table, words

#: Text bytes of a chunk, and of the documents per range of the hash space.
CHUNK, RANGE = 8_000_000, 24_000_000
#: The share of each unigram model that is spread evenly over the words, and the tokens that the unigrams count for in each context.
EVEN, BACKOFF = 0.01, 4.0
START = np.uint64(0x5851F42D4C957F2D)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: hashes of the word, its context and the bigram; text."""
    w, text = words(data, off)
    before = np.empty_like(w)
    if len(w):
        before[0], before[1:] = START, w[:-1]
        first = np.ones(len(w), bool)
        first[1:] = text[1:] != text[:-1]
        before[first] = START
    return w, before, mix(before * np.uint64(0x9E3779B97F4A7C15) + w), text


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed: all first bytes, all second bytes, and so on."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


def _chunks(batches):
    """Slices of the documents as compressed Arrow streams, under a name of their own."""
    for batch in batches:
        for part, data, _ in slices(batch, most=CHUNK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_pydict({"chunk": [uuid.uuid4().hex], "size": pa.array([len(data)], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _tokens_of(blob: bytes):
    """The documents of a chunk, the three kinds of hashes of its tokens, and the tokens' texts."""
    part = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
    _, data, off = next(slices(part, most=1 << 62))
    *kinds, text = tokens(data, off)
    return part, kinds, text


def _asked(ranges: int):
    """Per chunk, kind and range of the hash space: the distinct hashes (as differences) and the chunk's counts of each."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk"), batch.column("docs"), strict=True):
                part, kinds, text = _tokens_of(blob.as_py())
                target = part.column("target").to_numpy(zero_copy_only=False).astype(bool)[text]
                rows = []
                for kind, x in enumerate(kinds):
                    order = np.argsort(x)
                    x = x[order]
                    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
                    good = np.add.reduceat(target[order], at, dtype=np.int64) if len(x) else at
                    n, x = np.diff(np.append(at, len(x))), x[at]
                    cut = np.concatenate(([0], np.searchsorted(x, edges), [len(x)]))
                    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                        if b > a:
                            rows.append((chunk.as_py(), kind, i, b - a, pack(np.diff(x[a:b], prepend=np.uint64(0))), pack(good[a:b]), pack(n[a:b])))
                if rows:
                    yield _rows(rows, ASKED)

    return run


ASKED = "chunk string, kind int, part int, n long, hashes binary, target binary, background binary"
TOTALS = "chunk string, kind int, part int, n long, all_target long, all_background long, target binary, background binary"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _runs(batches, *key: str):
    """Rows, as dicts, of each run of equal keys; input sorted by them."""
    last, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (k := tuple(r[c] for c in key)) != last:
                if rows:
                    yield last, rows
                last, rows = k, []
            rows.append(r)
    if rows:
        yield last, rows


def _total(batches):
    """Per range and kind: the totals of the hashes of each chunk, and a row without a chunk with the number and sums of the distinct ones."""
    for (part, kind), rows in _runs(batches, "part", "kind"):
        cut = np.cumsum([0] + [r["n"] for r in rows])
        x = np.concatenate([np.cumsum(unpack(r["hashes"], r["n"]), dtype=np.uint64) for r in rows])
        order = np.argsort(x, kind="stable")
        x = x[order]
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        times, sides, sums = np.diff(np.append(at, len(x))), [], []
        for side in ("target", "background"):
            n = np.concatenate([unpack(r[side], r["n"]) for r in rows])
            sums.append(int(n.sum()))
            whole = np.empty_like(n)
            whole[order] = np.repeat(np.add.reduceat(n[order], at), times)
            sides.append(whole)
        out = [(r["chunk"], kind, part, r["n"], None, None, *(pack(s[a:b]) for s in sides)) for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True)]
        yield _rows([(None, kind, part, len(at), *sums, None, None), *out], TOTALS)


def losses(one, seen, pairs, total, scale, size: float) -> np.ndarray:
    """Bits of tokens with these counts of the word, its context and the bigram, in models of `total` tokens over `size` words; scale: what a token of a context counts for."""
    some = np.maximum(total, 1)
    p = np.where(total > 0, (one / some + EVEN / max(size, 1)) / (1 + EVEN), 1 / max(size, 1))
    return -np.log2((pairs * scale + BACKOFF * p) / (seen * scale + BACKOFF))


def own_counts(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of each token: how many tokens of its text have its hash."""
    order = np.lexsort((x, text))
    a, b = x[order], text[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(x) else np.zeros(0, np.int64)
    times, out = np.diff(np.append(first, len(x))), np.empty(len(x), np.int64)
    out[order] = np.repeat(times, times)
    return out


def _score(totals: tuple[float, float], size: float):
    def run(batches):
        for _, (docs, *answers) in _runs(batches, "chunk"):
            part, kinds, text = _tokens_of(docs["docs"])
            m = part.num_rows
            n = np.bincount(text, minlength=m)
            inside = part.column("target").to_numpy(zero_copy_only=False).astype(bool)[text]
            sides = [[], []]
            for kind, x in enumerate(kinds):
                got = [r for r in answers if r["kind"] == kind]
                _, at = np.unique(x, return_inverse=True)
                own = own_counts(x, text)
                for counts, side in zip(sides, ("target", "background"), strict=True):
                    whole = np.concatenate([unpack(r[side], r["n"]) for r in got]) if got else np.zeros(0, np.uint64)
                    counts.append(whole.astype(np.float64)[at] - (own * inside if side == "target" else own))
            target, background = totals[0] - n[text] * inside, totals[1] - n[text]
            each = [losses(*sides[0], target, 1.0, size), losses(*sides[1], background, target / np.maximum(background, 1), size)]
            t, b, d = (np.bincount(text, x, m) / np.maximum(n, 1) for x in (*each, each[0] - each[1]))
            none = n == 0
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *(pa.array(x, mask=none) for x in (t, b, d))], ["doc_id", "n_tokens", "target_bits", "background_bits", "score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, target (boolean). Per row: doc_id, n_tokens, target_bits and background_bits (means per token), score (their difference)."""
    chunks = materialize(docs.mapInArrow(_chunks, "chunk string, size long, docs binary"), "chunks")
    ranges = max(1, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // RANGE))
    asked = chunks.select("chunk", "docs").mapInArrow(_asked(ranges), ASKED)
    totals = materialize(asked.repartition("part", "kind").sortWithinPartitions("part", "kind", "chunk").mapInArrow(_total, TOTALS), "totals")
    found = totals.where("chunk IS NULL AND kind = 0").agg(F.sum("all_target"), F.sum("all_background"), F.sum("n")).first()
    target, background, n_words = (float(x or 0) for x in found)
    nothing = F.lit(None).cast("binary")
    answers = totals.where("chunk IS NOT NULL").select("chunk", "kind", "part", "n", nothing.alias("docs"), "target", "background")
    both = answers.unionByName(chunks.select("chunk", F.lit(-1).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), "docs", nothing.alias("target"), nothing.alias("background")))
    run = _score((target, background), n_words)
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind", "part").mapInArrow(run, "doc_id long, n_tokens long, target_bits double, background_bits double, score double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    # labels grow with the documents: one plan at every size, by shuffle on both sides
    return score(docs.join(good.hint("merge"), docs.doc_id == good._id, "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
