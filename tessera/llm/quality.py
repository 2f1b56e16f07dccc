"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text come from its bytes alone. Each has a lookup table over quantile bins; shallow trees, boosted in turn for one
feature after another on the logistic loss, are added into the tables. Pairs of features are then ranked by how much of the
remaining gradient a two-way split takes, and the best get tables of their own. A score is the sum of table entries through
the logistic function.

The model is fitted on at most SAMPLE labelled rows, chosen by the hash of doc_id before their features are computed; scores cover
every row, in one pass. Labels of one doc_id that differ count as their minimum; null labels don't count. Of rows that repeat
a labelled doc_id the one whose text has the least hash counts. With one class or no labels the score is the same for all rows:
the share of label 1 (0.5 without labels).

Null and empty texts have zero features and a score. Repeated rows have equal scores. A null doc_id has no label and is not
held out. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hash_spans, lowered, materialize, plain_names, runs, slices, spaces, table

SAMPLE, BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 40_000, 48, 12, 120, 60, 8, 0.15
THRESHOLD = 0.7
NAMES = ["log_words", "word_bytes", "upper", "digits", "marks", "symbols", "bangs", "pipes", "symbol_ends", "capitals", "shouted", "distinct_words", "repeated_lines", "sentence_ends", "non_ascii", "line_words", "word_spread", "worst_line"]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*chars]] = True
    return out


UPPER, LOWER, DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789")
MARK, SYMBOL, HIGH = _mask(b".,;:?'\"-"), _mask(b"!#$%&()*+/<=>@[\\]^_`{|}~"), _mask(bytes(range(128, 256)))


def _distinct(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[new], minlength=n)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) numbers per text."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)), np.float64)
    if not len(data):
        return out

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (c[off[1:]] - c[off[:-1]]).astype(float)

    filled = ~spaces()[data]
    start, end, text = runs(filled, off)
    n_words, n_filled = np.bincount(text, minlength=n).astype(float), per_text(filled)
    w, c = np.maximum(n_words, 1), np.maximum(n_filled, 1)
    upper = UPPER[data]
    letters = per_text(upper | LOWER[data])
    of_words = lambda x: np.bincount(text[x], minlength=n) / w
    size = (end - start).astype(float)
    ups = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
    lows = np.concatenate(([0], np.cumsum(LOWER[data], dtype=np.int64)))
    up, low = ups[end] - ups[start], lows[end] - lows[start]
    symbols = SYMBOL[data]
    flat = lowered()[data]
    line_start, line_end, line_text = runs(data != 10, off)
    lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    mean = np.bincount(text, size, minlength=n) / w
    bad = np.concatenate(([0], np.cumsum(symbols | upper, dtype=np.int64)))
    share = (bad[line_end] - bad[line_start]) / np.maximum(line_end - line_start, 1)
    worst = np.zeros(n)
    np.maximum.at(worst, line_text, np.where(line_end - line_start >= 40, share, 0))
    out[:, 0] = np.log1p(n_words)
    out[:, 1] = mean
    out[:, 2] = per_text(upper) / np.maximum(letters, 1)
    out[:, 3] = per_text(DIGIT[data]) / c
    out[:, 4] = per_text(MARK[data]) / c
    out[:, 5] = per_text(symbols) / c
    out[:, 6] = per_text(data == 33) / c
    out[:, 7] = per_text(data == 124) / w
    out[:, 8] = of_words(symbols[end - 1])
    out[:, 9] = of_words(upper[start])
    out[:, 10] = of_words((up > 1) & (low == 0))
    out[:, 11] = _distinct(hash_spans(flat, start, end), text, n) / w
    out[:, 12] = 1 - _distinct(hash_spans(flat, line_start, line_end), line_text, n) / lines
    out[:, 13] = per_text((data == 46) | (data == 63)) / w
    out[:, 14] = per_text(HIGH[data]) / c
    out[:, 15] = np.log1p(n_words / lines)
    out[:, 16] = np.sqrt(np.maximum(np.bincount(text, size * size, minlength=n) / w - mean * mean, 0))
    out[:, 17] = worst
    return out


def _describe(batches):
    for batch in batches:
        for part, data, off in slices(batch):
            x = features(data, off)
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "y", "h")), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), flat)], ["doc_id", "y", "h", "x"])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            f += t[np.searchsorted(e, x[:, k], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            f += t[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """The cut of bins [low, high) that gains most: gain, first bin of the right side."""
    if high - low < 2:
        return 0.0, -1
    cg, ch = np.cumsum(g[low:high]), np.cumsum(h[low:high])
    left = cg[:-1] ** 2 / (ch[:-1] + 1)
    right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
    gain = left + right - cg[-1] ** 2 / (ch[-1] + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), low + k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A tree over ordered bins, grown best first: each bin's leaf value."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, at = max((*_best_cut(g, h, *p), i) for i, p in enumerate(parts))
        if gain <= 1e-9:
            break
        low, high = parts[at]
        parts[at : at + 1] = [(low, cut), (cut, high)]
    out = np.zeros(len(g))
    for low, high in parts:
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut of the first feature and one of the second on either side, or the other way about: gain, leaf values."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, cut = _best_cut(a.sum(1), b.sum(1), 0, len(a))
        for row in range(1, len(a)) if cut < 0 else {cut, len(a) // 2} - {0}:
            out, gain = np.zeros_like(a), 0.0
            for side in (slice(0, row), slice(row, None)):
                _, col = _best_cut(a[side].sum(0), b[side].sum(0), 0, a.shape[1])
                for part in (slice(0, col), slice(col, None)) if col > 0 else (slice(None),):
                    s, t = a[side, part].sum(), b[side, part].sum()
                    out[side, part] = s / (t + 1)
                    gain += s * s / (t + 1)
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(0.0)
    share = float(y.mean())
    if not 0 < share < 1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.log(share / (1 - share)))
    m = Model(np.log(share / (1 - share)), [_edges(c, BINS) for c in x.T], pair_edges=[_edges(c, PAIR_BINS) for c in x.T])
    bins = [np.searchsorted(e, c, "right") for e, c in zip(m.edges, x.T, strict=True)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    f = np.full(len(y), m.base)

    def gradient():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = gradient()
            step = RATE * _tree(np.bincount(b, g, len(m.tables[k])), np.bincount(b, h, len(m.tables[k])))
            m.tables[k] += step
            f += step[b]
    wide = [np.searchsorted(e, c, "right") for e, c in zip(m.pair_edges, x.T, strict=True)]
    size = [len(e) + 1 for e in m.pair_edges]
    g, h = gradient()

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[i] * size[j] + wide[j], v, size[i] * size[j]).reshape(size[i], size[j])

    ranked = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(size)) for j in range(i)), reverse=True)
    m.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    m.pair_tables = [np.zeros((size[i], size[j])) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(m.pairs):
            g, h = gradient()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            m.pair_tables[k] += step
            f += step[wide[i], wide[j]]
    return m


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on rows of docs with labels(doc_id, quality) that are not held out, `sample` of them at most."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna().where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    known = materialize(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")), "known")
    # hashes are even over 2**64: below this one there are fewer than `sample` of n, but for four standard deviations
    n, least = known.count(), -(1 << 63)
    share = 1.0 if n <= sample else max(sample - 4 * sample**0.5, sample / 2) / n
    some = known.where(F.col("h") <= min(least + int(share * 2.0**64), (1 << 63) - 1)).select("doc_id", "y")
    some = docs.join(F.broadcast(some), "doc_id")  # at most `sample` rows of two numbers
    described = some.withColumn("h", F.xxhash64("text")).mapInArrow(_describe, "doc_id long, y int, h long, x array<double>")
    got = described.groupBy("doc_id").agg(F.min(F.struct("h", "x", "y")).alias("r")).orderBy("doc_id").select("r.x", "r.y").toArrow().combine_chunks()
    # Arrow columns, so that the driver holds numbers and not an object for each of them
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    return fit(x, got.column("y").to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(docs, labels, sample)

    def run(batches):
        for batch in batches:
            for part, data, off in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(features(data, off)))], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects. Each row is scored by its own text, whatever its doc_id. Without any label that counts no row is rejected."""
    model, plain = train(docs, labels), plain_names(docs)
    if not model.tables and model.base == 0:
        return docs

    def run(batches):
        for batch in batches:
            for part, data, off in slices(batch):
                yield part.filter(pa.array(model.score(features(data, off)) >= THRESHOLD))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
