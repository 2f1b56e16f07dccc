"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters, digits and bytes over 0x7F, lower-cased A to Z. A text is kept as its words that occur in the benchmark, with
their positions: all that is needed of it afterwards. Passages are windows of 2 * STRIDE words at every STRIDE words over whole
texts, weighted by TF-IDF over all passages. A randomised SVD of the passage matrix (range finder with one power step, then
Rayleigh-Ritz) gives a latent space: each task sends sums of a fixed size, which are added in two steps. Passages whose cosine
with a benchmark item reaches COSINE there, or that carry SHARE of an item's weight, are candidates; an item longer than a passage is
compared by its own passages. A candidate stands if the longest common subsequence of the whole item and
the passage (STRIDE words wider on both sides, more for a longer item, so that a copy lies in it) has at least COPY of the item's words, or at least PARAPHRASE of them while ANSWER of
the item's last sentence, its answer, appears there in order.

The benchmark is taken in blocks of about ITEMS passages of items, each block with passes of its own, so what is broadcast has a bound at any size.

Null and empty texts hit nothing. Items without words are left out; repeated items are items of their own. Rows that repeat a doc_id are
searched each, and reported once. Rows with a null doc_id are searched too (doc_id null). Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hash_spans, lowered, materialize, plain_names, runs, slices, table

STRIDE, RANK, EXTRA, COSINE = 32, 208, 32, 0.07
#: A short item in a long passage has a low cosine; cosine times passage length over item length, the share of the item's
#: weight in the space that the passage carries, makes a candidate as well from here on.
SHARE = 0.14
#: Terms in a greater share of passages have no weight in the latent space (they count in the subsequence check).
MOST = 0.01
#: Each item counts in the decomposition as a passage with this weight, so that rare items have a place in the space.
HEAVY = 30.0
COPY, PARAPHRASE, ANSWER = 0.75, 0.55, 0.8
#: Passages of items per block, and entries of the sparse matrix that are multiplied at once.
ITEMS, CHUNK = 200, 40_000
#: Bits of a hash that a word is looked up by, and the most rows of a stripe or term that are summed one after another.
BITS, RUN = 16, 64
#: Numbers of a summed array that one row holds.
PIECE = 1 << 16
HITS = "doc_id long, h long, item_id long, cosine double, lcs double, answer double, word long"


def _word_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    return out


WORD = _word_bytes()


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and their text numbers."""
    flat = lowered()[data]
    start, end, text = runs(WORD[flat], off)
    return hash_spans(flat, start, end), text


def _of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return terms(raw, np.array([0, len(raw)], np.int64))[0]


def answer_of(text: str) -> str:
    """The last sentence of an item that has more than one; else nothing."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return parts[-1] if len(parts) > 1 else ""


def passages(n: int) -> list[tuple[int, int]]:
    """Where the passages of an item of n words begin and end: windows of 2 * STRIDE at every STRIDE words, the last at its end."""
    starts = [*range(0, max(1, n - 2 * STRIDE), STRIDE)]
    if n > 2 * STRIDE:
        starts.append(n - 2 * STRIDE)
    return [(a, min(n, a + 2 * STRIDE)) for a in starts]


class Items:
    """A block of benchmark items: their vocabulary, and each item's words and answer as numbers in it."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = [(i, _of(t), _of(answer_of(t))) for i, t in rows]
        words = [x for x in words if len(x[1])]
        self.ids = [x[0] for x in words]
        self.vocabulary = np.unique(np.concatenate([x[1] for x in words])) if words else np.zeros(0, np.uint64)
        number = lambda h: np.searchsorted(self.vocabulary, h).astype(np.int64)
        self.words, self.answers = [number(x[1]) for x in words], [number(x[2]) for x in words]
        #: Passages of the items, and the item of each; stripes that an item's context has on each side of a window in a copy of it.
        cut = [passages(len(x)) for x in self.words]
        self.passages = [x[a:b] for x, ab in zip(self.words, cut, strict=True) for a, b in ab]
        self.item = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
        self.wider = [max(1, -(-(len(x) - 1) // STRIDE) - 1) for x in self.words]


def lcs(pattern: np.ndarray, text: list[int]) -> int:
    """The length of the longest common subsequence, by bits of an integer."""
    at: dict[int, int] = {}
    for k, w in enumerate(pattern.tolist()):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(pattern)) - 1
    v = full
    for w in text:
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def _lookup(vocabulary: np.ndarray):
    """A function from hashes to their numbers in the vocabulary and whether they are in it: by the first BITS bits, then by search."""
    shift = np.uint64(64 - BITS)
    first = np.searchsorted(vocabulary, np.arange(1 << BITS, dtype=np.uint64) << shift)
    several = np.diff(first, append=len(vocabulary)) > 1
    first = np.minimum(first, len(vocabulary) - 1).astype(np.int32)

    def number(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (h >> shift).astype(np.int32)
        k = first[at]
        more = np.flatnonzero(several[at])
        k[more] = np.minimum(np.searchsorted(vocabulary, h[more]), len(vocabulary) - 1)
        return k, vocabulary[k] == h

    return number


def _sparse(vocabulary: np.ndarray):
    def run(batches):
        number = _lookup(vocabulary)
        for batch in batches:
            for part, data, off in slices(batch):
                h, text = terms(data, off)
                n = np.bincount(text, minlength=part.num_rows)
                pos = np.arange(len(h)) - (np.cumsum(n) - n)[text]
                k, hit = number(h)
                cut = np.concatenate(([0], np.cumsum(np.bincount(text[hit], minlength=part.num_rows)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x[hit].astype(np.int32))) for x in (pos, k)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n), *lists], ["doc_id", "h", "n", "pos", "term"])
                yield out.filter(pa.array(cut[1:] > cut[:-1]))

    return run


def _stripes(batch: pa.RecordBatch, most: int = CHUNK):
    """Rows of a batch in runs of about `most` entries: the slice; term and stripe of each entry; text of each stripe."""
    length = np.diff(batch.column("pos").offsets.to_numpy())
    ends = np.cumsum(length)
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
        part = batch.slice(row, stop - row)
        pos, term = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("pos", "term"))
        n = -(-part.column("n").to_numpy() // STRIDE)
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        stripe = first[np.repeat(np.arange(len(n)), length[row:stop])] + pos // STRIDE
        yield part, term, stripe, owner
        row = stop


def _first(owner: np.ndarray) -> np.ndarray:
    """The first stripe of each text but the first."""
    return np.flatnonzero(owner[1:] != owner[:-1]) + 1


def _windows(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums of neighbouring stripes of one text (a text's last stripe stands alone), one window per stripe."""
    out = x.copy()
    out[:-1] += x[1:]
    last = _first(owner) - 1
    out[last] = x[last]
    return out


def _unwindows(z: np.ndarray, owner: np.ndarray) -> np.ndarray:
    out = z.copy()
    out[1:] += z[:-1]
    first = _first(owner)
    out[first] = z[first]
    return out


def _times(term: np.ndarray, stripe: np.ndarray, n: int, weighted: np.ndarray) -> np.ndarray:
    """Sparse stripes x dense: the rows of weighted at each entry's term, summed per stripe. Entries are in stripe order.

    The k-th entries of all stripes are added at once, longest stripes first; what is longer than RUN goes in runs that are summed after.
    """
    out = np.zeros((n, weighted.shape[1]), weighted.dtype)
    if not len(term):
        return out
    cut = np.flatnonzero(np.concatenate(([True], stripe[1:] != stripe[:-1])))
    length = np.diff(cut, append=len(term))
    long = length.max() > RUN
    if long:
        cut = np.concatenate([np.arange(a, a + m, RUN) for a, m in zip(cut.tolist(), length.tolist(), strict=True)])
        length = np.diff(cut, append=len(term))
    order = np.argsort(-length, kind="stable")
    begin = cut[order]
    more = len(begin) - np.cumsum(np.bincount(length))  # how many have more than k entries
    x = weighted[term[begin]]
    for k in range(1, len(more) - 1):
        x[: more[k]] += weighted[term[begin[: more[k]] + k]]
    if long:
        back = np.argsort(order)
        return _times(back, stripe[cut], n, x)
    out[stripe[begin]] = x
    return out


def _sums(sparse: DataFrame, make, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of make(batch slices) over all rows: an array of a fixed shape per task, added up piece by piece in two steps.

    The driver gets each piece once, whatever the number of tasks and partitions.
    """
    size = int(np.prod(shape))
    schema = "piece int, salt int, x binary"

    def rows(pieces: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
        x = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in pieces.values()]
        return pa.RecordBatch.from_pydict({"piece": pa.array(list(pieces), pa.int32()), "salt": pa.array([salt] * len(x), pa.int32()), "x": pa.array(x, pa.binary())})

    def piece(number: int, blob: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(blob, min(PIECE, size - number * PIECE) * 8, codec="zstd", asbytes=True), "<f8")

    def partial(batches):
        total = np.zeros(shape)
        for batch in batches:
            for item in _stripes(batch):
                make(total, *item)
        if total.any():
            flat = total.ravel().astype("<f8")
            yield rows({i // PIECE: flat[i : i + PIECE] for i in range(0, size, PIECE)}, zlib.crc32(flat) % 16)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, blob in zip(batch.column("piece").to_pylist(), batch.column("x"), strict=True):
                x = piece(number, blob.as_py())
                total[number] = total[number] + x if number in total else x
        if total:
            yield rows(total, 0)

    some = sparse.mapInArrow(partial, schema).repartition(64, "piece", "salt").mapInArrow(add, schema)
    out = np.zeros(size)
    for r in some.repartition(16, "piece").mapInArrow(add, schema).collect():
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = piece(r.piece, bytes(r.x))
    return out.reshape(shape)


def _by_term(term: np.ndarray, size: int) -> np.ndarray:
    """The order of entries by term, and within a term as they are; numbers of 16 bits are sorted by radix."""
    return np.argsort(term.astype(np.uint16) if size <= 1 << 16 else term, kind="stable")


def latent_space(sparse: DataFrame, items: Items, rank: int = RANK, extra: int = EXTRA, most: float = MOST) -> tuple[np.ndarray, np.ndarray]:
    """idf of the terms (0: no weight), and the term vectors of the leading singular directions (terms x rank, times idf)."""
    size = len(items.vocabulary)

    def frequency(total, part, term, stripe, owner):
        total[size] += len(owner)
        order = _by_term(term, size)
        t, s = term[order], stripe[order]
        new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1]))))
        t, s = t[new], s[new]
        begins = np.concatenate(([True], owner[1:] != owner[:-1]))
        windows = 2 - begins[s]  # a stripe's own window, and the one before it in its text, unless that counts already
        windows[1:] -= (t[1:] == t[:-1]) & (s[1:] == s[:-1] + 1) & ~begins[s[1:]]
        total[:size] += np.bincount(t, windows, size)

    df = _sums(sparse, frequency, (size + 1,))
    idf = np.log((df[size] + 1) / (df[:size] + 1)) + 1e-3
    rare = df[:size] <= most * df[size]
    for w in items.words:  # an item of frequent words only is known by these
        if rare[w].sum() < 3:
            rare[w] = True
    idf[~rare] = 0
    width = min(rank + extra, size)
    own = np.zeros((len(items.words), size))
    for i, w in enumerate(items.words):
        np.add.at(own[i], w, HEAVY * idf[w])
    omega = (np.random.default_rng(7).standard_normal((size, width)) * idf[:, None]).astype(np.float32)

    def power(total, part, term, stripe, owner):
        own = np.flatnonzero(rare[term])
        term, stripe = term[own], stripe[own]
        u = _unwindows(_windows(_times(term, stripe, len(owner), omega), owner), owner)
        order = _by_term(term, size)
        t, there = np.unique(term[order], return_inverse=True)
        total[t] += _times(stripe[order], there, len(t), u)

    y = _sums(sparse, power, (size, width)) * idf[:, None] + own.T @ (own @ np.where(idf[:, None] > 0, omega / np.maximum(idf, 1e-9)[:, None], 0))
    q, _ = np.linalg.qr(y)
    weighted = (q * idf[:, None]).astype(np.float32)

    def gram(total, part, term, stripe, owner):
        own = np.flatnonzero(rare[term])
        z = _windows(_times(term[own], stripe[own], len(owner), weighted), owner)
        total += z.T @ z

    near = own @ q
    value, turn = np.linalg.eigh(_sums(sparse, gram, (width, width)) + near.T @ near)
    best = np.argsort(-value)[: min(rank, width)]
    return idf, (q @ turn[:, best] * idf[:, None]).astype(np.float32)


def _search(items: Items, idf: np.ndarray, space: np.ndarray, cosine: float):
    """Cosines divide by the length of the whole vectors: what the space loses of a passage, other words too, counts against it."""
    square = idf**2
    other, rare = float(idf.max() ** 2) if len(idf) else 0.0, idf > 0
    sizes = np.array([max(1e-6, float(np.sqrt(square[w].sum()))) for w in items.passages], np.float32)
    vectors = np.stack([space[w].sum(0) for w in items.passages]) / sizes[:, None]
    lists = [w.tolist() for w in items.words]
    kept = np.maximum(np.linalg.norm(vectors, axis=1), 1e-6)  # the share of a passage's length that the space keeps
    enough = (SHARE * sizes * kept**2).astype(np.float32)
    vectors = np.ascontiguousarray(vectors.T, np.float32)

    def run(batches):
        for batch in batches:
            hits = []
            for part, term, stripe, owner in _stripes(batch):
                own = np.flatnonzero(rare[term])
                known = np.bincount(stripe, minlength=len(owner))
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                size = np.minimum(STRIDE, part.column("n").to_numpy()[owner] - place * STRIDE)
                length = np.bincount(stripe[own], square[term[own]], len(owner)) + other * (size - known)
                length = np.sqrt(np.maximum(_windows(length, owner), 1e-9)).astype(np.float32)
                like = _windows(_times(term[own], stripe[own], len(owner), space), owner) @ vectors
                at = np.flatnonzero(like >= np.minimum(np.float32(cosine) * length[:, None], enough))
                if not len(at):
                    continue
                win, passage = np.divmod(at, len(enough))
                item = items.item[passage]
                cut = np.flatnonzero(np.concatenate(([True], (win[1:] != win[:-1]) | (item[1:] != item[:-1]))))
                win, item, cosines = win[cut], item[cut], np.maximum.reduceat(like[win, passage] / length[win], cut)
                first = np.searchsorted(owner, np.arange(part.num_rows))
                begin = np.searchsorted(stripe, np.arange(len(owner) + 1))
                ids, texts = part.column("doc_id").to_pylist(), part.column("h").to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                last, contexts, done = -1, {}, {}
                for w, k, cos in zip(win.tolist(), item.tolist(), cosines.tolist(), strict=True):  # window by window
                    if w != last:
                        last, d, contexts = w, int(owner[w]), {}
                        end = int(first[d + 1]) if d + 1 < part.num_rows else len(owner)
                    words, wider = items.words[k], items.wider[k]
                    step = wider // 8  # windows of a long copy lie in one context, if that is wider by the step
                    if step and w - done.get((d, k), w - step) < step:
                        continue
                    done[d, k] = w
                    if wider not in contexts:
                        seen = term[begin[max(int(first[d]), w - wider - step)] : begin[min(end, w + 2 + wider + step)]].tolist()
                        contexts[wider] = seen, set(seen)
                    seen, held = contexts[wider]
                    if sum(map(held.__contains__, lists[k])) < PARAPHRASE * len(words):
                        continue
                    common = lcs(words, seen) / len(words)
                    answer = items.answers[k]
                    said = lcs(answer, seen) / len(answer) if len(answer) else 0.0
                    if common >= COPY or common >= PARAPHRASE and said >= ANSWER:
                        best[d, k] = max(best.get((d, k), (0.0,)), (common, said, cos, (w - int(first[d])) * STRIDE))
                hits += [(ids[d], texts[d], items.ids[k], c, s, a, at) for (d, k), (s, a, c, at) in best.items()]
            if hits:
                c = list(zip(*hits, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), *(pa.array(x, pa.float64()) for x in c[3:6]), pa.array(c[6], pa.int64())], ["doc_id", "h", "item_id", "cosine", "lcs", "answer", "word"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per document and benchmark item that it leaks: HITS' columns; word is where the best window begins.

    by says what a document is: its doc_id alone, or also h, the hash of its text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    out, block, full = [], [], 0

    def search(rows):
        items = Items(rows)
        if not items.ids:
            return
        sparse = materialize(docs.mapInArrow(_sparse(items.vocabulary), "doc_id long, h long, n long, pos array<int>, term array<int>"), "sparse")
        idf, space = latent_space(sparse, items)
        found = sparse.mapInArrow(_search(items, idf, space, cosine), HITS)
        out.append(found.groupBy(*by, "item_id").agg(F.max_by(F.struct("cosine", "lcs", "answer", "word"), F.struct("lcs", "word")).alias("m")).select(*by, "item_id", "m.*"))

    for r in benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        full += len(passages(len(_of(r[1]))))
        if full >= ITEMS:
            search(block)
            block, full = [], 0
    search(block)
    if not out:
        return spark.createDataFrame([], HITS).select(*by, "item_id", "cosine", "lcs", "answer", "word")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def without_leaks(docs: DataFrame, benchmark: DataFrame, nameless: bool = False) -> DataFrame:
    """docs without the rows that leak a benchmark item; rows are told apart by doc_id and text.

    A leaking row without a doc_id goes if nameless is set; else it stays. It takes no other row with it.
    """
    gone = leaks(docs, benchmark, by=("doc_id", "h")).select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")).distinct()
    gone = materialize(gone if nameless else gone.where("_gone IS NOT NULL"), "leaks")
    d = plain_names(docs)
    return d.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_h")), "left_anti").toDF(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
