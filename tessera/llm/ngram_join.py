"""N-gram Jaccard join by vertical partitioning, and the connected components of its links.

The global n-gram order is (estimated document frequency, hash): a fixed-size count sketch over all documents gives the
estimate, the hash breaks ties, and any such order is exact for prefix filtering. That order is cut into FRAGMENTS
ranges. Two sets that link share an n-gram among the rarest of both; the sets with such an n-gram form a bucket. The
overlap of two sets is counted for each fragment separately, the rarest first, and summed per pair; a pair ends where the rest
can't make a link. Equal sets are one vertex from the start, so exact copies cost nothing.

A group of near copies has a number of pairs that is quadratic in its size; components need a spanning forest. No pair is
ever a row but for the edges of forests:

1. In each bucket, a parity bitmap of each set bounds the symmetric difference from below. A forest of the pairs that may link
   leaves the bucket; what these forests connect is a cluster, and every link lies inside one.
2. The n-grams of each vertex of a cluster go to the cluster, once. There pairs are accepted or refuted exactly, and
   pairs that are connected already are not looked at; a forest of the links leaves.

Buckets and clusters of more than LIMIT are cut into blocks. Each block is compared with itself and with the first block;
then the vertices outside of the largest component so far are compared with all. So a group whose vertices mostly link costs its size
once or twice, wherever its rows lie.

Null and empty texts, and those without words, have the empty set: they link with nothing and are their own component.
Rows that repeat a doc_id are reported once each. A null doc_id is a document without an id: it links as any other, and
its component is the smallest id in it (null where there is none). Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import distinct_sets, least_row, materialize, mix, plain_names, remove, shingles, shared_dir, signed, slices, table, words

#: log2 of the sketch's cells (4 bytes each; a fixed size at any input), rows of cells per block, ranges of the order.
CELL_BITS, BLOCK, FRAGMENTS = 20, 1 << 16, 4
#: n-grams (LEAST per vertex at least) of a block of a bucket or cluster: what a task holds of it is two blocks.
LIMIT, LEAST = 1 << 19, 256
#: Bits of the longest bitmap; longer sets get a weaker bound from it, and are told apart by their n-grams.
MOST_BITS = 1 << 17


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, data, off in slices(batch):
        w, text = words(data, off)
        yield (part, *distinct_sets(*shingles(w, text, part.num_rows, k), part.num_rows))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def vertices(h: np.ndarray, off: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit signature of each sorted set: equal sets have equal ones."""
    n = np.diff(off)
    out = np.zeros(len(n), np.uint64)
    if len(h):
        x = h ^ mix(np.array([seed + 1], np.uint64))
        x = mix(x * np.uint64(0xD6E8FEB86659FD93))
        some = n > 0
        out[some] = np.add.reduceat(x, off[:-1][some])
    return mix(out * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)).view(np.int64)


def bitmap(h: np.ndarray) -> bytes:
    """The parity of the number of n-grams in each of at least 4 * len(h) hash classes (1024 to MOST_BITS, a power of 2)."""
    bits = min(MOST_BITS, max(1024, 1 << (4 * len(h) - 1).bit_length()))
    parity = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(bool), bitorder="little").tobytes()


DESCRIBED = "doc_id long, h long, v long, other long, n long, bits binary, block int"


def _describe(k: int, seed: int):
    """Per document: its text's hash, vertex and a second signature, set size and bitmap; at the end of a task, its sketch in blocks."""

    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for part, h, off in _sets(batch, k):
                cells += np.bincount(_cell(h), minlength=1 << CELL_BITS).astype(np.uint32)
                n = np.diff(off)
                none = n == 0
                bits = [bitmap(h[a:b]) if b > a else None for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), *(pa.array(vertices(h, off, s), mask=none) for s in (seed, ~seed & 0xFFFF)), pa.array(n), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int32())],
                    ["doc_id", "h", "v", "other", "n", "bits", "block"],
                )
        if cells.any():
            blobs = [(i, zlib.compress(cells[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1)) for i in range(len(cells) // BLOCK)]
            m = len(blobs)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 5, pa.array([b for _, b in blobs], pa.binary()), pa.array([i for i, _ in blobs], pa.int32())], ["doc_id", "h", "v", "other", "n", "bits", "block"])

    return run


def _sum_blocks(batches):
    """Adds up the sketch blocks that one task receives."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(blob), np.uint32)
            total[block] = total[block] + x if block in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["block", "bits"])


def _sketch(described: DataFrame) -> np.ndarray:
    """The whole sketch: 2**CELL_BITS counts, whatever the input's size. Summed in two steps, the first of 16 x the blocks."""
    blocks = described.where("block IS NOT NULL").select("block", "bits", (F.crc32("bits") % 16).alias("salt"))
    some = blocks.repartition(64, "block", "salt").mapInArrow(_sum_blocks, "block int, bits binary")
    rows = some.repartition(16, "block").mapInArrow(_sum_blocks, "block int, bits binary").collect()
    cells = np.zeros(1 << CELL_BITS, np.uint32)
    for r in rows:
        cells[r.block * BLOCK : (r.block + 1) * BLOCK] += np.frombuffer(zlib.decompress(r.bits), np.uint32)
    return cells


def required(n, num: int):
    """The least overlap of a set of n with any set that it may link with."""
    return (num * n + 99) // 100


def _prefixes(k: int, num: int, cells, seed: int):
    """The n-grams of each set that come first in the global order: two sets that link share one of them."""

    def run(batches):
        count = cells.value
        for batch in batches:
            for _, h, off in _sets(batch, k):
                toks, vs, ns = [], [], []
                done = set()
                freq = count[_cell(h)]
                for a, b, v in zip(off[:-1].tolist(), off[1:].tolist(), vertices(h, off, seed).tolist(), strict=True):
                    if a == b or v in done:
                        continue
                    done.add(v)
                    p = b - a - required(b - a, num) + 1
                    f = freq[a:b]
                    if p < b - a:
                        top = np.partition(f, p - 1)[p - 1]
                        sure, tie = np.flatnonzero(f < top), np.flatnonzero(f == top)
                        take = np.concatenate((sure, tie[: p - len(sure)]))  # hashes ascend, so the first ties have the least
                    else:
                        take = np.arange(b - a)
                    toks.append(h[a:b][take])
                    vs.append(np.full(len(take), v, np.int64))
                    ns.append(np.full(len(take), b - a, np.int32))
                if toks:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(toks))), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ns))], ["token", "v", "n"])

    return run


def _groups(batches, *keys: str):
    """Sorted batches cut at changes of the keys: each yielded table holds whole keys."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= x[1:] != x[:-1]
            changed[0] |= bool(held) and held[-1].column(k)[-1].as_py() != x[0]
        cut = np.flatnonzero(changed)
        if len(cut):
            last = int(cut[-1])
            if held or last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _cuts(t: pa.Table, *keys: str) -> list[tuple[int, int]]:
    """Where each key's rows begin and end."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], t.num_rows], strict=True))


def _shared(num: int):
    """Keeps the postings whose bucket has another vertex of a fitting size. Input sorted by (token, n, v).

    A bucket is named by a hash of what it keeps, so n-grams with the same vertices make one bucket in the end.
    """

    def run(batches):
        for t in _groups(batches, "token"):
            tok, v, n = (t.column(c).to_numpy() for c in ("token", "v", "n"))
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (v[1:] != v[:-1])
            tok, v, n = tok[new], v[new], n[new]
            fits = np.zeros(len(tok), bool)
            near = (tok[1:] == tok[:-1]) & (100 * n[:-1].astype(np.int64) >= num * n[1:].astype(np.int64))
            fits[1:] |= near
            fits[:-1] |= near
            if fits.any():
                tok, v = tok[fits], v[fits]
                cut = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
                name = mix(np.add.reduceat(mix(v.view(np.uint64)), cut))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.repeat(name, np.diff(np.append(cut, len(v)))))), pa.array(v)], ["bucket", "v"])

    return run


class Bitmaps:
    """Tells which vertices of a group may link with one of them, by size and bitmap; none that does link is left out."""

    columns = ["bits"]

    def __init__(self, t: pa.Table, num: int):
        self.num, self.n = num, t.column("n").to_numpy().astype(np.int64)
        self.bits = [np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()]
        by: dict[int, list[int]] = {}
        for i, x in enumerate(self.bits):
            by.setdefault(len(x), []).append(i)
        self.classes = [(size, np.array(at), np.stack([self.bits[i] for i in at])) for size, at in by.items()]

    def links(self, i: int, rest: np.ndarray) -> np.ndarray:
        """rest: a mask of vertices; the mask of those that may link with i."""
        out = np.zeros(len(rest), bool)
        for size, at, many in self.classes:
            some = rest[at]
            b = self.n[at]
            some &= 100 * np.minimum(self.n[i], b) >= self.num * np.maximum(self.n[i], b)
            if not some.any():
                continue
            x, y, b = self.bits[i], many[some], b[some]
            while len(x) > size:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while y.shape[1] > len(x):
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            least = -(-self.num * (self.n[i] + b) // (100 + self.num))  # overlap o of a link: 100 o >= num (a + b - o)
            out[at[some]] = np.bitwise_count(y ^ x).sum(1) <= self.n[i] + b - 2 * least
        return out


class Sets:
    """Tells which vertices of a group link with one of them, exactly: overlaps are counted fragment by fragment and summed."""

    columns = ["seg", "cut"]

    def __init__(self, t: pa.Table, num: int):
        self.num, self.n = num, t.column("n").to_numpy().astype(np.int64)
        seg, cut = (t.column(c).combine_chunks() for c in ("seg", "cut"))
        seg, cut = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (seg, cut))
        first = seg.offsets.to_numpy().astype(np.int64)
        _, token = np.unique(seg.values.to_numpy()[first[0] : first[-1]], return_inverse=True)
        self.token = token.astype(np.int32)
        #: Where each vertex's part of each fragment begins, and its end.
        self.at = cut.flatten().to_numpy().astype(np.int64).reshape(len(self.n), FRAGMENTS + 1) + (first[:-1] - first[0])[:, None]
        self.mark = np.zeros(int(self.token.max(initial=-1)) + 1, np.int8)

    def links(self, i: int, rest: np.ndarray) -> np.ndarray:
        r = np.flatnonzero(rest)
        a, b = self.n[i], self.n[r]
        fits = 100 * np.minimum(a, b) >= self.num * np.maximum(a, b)
        r, b = r[fits], b[fits]
        need, overlap = -(-self.num * (a + b) // (100 + self.num)), np.zeros(len(r), np.int64)
        own = self.token[self.at[i, 0] : self.at[i, -1]]
        self.mark[own] = 1
        for f in range(FRAGMENTS):
            if not len(r):
                break
            low, size = self.at[r, f], self.at[r, f + 1] - self.at[r, f]
            stop = np.cumsum(size)
            hit = self.mark[self.token[np.arange(stop[-1]) + np.repeat(low - stop + size, size)]]
            c = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
            overlap = overlap + c[stop] - c[stop - size]
            can = overlap + np.minimum(self.at[i, -1] - self.at[i, f + 1], self.at[r, -1] - self.at[r, f + 1]) >= need
            r, need, overlap = r[can], need[can], overlap[can]
        self.mark[own] = 0
        out = np.zeros(len(rest), bool)
        out[r] = True
        return out


def _forest(kind, num: int, key: str):
    """Per group (key, part): edges that connect what its links connect. Vertices of side 0 are compared with all others.

    Vertices with equal labels are connected already.
    """

    def run(batches):
        for t in _groups(batches, key, "part"):
            xs, ys = [], []
            for a, b in _cuts(t, key, "part"):
                if b - a < 2:
                    continue
                part = t.slice(a, b - a)
                v, side = part.column("v").to_numpy(), part.column("side").to_numpy()
                _, label = np.unique(part.column("label").to_numpy(), return_inverse=True)
                if (label == label[0]).all():
                    continue
                test = kind(part, num)
                for i in np.flatnonzero(side == 0).tolist():
                    rest = label != label[i]
                    if not rest.any():
                        continue
                    got = test.links(i, rest)
                    if got.any():
                        joined, at = np.unique(label[got], return_index=True)
                        xs.append(np.full(len(at), v[i]))
                        ys.append(v[got][at])
                        label[np.isin(label, joined)] = label[i]
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["x", "y"])

    return run


def _weight() -> F.Column:
    return F.greatest(F.col("n"), F.lit(LEAST)).cast("long")


def _big(rows: DataFrame, key: str, name: str = "blocks") -> DataFrame:
    """The keys that need more than one block, and how many."""
    w = rows.groupBy(key).agg(F.sum(_weight()).alias("w"))
    return w.where(F.col("w") > LIMIT).select(key, F.ceil(F.col("w") / LIMIT).cast("int").alias(name))


def _spanning(rows: DataFrame, key: str, kind, num: int, name: str) -> DataFrame:
    """Edges (x, y) that connect the vertices of rows (key, v, n and kind's columns) as the links inside of each key do."""
    columns = [key, "v", "n", *kind.columns]

    def run(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select(*columns, "part", "side", "label")
        return materialize(dealt.repartition(key, "part").sortWithinPartitions(key, "part", "side", "v").mapInArrow(_forest(kind, num, key), "x long, y long").distinct(), name)

    big = materialize(_big(rows, key), f"{name}-big")
    block = F.pmod(F.xxhash64("v"), F.coalesce("blocks", F.lit(1))).cast("int")
    own = rows.join(big, key, "left").withColumn("block", block)
    # block 0 goes to every other block of its key as side 1
    places = F.when(F.col("block") == 0, F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda i: F.struct(i.alias("part"), (i > 0).cast("int").alias("side"))))
    places = F.coalesce(places, F.array(F.struct(F.col("block").alias("part"), F.lit(0).alias("side"))))
    edges = run(own.withColumn("place", F.explode(places)).select(*columns, "place.*", F.col("v").alias("label")))
    if big.isEmpty():
        return edges
    labelled = rows.join(big, key).join(components(edges).withColumnRenamed("c", "to"), "v", "left").withColumn("label", F.coalesce("to", "v"))
    count = labelled.groupBy(key, "label").agg(F.count("*").alias("m")).groupBy(key).agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.count("*").alias("labels"))
    labelled = labelled.join(count.where("labels > 1").drop("labels"), key).select(*columns, "label", "most", "blocks")
    minor = labelled.where("label <> most")
    few = materialize(minor.groupBy(key).agg(F.ceil(F.sum(_weight()) / LIMIT).cast("int").alias("few")), f"{name}-few")
    part = lambda i, j: (i * F.col("blocks") + j).cast("int").alias("part")
    left = minor.join(few, key).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select(*columns, "label", part(F.pmod(F.xxhash64("v"), F.col("few")), F.col("j")), F.lit(0).alias("side"))
    right = labelled.join(few, key).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("few") - 1)))
    right = right.select(*columns, "label", part(F.col("i"), F.pmod(F.xxhash64("v"), F.col("blocks"))), F.lit(1).alias("side"))
    return edges.unionByName(run(left.unionByName(right)))


def _degrees(num: int):
    """Per group (c, part): of each vertex, the rows that it links with in the group, by links of a vertex of side 0 and any other."""

    def run(batches):
        for t in _groups(batches, "c", "part"):
            out = []
            for a, b in _cuts(t, "c", "part"):
                part = t.slice(a, b - a)
                v, side, copies = (part.column(c).to_numpy() for c in ("v", "side", "copies"))
                test, total = Sets(part, num), np.zeros(b - a, np.int64)
                after = np.arange(b - a)
                alone = (side == 0).all()
                for i in np.flatnonzero(side == 0).tolist():
                    got = test.links(i, after > i if alone else side == 1)
                    total[i] += copies[got].sum()
                    total[got] += copies[i]
                out.append((v[total > 0], total[total > 0]))
            x = [np.concatenate(c) for c in zip(*out, strict=True)]
            if len(x[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["v", "n_links"])

    return run


def link_counts(clusters: DataFrame, num: int) -> DataFrame:
    """(v, n_links): how many rows with other sets each vertex links with. All pairs of a cluster's different sets are counted."""
    big = _big(clusters, "c")
    own = clusters.join(big, "c", "left").withColumn("b", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("v"), F.col("b")).cast("int"))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    low = F.least("block", "j")
    own = own.select("c", "v", "n", "copies", "seg", "cut", (low * F.col("b") + F.greatest("block", "j")).cast("int").alias("part"), (F.col("block") > low).cast("int").alias("side"))
    return own.repartition("c", "part").sortWithinPartitions("c", "part", "side", "v").mapInArrow(_degrees(num), "v long, n_links long").groupBy("v").agg(F.sum("n_links").alias("n_links"))


def _segments(k: int, cells, bounds: list[int], seed: int):
    """Each set in the global order's fragments (by estimated frequency; ties lie in one fragment), and where each begins."""

    def run(batches):
        count = cells.value
        for batch in batches:
            for _, h, off in _sets(batch, k):
                v, n = vertices(h, off, seed), np.diff(off)
                keep = np.zeros(len(n), bool)
                keep[np.unique(v, return_index=True)[1]] = True
                keep &= n > 0
                owner = np.repeat(np.arange(len(n)), n)
                f = np.searchsorted(bounds, count[_cell(h)], "right")
                order = np.argsort(owner * FRAGMENTS + f, kind="stable")
                sizes = np.bincount(owner * FRAGMENTS + f, minlength=len(n) * FRAGMENTS).reshape(-1, FRAGMENTS)
                cut = np.concatenate((np.zeros((len(n), 1), np.int64), np.cumsum(sizes, axis=1)), axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(signed(h[order])))
                cuts = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (FRAGMENTS + 1)), pa.array(cut.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(v), lists, cuts], ["v", "seg", "cut"]).filter(pa.array(keep))

    return run


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(v, c) for all vertices of edges (x, y): c is the least vertex of v's component.

    Alternating large-star and small-star steps, each written to the shared folder; the steps needed grow with the
    logarithm of the longest path. A hub's edges (16 bytes each) are joined with its least neighbour by key; Spark splits such a join where it is skewed.
    """
    spark = edges.sparkSession
    e = materialize(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("w")).where("u <> w").distinct(), name)
    while True:
        both = e.unionByName(e.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        large = materialize(large, name)
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").unionByName(low.select("u", F.col("m").alias("w"))).distinct()
        small = materialize(small, name)
        remove(spark, large)
        remove(spark, e)
        e = small
        # done when every vertex but the least of its component points to a vertex that points to none
        sides = e.select(F.col("u").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("w").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if sides.groupBy("v").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 OR out > 0 AND into > 0").isEmpty():
            break
    return e.select(F.col("u").alias("v"), F.col("w").alias("c")).unionByName(e.select(F.col("w").alias("v"), F.col("w").alias("c"))).distinct()


def _linked(docs: DataFrame, k: int, num: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, h: the text's hash, v, n), sets (v, n, copies and the least doc_id), components (v, c) of linked sets, clusters.

    Should two different sets have one signature, which their second ones show, all is done again with another seed.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    described = materialize(texts.mapInArrow(_describe(k, seed), DESCRIBED), "described")
    rows = described.where("block IS NULL")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    sets = rows.where("v IS NOT NULL").groupBy("v").agg(F.min(first).alias("row"), F.max("n").alias("n"), F.count("*").alias("copies"), (F.min("other") != F.max("other")).alias("clash"))
    sets = materialize(sets.select("v", F.col("row.doc_id").alias("doc_id"), F.col("row.h").alias("h"), "n", "copies", "clash"), "sets")
    if not sets.where("clash").isEmpty():
        return _linked(docs, k, num, seed + 1)
    cells = _sketch(described)
    shared_cells = spark.sparkContext.broadcast(cells)
    order = np.sort(cells)
    weight = np.cumsum(order, dtype=np.int64)
    bounds = [int(order[min(len(order) - 1, int(np.searchsorted(weight, weight[-1] * i // FRAGMENTS)))]) for i in range(1, FRAGMENTS)]

    postings = texts.select("text").mapInArrow(_prefixes(k, num, shared_cells, seed), "token long, v long, n int")
    buckets = postings.repartition("token").sortWithinPartitions("token", "n", "v").mapInArrow(_shared(num), "bucket long, v long").distinct()
    bits = rows.where("v IS NOT NULL").groupBy("v").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    buckets = materialize(buckets.join(bits, "v"), "buckets")
    near = components(_spanning(buckets, "bucket", Bitmaps, num, "near"), "near")

    ids = sets.join(near, "v", "left_semi").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    # names of texts grow with the texts: at every size both are shuffled, and names are hashed, so that texts needn't be sorted
    some = texts.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi").select("text")
    seg = some.mapInArrow(_segments(k, shared_cells, bounds, seed), "v long, seg array<long>, cut array<int>").groupBy("v").agg(F.first("seg").alias("seg"), F.first("cut").alias("cut"))
    clusters = materialize(seg.join(near, "v").join(sets.select("v", "n", "copies"), "v").select("c", "v", "n", "copies", "seg", "cut"), "clusters")
    comp = components(_spanning(clusters, "c", Sets, num, "links"))
    remove(spark, buckets)
    return rows, sets, comp, clusters


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """Per document: doc_id, v (its set), n_shingles, component_id, n_links.

    Sets are distinct k-word shingles; two link when 100 * intersection >= num * union. component_id is the smallest
    doc_id reachable by links. n_links is the number of other rows that the row links with, those with an equal set included.
    """
    rows, sets, comp, clusters = _linked(docs, k, num)
    degree = link_counts(clusters, num)
    least = sets.join(comp, "v").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = sets.select("v", "doc_id", "copies").join(comp.join(least, "c").select("v", "component_id"), "v", "left").join(degree, "v", "left")
    named = named.select("v", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "v", F.col("n").alias("n_shingles")).join(named, "v", "left")
    return out.select("doc_id", "v", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """docs without all but one row of each component: the row with the smallest doc_id (null comes last) stays.

    Rows are told apart by doc_id and text, not by doc_id alone: of an id with several texts, only the texts that link go; of rows with
    equal ids and texts, the one whose other columns are least stays. Rows without words are kept. Other columns have any names and types.
    """
    return _first_rows(plain_names(docs), k, num).toDF(*docs.columns)


def _first_rows(docs: DataFrame, k: int, num: int) -> DataFrame:
    rows, _, comp, _ = _linked(docs, k, num)
    rows = rows.where("v IS NOT NULL").select("v", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h").alias("row"))
    first = rows.groupBy("v").agg(F.min("row").alias("row")).join(comp, "v", "left")
    first = first.groupBy(F.coalesce("c", "v").alias("c")).agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    known = rows.groupBy("row").agg(F.count("*").alias("copies")).join(first, "row", "left")
    # rows that this doesn't name stay
    fate = known.where("first IS NULL OR copies > 1").select(F.col("row.doc_id").alias("_id"), F.col("row.h").alias("_h"), F.col("first").isNotNull().alias("_one_stays"))
    fate = materialize(fate, "fate")
    d = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    d = d.join(fate.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_h")), "left")
    kept = d.where("_one_stays IS NULL").select(*docs.columns)
    if not fate.where("_one_stays").isEmpty():
        one = d.where("_one_stays").groupBy("_id", "_h").agg(least_row(docs).alias("row"))
        kept = kept.unionByName(one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
    return kept


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(a) < 4 THEN array_to_string(a, ' ') ELSE array_to_string(a[i : i + 3], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(a) - 3, 1) + 1)) AS t(i) WHERE len(a) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v)
SELECT v AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id, coalesce(any_value(l.m), 0)::BIGINT AS n_links
FROM r LEFT JOIN n ON n.doc_id = v LEFT JOIN (SELECT x, count(*) AS m FROM e GROUP BY x) l ON l.x = v GROUP BY v
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, num=85).select("doc_id", "n_shingles", "component_id", "n_links")
