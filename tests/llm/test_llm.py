"""The ten operators and the pipeline against brute force, on small and odd inputs."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, lm_scoring, ngram_join, packing, quality, sharding, syncmers, token_files, tokens, warc
from tessera.llm.common import scratch

ODD = "doc_id long, text string, n_links long, v long, part int, extra string"
ROWS = [
    (1, None, 1, 1, 1, "a"), (2, "", 2, 2, 2, None), (3, "one two three four five six", None, None, None, None), (3, "one two three four five six", None, None, None, None),
    (None, "ONE two three\tfour five six", 0, 0, 0, ""), (4, "a b", 0, 0, 0, ""), (5, "a b", 0, 0, 0, ""), (6, " \n ", 0, 0, 0, ""), (7, "word " * 30_000, 0, 0, 0, ""), (8, "é×÷ it's <|endoftext|> ok. ́x", 0, 0, 0, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def word_sets(rows, k):
    out = []
    for doc_id, text, *_ in rows:
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append((doc_id, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    return out


def brute_components(rows, k, num):
    sets = word_sets(rows, k)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((str(d), len(s), d if not s else ids.get(find(i))) for i, (d, s) in enumerate(sets))


def test_ngram_join_odd(odd, none):
    got = ngram_join.ngram_join(odd, 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(ROWS, 4, 85)
    assert ngram_join.ngram_join(none, 4, 85).count() == 0


def test_ngram_join_groups(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for base in range(6):
        words = [f"w{base}x{i}" for i in range(80)]
        for _ in range(12):
            copy = list(words)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                copy[at] = f"e{rng.integers(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)
    kept = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows, 4, 85)})


def test_sharding(spark, odd, none, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.shard(docs).toPandas()
    count = got.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert count["size"].max() - count["size"].min() <= 1 and (count["max"] + 1 == count["size"]).all() and (count["nunique"] == count["size"]).all()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(zlib.crc32(texts[d].encode()) == c and len(texts[d].encode()) + 1 == s for d, c, s in zip(got.doc_id, got.text_crc32, got["size"], strict=True))
    loose = sharding.shard(docs, load=0.25).toPandas()
    assert loose.groupby("shard").size().max() <= -(-len(got) * 1.25 // 16)
    assert (loose.shard != loose.home_shard).sum() <= (got.shard != got.home_shard).sum()
    assert sharding.shard(odd).count() == len(ROWS) and sharding.shard(none).count() == 0
    monkeypatch.setattr(sharding, "PART", 40)
    one_key = spark.range(1000).select(F.lit(5).alias("doc_id"), F.lit("x").alias("text"))
    assert sharding.shard(one_key).groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


@pytest.mark.parametrize("load", [None, 0.25, 2.0])
def test_deal_is_a_ring_walk(load):
    """Against a walk of single keys: in each round every key without a place asks the point it has come to, in ring order."""
    points = sorted((i * 37 % 101, i % 4) for i in range(40))
    counts = {i: (i * 7) % 13 + 30 * (i == 5) for i in range(40)}
    room = sharding.capacities(sum(counts.values()), 4, load)
    left, at, got = list(room), {(a, k): a for a, n in counts.items() for k in range(n)}, {}
    while at:
        for point in range(40):
            for key in [k for k, p in at.items() if p == point]:
                if left[points[point][1]]:
                    left[points[point][1]] -= 1
                    got[key] = points[point][1]
                    del at[key]
        at = {k: (p + 1) % 40 for k, p in at.items()}
    plan = sharding.deal(counts, points, list(room))
    want = {a: np.bincount([got[a, k] for k in range(n)], minlength=4).tolist() for a, n in counts.items() if n}
    assert {a: np.bincount([s for n, s, _ in p for _ in range(n)], minlength=4).tolist() for a, p in plan.items()} == want


def test_arcs_by_table(spark):
    points = sharding.ring(spark, 4, 16)
    got = sharding.with_arcs(spark.range(3000).select(F.xxhash64("id").alias("at")), points).collect()
    assert all(r.arc == sum(p < r["at"] for p, _ in points) % len(points) for r in got)


def test_deal_keeps_counts():
    points = sorted((i * 37 % 101, i % 4) for i in range(40))
    counts = {i: (i * 7) % 13 for i in range(40)}
    plan = sharding.deal(counts, points, sharding.capacities(sum(counts.values()), 4, None))
    assert all(sum(n for n, *_ in plan.get(a, [])) == c for a, c in counts.items())
    assert {s: sum(n for p in plan.values() for n, t, _ in p if t == s) for s in range(4)} == dict(enumerate(sharding.capacities(sum(counts.values()), 4, None)))


def test_warc(spark):
    rows = [(1, None, None), (2, "http://a/ü b\n", "x" * 200), (3, None, "x" * 200), (3, None, "x" * 200), (None, "u", "x" * 200), (4, "", "short"), (5, "", "short"), (6, "é", "é" * 70)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages, scratch(spark, "wacz"))
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(str(p), len((t or "").encode()), sha(t), "revisit" if t == "x" * 200 and p != 2 else "response", 2 if t == "x" * 200 and p != 2 else None) for p, _, t in rows]
    assert got == sorted(want, key=str)
    a = warc.Archive(archives.first().path)
    first = next(a.index())
    assert a.record(first["offset"], first["length"])["headers"]["warc-type"] in ("response", "revisit")
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch(spark, "wacz"))).count() == 0


def test_zip64_directory(tmp_path):
    import struct

    data = b"hello"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(data), 5, 5, 1, 0) + b"a" + data
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    at = len(local)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path = tmp_path / "z.zip"
    path.write_bytes(local + central + end64 + locator + end)
    assert warc.Archive(str(path)).locate("a") == (31, 5)


def encoded(rows):
    tok = tokens._tokenizer(tokens.VOCABULARY)
    return [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]


def test_packing(odd, none):
    got = packing.pack(odd).toPandas()
    want = {}
    for d, ids in encoded(ROWS):
        x = np.array([*ids, 0], "<u4")
        for p, at in enumerate(range(0, len(x), 2048)):
            want.setdefault(str(d), []).append((p, at, len(x[at : at + 2048]), zlib.crc32(x[at : at + 2048].tobytes())))
    have = {}
    for r in got.itertuples():
        have.setdefault(str(None if np.isnan(r.doc_id) else int(r.doc_id)), []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    got = got.sort_values(["sequence_id", "offset"])
    end = got.offset + got.length
    assert (got.offset == end.groupby(got.sequence_id).shift(1).fillna(0)).all() and end.max() <= 2048
    assert packing.pack(none).count() == 0


def test_bins_fit_best():
    b = packing.Bins(10, 2)
    assert [b.put(n) for n in (6, 7, 3, 4, 9, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 9)]
    b = packing.Bins(10, 2)
    assert [b.put(n)[0] for n in (6, 7, 8, 4)] == [0, 1, 2, 0]  # 7 closes as the fullest when 8 comes; 4 still finds 6


def test_packing_is_tight(spark, sf):
    got = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert got[0] <= -(-got[1] // 2048) + 3


def test_token_files(spark, odd, none):
    manifest = token_files.write_token_files(odd, scratch(spark, "tids"), shards=3)
    got = token_files.read_token_files(manifest, part=2).orderBy("start").collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (d, ids) in zip(got, encoded(rows), strict=True):
        x = np.array([*ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    found = token_files.lookup(manifest, [3, 7, 99])
    assert found[3].tolist() == [*encoded([(3, "one two three four five six")])[0][1], 1] and len(found[7]) == 30_001 and found[99] is None
    assert token_files.read_token_files(token_files.write_token_files(none, scratch(spark, "tids"))).count() == 0


def test_lookups_read_as_much_in_any_shard(tmp_path):
    def read(n):
        path = f"{tmp_path}/{n}.tids"
        keys = np.arange(n, dtype=np.int64) * 3
        token_files._write_shard(path, 2, iter([(keys, np.zeros(n, bool), np.arange(n, dtype=np.uint32) % 60_000, np.ones(n, np.int64))]))
        shard = token_files.Shard(path)
        some = np.random.default_rng(1).integers(0, n, 300)
        assert [shard.find_one(int(keys[i])) for i in some] == some.tolist() == shard.find(keys[some]).tolist()
        shard.read = 0
        for i in some:
            shard.ids(shard.find_one(int(keys[i])))
        most, shard.read = shard.read, 0
        assert shard.find_one(1) == -1
        return most / len(some)

    small, large = read(1_000), read(1_000_000)
    assert large < 1.2 * small and large < 300, (small, large)


def test_token_files_repeat_a_key(spark):
    rows = [(5, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(10)] + [(None, "x"), (None, "y")]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark, "tids"), shards=4)
    assert manifest.count() > 2  # one key doesn't fill one file
    got = token_files.read_token_files(manifest, part=64).orderBy("start").collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for d, x in encoded(rows))
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    ids = [r.doc_id if r.doc_id is not None else -1 for r in got]
    assert ids == sorted(ids)


def test_perfect_hash():
    keys = np.random.default_rng(1).permutation(np.arange(50_000, dtype=np.int64) * 977 - 10**6)
    h = token_files.PerfectHash(token_files.PerfectHash.build(keys))
    assert sorted(h.number(keys)) == list(range(len(keys)))


def plain_anchors(text):
    """Hash and place of the anchors of a text, k-mer by k-mer."""
    raw = text.encode()
    b, m = bytes(8) + raw, (1 << 64) - 1

    def mx(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    out = []
    for i in range(len(b) - 15) if raw else ():
        g = [mx(int.from_bytes(b[i + j : i + j + 8], "little")) for j in range(9)]
        if min(g) in (g[0], g[8]):
            out.append((mx((g[0] * 0x9E3779B97F4A7C15 + g[8]) & m), i - 8))
    return out or ([(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"), 0)] if raw else [])


def test_syncmers(odd, none):
    def sketch(text):
        out = {}
        for h, at in plain_anchors(text):
            out[h >> 57] = min(out.get(h >> 57, (1 << 64, 0)), (h, at))
        size = len(text.encode()) + 8
        return {k: ((h & 0xFFFF) % 65535 + 1, (at + 8) * 65536 // size) for k, (h, at) in out.items()}

    def hexed(x):
        return "".join(f"{c:04x}{p:04x}" for c, p in (x.get(k, (0, 0)) for k in range(syncmers.BUCKETS))) if x else ""

    def like(x, y):
        if not x and not y:
            return 1.0
        pairs = sorted((x[k][1], y[k][1]) for k in x.keys() & y.keys() if x[k][0] == y[k][0])
        best = []
        for i, (_, q) in enumerate(pairs):
            best.append(1 + max((best[j] for j in range(i) if pairs[j][1] <= q), default=0))
        return max(best, default=0) / len(x.keys() | y.keys())

    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    want = []
    for (d, *_), a, b in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        e = syncmers.edited(a, b)
        x, y, z = sketch(a), sketch(e), sketch(b)
        want.append((str(d), len(a), hashlib.sha256(e.encode()).hexdigest(), hexed(x), hexed(y), like(x, y), like(x, z)))
    assert sorted((str(r[0]), *r[1:]) for r in syncmers.compare_with_next(odd).collect()) == sorted(want)
    assert syncmers.compare_with_next(none).count() == 0
    got = sorted((r.pos, r.anchor) for r in syncmers.positions(odd).where("doc_id = 8").collect())
    assert got == sorted((at, h - (1 << 64) * (h >> 63)) for h, at in plain_anchors(ROWS[-1][1]))


def test_likeness_by_positions():
    """Against all anchors: near the Jaccard likeness where passages keep their order, lower where they don't."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmno"), rng.integers(3, 9))) for _ in range(3000)]
    code = lambda t: syncmers._coded(*syncmers.sketches(*syncmers._flat([t])))
    off, turned = [], []
    for _ in range(60):
        a = list(rng.choice(words, 400))
        b = list(a)
        k, at = int(rng.integers(0, 300)), int(rng.integers(0, 100))
        b[at : at + k] = rng.choice(words, k + 5)
        one, two, moved = " ".join(a), " ".join(b), " ".join(a[250:] + a[:250])
        sets = [{h for h, _ in plain_anchors(t)} for t in (one, two)]
        off.append(abs(syncmers.likeness(code(one), code(two))[0] - len(sets[0] & sets[1]) / len(sets[0] | sets[1])))
        turned.append(syncmers.likeness(code(one), code(moved))[0])
    assert np.mean(off) < 0.05 and max(off) < 0.16 and 0.5 < np.mean(turned) < 0.75
    start, other, size, n = syncmers.matches(one, moved)[0]
    passage = " ".join(a[:250]).encode()
    assert n > 100 and start <= 16 and abs(other - start - moved.encode().index(passage)) == 0 and size > len(passage) - 48


def test_decontaminate(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    common = [word() for _ in range(30)]
    text = lambda n: " ".join(word() if rng.random() < 0.4 else str(rng.choice(common)) for _ in range(n))
    items = [(i, text(25) + ". " + text(8) + ".") for i in range(20)] + [(90, ""), (91, None)]
    docs = [(i, text(300)) for i in range(60)] + [(1000, None), (1001, ""), (None, "x " + items[3][1])]
    for i in range(20):  # whole copies, and copies with three words replaced
        w = items[i][1].split()
        if i % 2:
            for at in rng.integers(0, 20, 3):
                w[at] = word()
        docs.append((100 + i, text(rng.integers(1, 200)) + " " + " ".join(w) + " " + text(50)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(100 + i, i) for i in range(20)} | {(None, 3)}
    kept = {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs if d is None or not 100 <= d < 120}
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_decontaminate_long_items(spark):
    """Copies of items longer than any window and its neighbours, at any offset; also with repeated words and a fifth replaced."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    common = [word() for _ in range(30)]
    text = lambda n: " ".join(word() if rng.random() < 0.4 else str(rng.choice(common)) for _ in range(n))
    lengths = [60, 64, 65, 66, 96, 97, 129, 171, 233, 400, 1500]
    items = [(i, text(n - 8) + ". " + text(8) + ".") for i, n in enumerate(lengths)]
    docs = [(i, text(400)) for i in range(60)]
    want = set()
    for i, t in items:
        for j, before in enumerate((0, 17, 31, 150)):
            w = t.split()
            for at in rng.permutation(len(w))[: len(w) // 5 if j % 2 else 0]:
                w[at] = word()
            docs.append((100 + 10 * i + j, (text(before) + " " + " ".join(w) + " " + text(90)).strip()))
            want.add((100 + 10 * i + j, i))
    docs.append((900, " ".join(items[9][1].split()[:150]) + " " + text(200)))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_decontaminate_recall(spark):
    """Items edited to the edge of the acceptance rule: all that the rule takes by brute force, without the latent space, are found."""
    at = "/root/testdata/sf0.01"
    rng = np.random.default_rng(1)
    texts = [r.text for r in spark.read.parquet(f"{at}/documents.parquet").where("length(text) > 500").orderBy("doc_id").select("text").collect()]
    bench = spark.read.parquet(f"{at}/benchmark.parquet").where("text IS NOT NULL").select("item_id", "text")
    pool = np.array(" ".join(texts[:200]).split())
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    docs, want = [(i, t) for i, t in enumerate(texts)], set()
    for item_id, t in sorted(map(tuple, bench.collect())):
        answer = decontaminate.answer_of(t)
        for share in (0.65,) * 6 + (0.78,) * 2:
            w = t.split()
            for i in rng.permutation(len(w) - (len(answer.split()) if share < 0.7 else 0))[: round(len(w) * (1 - share))]:
                w[i] = str(rng.choice(pool))
            host = texts[rng.integers(len(texts))].split()
            i = int(rng.integers(0, len(host)))
            docs.append((10**6 + len(docs), " ".join([*host[max(0, i - 150) : i], *w, *host[i : i + 150]])))
            number = {x: n for n, x in enumerate(dict.fromkeys(words(t)))}
            seen = [number.get(x, -1) for x in words(docs[-1][1])]
            whole, said = (np.array([number[x] for x in words(x)], np.int64) for x in (t, answer))
            for s in range(0, len(seen), 32):
                near = seen[max(0, s - 32) : s + 96]
                common = decontaminate.lcs(whole, near) / len(whole)
                if common >= 0.75 or common >= 0.55 and len(said) and decontaminate.lcs(said, near) >= 0.8 * len(said):
                    want.add((docs[-1][0], item_id))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(want) > 300 and not want - got, (len(want), len(want - got))


def test_sparse_sums():
    """Rows summed per stripe, as by loops at any length, at well under the CPU time of np.add.reduceat, which took op7 over its limit."""
    rng = np.random.default_rng(4)
    dense = rng.integers(-9, 9, (3900, 240)).astype(np.float32)  # whole numbers, so that no order of sums rounds
    for lengths in ([], [1], [64, 0, 65, 1], [3, 0, 0, 5000, 2, 129, 0]):
        stripe = np.repeat(np.arange(len(lengths)), lengths)
        term = rng.integers(0, len(dense), len(stripe))
        want = np.array([dense[term[stripe == i]].sum(0) for i in range(len(lengths))]).reshape(-1, 240)
        assert np.array_equal(decontaminate._times(term, stripe, len(lengths), dense), want)

    stripe, term = np.sort(rng.integers(0, 2500, 6500)), rng.integers(0, len(dense), 6500)

    def reduceat(term, stripe, n, dense):
        out = np.zeros((n, dense.shape[1]), dense.dtype)
        at = np.flatnonzero(np.diff(stripe, prepend=-1))
        out[stripe[at]] = np.add.reduceat(dense[term], at, axis=0)
        return out

    def seconds(f):
        took = []
        for _ in range(7):
            start = time.process_time()
            f(term, stripe, 2500, dense)
            took.append(time.process_time() - start)
        return min(took)

    assert seconds(decontaminate._times) < 0.7 * seconds(reduceat)


def test_passage_frequencies(spark):
    """Of passages of two stripes at every stripe, those that hold a term, by brute force: terms repeated within and across stripes and texts."""
    rng = np.random.default_rng(6)
    items = decontaminate.Items([(i, " ".join(f"w{j}" for j in rng.integers(0, 40, 30))) for i in range(3)])
    texts = [" ".join(f"w{j}" if rng.random() < 0.1 else "other" for j in rng.integers(0, 60, n)) for n in (1, 31, 32, 33, 64, 65, 500, 1000)]
    sparse = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, h long, text string").mapInArrow(
        decontaminate._sparse(items.vocabulary), "doc_id long, h long, n long, pos array<int>, term array<int>"
    )
    windows = [set(decontaminate._of(t)[a : a + 64].tolist()) for t in texts if np.isin(decontaminate._of(t), items.vocabulary).any() for a in range(0, len(t.split()), 32)]
    idf, _ = decontaminate.latent_space(sparse, items, most=1.0)
    held = np.array([sum(w in x for x in windows) for w in items.vocabulary.tolist()])
    assert held.max() > 5 and np.allclose(idf, np.log((len(windows) + 1) / (held + 1)) + 1e-3)


def test_vocabulary_lookup():
    """Numbers of hashes, also where several share their first bits, and at both ends."""
    rng = np.random.default_rng(8)
    some = rng.integers(0, 1 << 64, 3000, np.uint64)
    vocabulary = np.unique(np.concatenate([some, some[:50] ^ np.uint64(1), np.arange(5, dtype=np.uint64), np.array([2**64 - 1], np.uint64)]))
    h = rng.permutation(np.concatenate([vocabulary, vocabulary ^ np.uint64(2), rng.integers(0, 1 << 64, 3000, np.uint64)]))
    for v in (vocabulary, vocabulary[:1], vocabulary[-1:]):
        k, hit = decontaminate._lookup(v)(h)
        assert np.array_equal(hit, np.isin(h, v)) and np.array_equal(v[k[hit]], h[hit])


def test_lcs():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 40))
        assert decontaminate.lcs(a, b.tolist()) == slow(a.tolist(), b.tolist())


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert ((out.predicted == out.quality).mean() > 0.9) and (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    bad = labels.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert {r.score for r in quality.classify(odd, bad).collect()} == {0.5} and quality.classify(odd, labels).count() == len(ROWS)
    assert quality.classify(none, labels).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns


def plain_bits(counts, total, scale, size):
    one, seen, pairs = counts
    p = (one / total + lm_scoring.EVEN / size) / (1 + lm_scoring.EVEN) if total > 0 else 1 / size
    return -np.log2((pairs * scale + lm_scoring.BACKOFF * p) / (seen * scale + lm_scoring.BACKOFF))


def test_lm_scoring_of_known_and_unknown_labels(spark):
    """Good documents score alike whether their labels were given or not: each good document in both roles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1 AND toxic = 0")
    halves = [{r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(docs, labels.where(f"doc_id % 2 = {k}")).collect()} for k in (0, 1)]
    good = [r.doc_id for r in labels.collect() if halves[0].get(r.doc_id) is not None]
    known, unknown = (np.array([halves[d % 2 if role else 1 - d % 2][d] for d in good]) for role in (True, False))
    others = np.array([s for d, s in halves[0].items() if s is not None and d not in set(good)])
    assert len(good) > 100 and abs(known.mean() - unknown.mean()) < 0.1 * unknown.std() and unknown.mean() < others.mean()


def test_lm_scoring(spark, odd, none, sf):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(lm_scoring.cross_entropy_difference(odd, labels).collect(), key=str)
    models = [[{}, {}, {}], [{}, {}, {}]]
    seqs = []
    for d, text, *_ in ROWS:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        uni, ctx, bi, _ = lm_scoring.tokens(raw, np.array([0, len(raw)]))
        seqs.append((d, list(zip(uni.tolist(), ctx.tolist(), bi.tolist(), strict=True))))
        for side in (0, 1) if d == 3 else (1,):
            for at in seqs[-1][1]:
                for kind in range(3):
                    models[side][kind][at[kind]] = models[side][kind].get(at[kind], 0) + 1

    def row(d, s):
        if not s:
            return d, 0, None, None
        out = []
        for side in (0, 1):
            own = [Counter(x[kind] for x in s) if side or d == 3 else {} for kind in range(3)]
            left = [{h: n - own[kind].get(h, 0) for h, n in models[side][kind].items()} for kind in range(3)]
            out.append((left, sum(left[0].values())))
        bits = [np.mean([plain_bits([m[0].get(u, 0), m[1].get(c, 0), m[2].get(b, 0)], n, 1 if side == 0 else out[0][1] / max(n, 1), len(models[1][0])) for u, c, b in s]) for side, (m, n) in enumerate(out)]
        return d, len(s), *bits

    want = sorted((row(d, s) for d, s in seqs), key=lambda r: (str(r[0]), r[1]))
    for r, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), want, strict=True):
        assert (r.doc_id, r.n_tokens) == w[:2]
        if w[1]:
            assert abs(r.target_bits - w[2]) < 1e-6 and abs(r.background_bits - w[3]) < 1e-6 and abs(r.score - (w[2] - w[3])) < 1e-6
        else:
            assert r.score is None
    assert lm_scoring.cross_entropy_difference(none, labels).count() == 0


def test_lm_scoring_counts_are_exact(spark, monkeypatch):
    """More words and bigrams than any table of a fixed size had classes for, over several chunks and ranges."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 400_000, raising=False)
    monkeypatch.setattr(lm_scoring, "RANGE", 500_000, raising=False)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60_000, 900))) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    got = lm_scoring.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    models = [[{}, {}, {}], [{}, {}, {}]]
    for d, text in rows:
        w = text.split()
        for side in (0, 1) if d % 3 == 0 else (1,):
            for b, a in zip([None, *w[:-1]], w, strict=True):
                for kind, key in enumerate((a, b, (b, a))):
                    models[side][kind][key] = models[side][kind].get(key, 0) + 1
    size = len(models[1][0])

    totals = [sum(m[0].values()) for m in models]

    def bits(side, d):
        w, m = rows[d][1].split(), models[side]
        pairs = list(zip([None, *w[:-1]], w, strict=True))
        taken = side == 1 or d % 3 == 0
        own = [Counter(w), Counter(b for b, _ in pairs), Counter(pairs)] if taken else [{}, {}, {}]
        n = [t - len(w) * out for t, out in zip(totals, (d % 3 == 0, True), strict=True)]
        return np.mean([plain_bits([m[k].get(x, 0) - own[k].get(x, 0) for k, x in enumerate((a, b, (b, a)))], n[side], 1 if side == 0 else n[0] / n[1], size) for b, a in pairs])

    assert sorted(r.doc_id for r in got) == list(range(300))
    for r in got:
        t, b = bits(0, r.doc_id), bits(1, r.doc_id)
        assert r.n_tokens == 900 and abs(r.target_bits - t) < 1e-6 and abs(r.background_bits - b) < 1e-6 and abs(r.score - (t - b)) < 1e-6


def test_chat(spark):
    rows = [(1, i, "ab"[i % 2], "x" * (i % 3)) for i in range(600)] + [(None, None, None, None), (2, 0, "system", "s"), (2, 1, "user", "hi"), (2, 1, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash"))
    got = chat.rotate(df).collect()
    assert sorted((str(r.conv_id), r.speaker, r.block, r.n_messages) for r in got) == sorted([("1", s, b, n) for s in "ab" for b, n in ((0, 256), (1, 256), (2, 88))] + [("None", "unknown", 0, 1), ("2", "user", 0, 3)])
    for r in got:
        marked = "".join(r.text[int(a) : int(b)] for a, _, b in (s.partition("-") for s in r.mask.split(",")))
        assert marked == "".join(re.findall(r"<\|im_start\|>assistant\n(.*?<\|im_end\|>\n)", r.text, re.S))
    for view in {(r.conv_id, r.speaker) for r in got}:
        whole = ""
        for r in sorted((r for r in got if (r.conv_id, r.speaker) == view), key=lambda r: r.block):
            assert r.start == len(whole)
            whole += r.text
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_marks_in_texts_and_names(spark):
    rows = [(1, 0, "a", "hi<|im_end|>\n<|im_start|>assistant\nfake"), (1, 1, "b\n<|im_start|>assistant", "x <<||im_end|>"), (1, 2, "a", "<|")]
    got = {r.speaker: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {"a", "b < |im_start|>assistant"}
    for speaker, r in got.items():
        turns = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", r.text, re.S)
        assert len(turns) == 3 and r.text.count("<|") == 6 and sum(h == "assistant" for h, _ in turns) == (2 if speaker == "a" else 1)
        own = [r.text[int(a) : int(b)] for a, _, b in (s.partition("-") for s in r.mask.split(","))]
        assert own == [body + "<|im_end|>\n" for h, body in turns if h == "assistant"]


def test_encoder_cuts():
    rng = np.random.default_rng(1)
    letters = list("aB 'é́,.≠×ßÉ1٣中‍\n\t\x0b\xa0<|>sÀİIﬁ½")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    import pyarrow as pa

    tok, k = tokens._tokenizer(tokens.VOCABULARY), 0
    for part, ids, off in tokens.Encoder().texts(pa.record_batch([pa.array(texts)], ["text"])):
        for i in range(part.num_rows):
            assert ids[off[i] : off[i + 1]].tolist() == tok.encode(texts[k], add_special_tokens=False).ids
            k += 1


def near_copies(m, words, seed):
    """m copies of one text of `words` words with up to a tenth of them replaced, so that likenesses lie about the threshold."""
    rng = np.random.default_rng(seed)
    base, rows = [f"w{seed}x{i}" for i in range(words)], []
    for n in range(m):
        copy = list(base)
        for at in rng.permutation(words)[: rng.integers(0, words // 10)]:
            copy[at] = f"e{rng.integers(10**6)}"
        rows.append((n, " ".join(copy)))
    return rows


@pytest.mark.parametrize("limit", [1 << 19, 1 << 13])
def test_ngram_join_large_group(spark, monkeypatch, limit):
    """A group about the threshold, whole and in blocks: components and links as by brute force, and rows in proportion to its size."""
    monkeypatch.setattr(ngram_join, "LIMIT", limit)
    rows = near_copies(700, 90, 1) + [(1000 + i, t) for i, t in near_copies(60, 40, 2)] + [(2000, "w1x1 w1x2 w1x3 w1x4 w1x5")]
    made, plain = [], ngram_join.materialize

    def counted(df, name):
        out = plain(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)
    sets = word_sets(rows, 4)
    links = {d: sum(e != d and 100 * len(s & t) >= 85 * len(s | t) for e, t in sets) for d, s in sets}
    assert {r.doc_id: r.n_links for r in got} == links and max(links.values()) > 100
    assert all(n <= 20 * len(rows) for name, n in made if name in ("near", "links", "clusters")), made


def test_long_texts_in_windows(monkeypatch):
    """Words longer than a window, and texts longer than a slice, hash and encode as short ones do."""
    from tessera.llm import common

    text = " ".join(["ab" * 700, "x", "é" * 500, "it's", "y" * 3000, ""] * 3).encode()
    data = np.frombuffer(text, np.uint8)
    off = np.array([0, len(data)])
    want = common.words(data, off)[0]
    ids = tokens.Encoder().encode(data, off)[0]
    monkeypatch.setattr(common, "WINDOW", 256)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 100)
    common.powers.cache_clear()
    assert (common.words(data, off)[0] == want).all() and (tokens.Encoder()._long(data) == ids).all()
    common.powers.cache_clear()


def test_quality_against_plain_trees():
    """Scores are sums of table entries, and tables are what plain boosting over the same bins gives."""
    rng = np.random.default_rng(8)
    x = np.round(rng.random((400, len(quality.NAMES))), 2)
    y = (x[:, 0] + (x[:, 1] > 0.5) * (x[:, 2] > 0.5) > 0.9).astype(float)
    m = quality.fit(x, y)
    slow = []
    for row in x:
        f = m.base
        for k in range(len(quality.NAMES)):
            f += m.tables[k][sum(e <= row[k] for e in m.edges[k])]
        for (a, b), t in zip(m.pairs, m.pair_tables, strict=True):
            f += t[sum(e <= row[a] for e in m.pair_edges[a]), sum(e <= row[b] for e in m.pair_edges[b])]
        slow.append(1 / (1 + np.exp(-max(-30, min(30, f)))))
    assert np.allclose(m.score(x), slow) and ((m.score(x) > 0.5) == y).mean() > 0.97
    g, h = rng.standard_normal(9), rng.random(9)
    best = max((g[:c].sum() ** 2 / (h[:c].sum() + 1) + g[c:].sum() ** 2 / (h[c:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1), c) for c in range(1, 9))
    assert np.allclose(quality._best_cut(g, h, 0, 9), best)
    leaf = quality._tree(g, h, 2)
    assert np.allclose(leaf[: best[1]], g[: best[1]].sum() / (h[: best[1]].sum() + 1))


def test_features_by_hand():
    text = "Good DAY to all!! a|b\nGood DAY to all!! a|b\n12 é?"
    data = np.frombuffer(text.encode(), np.uint8)
    got = dict(zip(quality.NAMES, quality.features(data, np.array([0, len(data)]))[0], strict=True))
    w, raw = text.split(), text.encode()
    filled = sum(b not in b" \n" for b in raw)
    letters = sum(chr(b).isalpha() and b < 128 for b in raw)
    upper = sum(65 <= b <= 90 for b in raw)
    want = {"log_words": np.log1p(len(w)), "word_bytes": np.mean([len(x.encode()) for x in w]), "upper": upper / letters, "digits": 2 / filled, "bangs": 4 / filled, "pipes": 2 / len(w), "distinct_words": len({x.lower() for x in w}) / len(w), "repeated_lines": 1 - 2 / 3, "sentence_ends": 1 / len(w), "shouted": 2 / len(w), "capitals": 4 / len(w), "line_words": np.log1p(len(w) / 3)}
    assert all(np.isclose(got[k], v) for k, v in want.items()), {k: (got[k], v) for k, v in want.items() if not np.isclose(got[k], v)}


def test_scratch_scope(spark):
    import os

    from tessera.llm.common import materialize, scratch_scope

    with scratch_scope(spark) as path:
        kept = materialize(spark.range(5), "numbers")
        assert kept.scratch_path.startswith(path) and kept.count() == 5
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_benchmark_of_several_blocks(spark):
    """More items than a block holds: each copy is found, whatever the order of the items."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 6))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(450)]
    docs = [(i, " ".join(word() for _ in range(60)) + " " + items[i][1] + " " + " ".join(word() for _ in range(60))) for i in range(0, 450, 9)]
    docs += [(1000 + i, " ".join(word() for _ in range(140))) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for order in (items, items[::-1]):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, spark.createDataFrame(order, "item_id long, text string")).collect()}
        assert got == {(i, i) for i in range(0, 450, 9)}
