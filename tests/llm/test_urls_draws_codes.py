"""URL rules, importance resampling and vector codes against brute force, on small and odd inputs."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tessera.llm import importance, url_filter, vector_codes

UPPER = {i: i + 32 for i in range(65, 91)}


# ---------------------------------------------------------------- url rules


def cut(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(url, rules):
    host, path = cut(url)
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if h is not None and p is not None and (host == h.translate(UPPER) or host.endswith("." + h.translate(UPPER))) and path.startswith(p)]
    best = max(fit, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


URLS = [
    None, "", "no scheme.com/en/", "http://", "http://com", "http://com/", "http://COM/", "HTTPS://WWW.Example.COM/en/x?q=/es/#y", "http://www.example.com/en", "http://m.example.com/en/", "http://xexample.com/en/", "http://a.net/es/1", "http://a.net/ES/1",
    "http://a.net?/es/", "http://a.net#/fr/", "http://net/fr/", "a://b://c.net/es/", "http://example.com:80/en/", "http://..com/", "http://.com/", "http://é.com/ü/", "http://a.com//x//y/", "http://a.com/part/one", "http://a.com/partial", "http://a.com/par",
    "http://" + "a." * 50_000 + "com/" + "/x" * 50_000, "http://a.net/es/1", "http://a\nb.com/\n/",
]
MORE = [*url_filter.RULES, ("block", "a.com", "/part"), ("block", "A.com", "/"), ("allow", "b.a.com", ""), ("allow", None, "/"), ("block", "com", None), ("odd", "a.com", "//x/"), ("allow", "net", "/es/"), ("block", "com", "/")]


@pytest.mark.parametrize("rules", [url_filter.RULES, MORE, []])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(None if i == 3 else i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    table = url_filter.rule_table(spark, rules) if rules else spark.createDataFrame([], url_filter.RULE)
    plain = [("allow" if v == "allow" else "block", h, p) for v, h, p in rules]
    got = sorted(map(tuple, url_filter.judge(pages, table).collect()), key=repr)
    want = []
    for i, u in enumerate(URLS):
        host, path, rule, verdict = judged(u, plain)
        lower = [h.translate(UPPER) + p for v, h, p in plain if h is not None and p is not None]
        want.append((None if i == 3 else i, host, path, next((x for x in lower if rule is not None and x == rule.translate(UPPER) or x == rule), rule), verdict))
    assert got == sorted(want, key=repr)


def test_urls_empty_and_hot(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.rule_table(spark)).count() == 0
    hot = spark.range(3000).selectExpr("id AS page_id", "if(id % 3 = 0, 'http://hot.net/es/', concat('http://h', id, '.net/es/', id)) AS url")
    assert url_filter.judge(hot, url_filter.rule_table(spark)).where("verdict = 'block' AND rule = 'net/es/'").count() == 3000


# ---------------------------------------------------------------- importance resampling


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def drawn(docs, target, least=20, share=(5, 100)):
    found = [(d, *grams(t)) for d, t in docs]
    corpus, wanted = np.zeros(10_000, int), np.zeros(10_000, int)
    for total, all_of in ((corpus, [f for _, _, f in found]), (wanted, [grams(t)[1] for t in target])):
        for f in all_of:
            for c in f:
                total[c % 10_000] += 1
    s, t = int(corpus.sum()), int(wanted.sum())
    gain = [math.floor(1000 * math.log((b + 1) * (s + 10_000) / ((a + 1) * (t + 10_000)))) for a, b in zip(corpus.tolist(), wanted.tolist(), strict=True)]
    rows = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % 10_000] for c in f)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: share[0] * len(able) // share[1]]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


DOCS = [
    (1, None), (2, ""), (None, "one two three " * 9), (3, "One two THREE! " * 9), (3, "One two THREE! " * 9), (4, "a-b c" * 30), (5, "é×÷ it's <|x|> ok. ́x " * 7), (6, " \n "), (7, "x" * 5000 + " " + "y" * 47 + " " + "z" * 49),
    *[(10 + i, " ".join(f"w{(i * j) % 17}" for j in range(15 + i))) for i in range(40)],
]
BENCH = ["one two w1 w2 w3", None, "w1 w4 w9 w16", "ok"]


@pytest.mark.parametrize("part", [importance.PART, 3])
@pytest.mark.parametrize("share", [(5, 100), (60, 100), (100, 100), (0, 100)])
def test_draws(spark, monkeypatch, part, share):
    monkeypatch.setattr(importance, "PART", part)
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in DOCS], "doc_id long, text string, score int, rank string")
    target = spark.createDataFrame([(i, t) for i, t in enumerate(BENCH)], "item_id long, text string")
    got = importance.resample(docs, target, share=share)
    assert sorted(map(tuple, got.collect()), key=repr) == drawn(DOCS, BENCH, share=share)


def test_draws_of_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(importance, "PART", 10)
    rows = [(i // 3, 30, 7) for i in range(150)] + [(i, 30, 5) for i in range(40)] + [(i, 3, 99) for i in range(5)] + [(None, 30, 7)]
    got = importance.draw(spark.createDataFrame(rows, "doc_id long, n_words long, score long"), share=(90, 100)).collect()
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[2], r[0] is None, r[0] or 0))
    most = 90 * len(able) // 100
    assert sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"]) == [(i + 1, d, s) for i, (d, _, s) in enumerate(able[:most])] and len(got) == len(rows)


def test_draws_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    some = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert sorted(map(tuple, importance.resample(some, none).collect()), key=repr) == drawn(DOCS, [])


@pytest.mark.parametrize("text", ["Ab cd, " * 300, "é" * 700 + " b c " + "x" * 900 + "!d", "", "z" * 1500, "a " * 500 + "b" * 40])
def test_features_in_windows(monkeypatch, text):
    monkeypatch.setattr(importance, "WINDOW", 64)
    data = np.frombuffer(text.encode(), np.uint8)
    n, got = 0, [[], [], []]
    for words, by_size in importance.features(data, np.array([0, len(data)])):
        n += len(words)
        for k, (_, crc) in enumerate(by_size):
            got[k] += crc.tolist()
    assert (n, sum(got, [])) == grams(text)


# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for *_, v in kept), default=0) // parts))
    most = 1 << int((60 - math.log2(width * parts)) // 2)
    ints = [[max(-most, min(most, math.floor(4096 * float(x)))) for x in v] + [0] * (width * parts - len(v)) for *_, v in kept]
    first = [v for _, v in sorted(zip([(i is None, i or 0) for i, *_ in kept], ints, strict=True))[:entries]]
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for p in range(parts):
        own, book = [v[p * width : (p + 1) * width] for v in ints], [v[p * width : (p + 1) * width] for v in first]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
        for _ in range(rounds):
            at = [near(x, book)[1] for x in own]
            book = [[sum(c) // len(c) for c in zip(*[x for x, k in zip(own, at, strict=True) if k == j], strict=True)] if j in at else e for j, e in enumerate(book)]
        for k, x in enumerate(own):
            e, j = near(x, book)
            codes[k].append(j)
            errors[k] += e
        books += book
    by_label = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    name = hashlib.sha256(",".join(str(x) for e in books for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in cs), e, by_label[label], name) for (i, label, _), cs, e in zip(kept, codes, errors, strict=True)), key=repr)


def embeddings(kind):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(60)]
    if kind == "few":
        return rows[:5]
    if kind == "hot":
        return [(i, rows[0][1] if i % 3 else v, None if i % 2 else l) for i, v, l in rows]
    if kind == "odd":
        bad = [(100, None, 1), (101, [None] + [0.0] * 15, 1), (102, [float("nan")] + [0.0] * 15, 1), (103, [float("inf")] * 16, 1), (0, rows[1][1], 2), (0, rows[1][1], 2), (None, rows[2][1], None), (104, [], 7), (105, [1e30, -1e30, 0.5], 7), (106, rows[3][1] + [1.0], 1)]
        return rows + bad
    return rows


@pytest.mark.parametrize("kind", ["plain", "few", "hot", "odd"])
def test_codes(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(vector_codes, "AT_ONCE", 7)
    rows = embeddings(kind)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, part int")
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, vector_codes.op13(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain_codes(rows)


def test_codes_of_nothing(spark, tmp_path):
    for i, rows in enumerate(([], [(1, None, 1)])):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / f"{i}/embeddings.parquet"))
        assert vector_codes.op13(spark, str(tmp_path / str(i))).count() == 0
