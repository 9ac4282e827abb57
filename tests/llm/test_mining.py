"""Hard negatives, url filters and centroid clustering against brute force, and on odd tables."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import balltree, common, lloyd, registry, urls

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<double>, label int, query string, cluster int"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.prepared(spark)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_url_filter", "op13_centroids"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(c.execute(registry.oracle_sql()[name]).df())


def odd_vectors(rng, n=400, d=64):
    x = rng.standard_normal((n, d))
    x[100:240] = x[0]  # a third are equal
    x[240:260] = x[1] + 0.01 * rng.standard_normal((20, d))
    rows = [(i, v.tolist(), int(rng.integers(0, 3)) if i % 37 else None, "q", 9) for i, v in enumerate(x)]
    rows[2] = (2, None, 1, None, None)
    rows[3] = (3, [0.0] * d, 1, None, None)
    rows[4] = (4, [*x[4][:-1].tolist(), None], 1, None, None)
    rows[5] = (5, [*x[5][:-1].tolist(), float("nan")], 1, None, None)
    rows[6] = (6, [*x[6][:-1].tolist(), float("-inf")], 1, None, None)
    return [*rows, (None, x[8].tolist(), 1, "", 0), rows[9], rows[9], (10, x[11].tolist(), 2, "again", 1)]


def brute_negatives(rows, anchors):
    ok = lambda v: v is not None and all(a is not None and math.isfinite(a) for a in v)
    used = {(i, lab, tuple(math.floor(256 * a) for a in v)) for i, v, lab, *_ in rows if i is not None and lab is not None and ok(v)}
    out = []
    for i, lab, v in used:
        if i in anchors:
            score = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in used if j != i)
            for p, j, _ in [s for s in score if s[2] == lab][:5]:
                fit = [s for s in score if s[2] != lab and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
                out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return Counter(out)


def test_hard_negatives(spark):
    rows = odd_vectors(np.random.default_rng(1))
    df, anchors = spark.createDataFrame(rows, VEC), set(range(0, 400, 7)) | {10}
    asked = df.where(F.col("vec_id").isin([*anchors])).select("vec_id")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for shard in (50, 100_000):  # many shards, or one
        got = balltree.hard_negatives(df, asked, shard=shard)
        assert got.columns == names and Counter(map(tuple, got.collect())) == brute_negatives(rows, anchors)
    assert balltree.hard_negatives(df.limit(0), asked).count() == 0 and balltree.hard_negatives(df, asked.limit(0)).count() == 0
    lone = spark.createDataFrame([(1, [1.0, 2.0], 1, "", 0), (2, [1.0, 1e300], 1, "", 0), (3, [3.0, 1.0], 2, "", 0)], VEC)
    assert balltree.hard_negatives(lone, lone.select("vec_id")).count() == 0  # 1e300 has no score that fits a long
    with pytest.raises(ValueError, match="several dimensions"):
        balltree.hard_negatives(spark.createDataFrame([(1, [1.0, 2.0], 1, "", 0), (2, [1.0], 1, "", 0)], VEC), lone.select("vec_id"))


def test_ball_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    centre = rng.integers(-3000, 3000, (60, 16))
    v = centre.repeat(50, 0) + rng.integers(-30, 30, (3000, 16))
    ids, label = rng.permutation(3000), rng.integers(0, 5, 3000)
    tree, at = balltree.BallTree(ids, label, v), np.arange(0, 3000, 30)
    score = v[at] @ v.T
    for same, low, high in ((True, None, None), (False, 0.2, 0.3), (False, 0.9, 1.0)):
        lo = np.full(100, balltree.NONE + 1) if same else (score.max(1) * low).astype(np.int64)
        hi = np.full(100, balltree.ALL) if same else (score.max(1) * high).astype(np.int64)
        got, _, read = tree.best(v[at], ids[at], label[at], same, lo, hi, 5)
        for q in range(100):
            own = np.flatnonzero(((label == label[at[q]]) == same) & (ids != ids[at[q]]) & (score[q] >= lo[q]) & (score[q] <= hi[q]))
            assert got[q][got[q] >= 0].tolist() == ids[own[np.lexsort((ids[own], -score[q][own]))][:5]].tolist()
        assert read < {None: 0.2, 0.3: 0.85, 1.0: 0.4}[high] * score.size
    big = rng.integers(-(1 << 27), 1 << 27, (40, 64))
    assert balltree.products(big, big).tolist() == [[sum(a * b for a, b in zip(x, y, strict=True)) for y in big.tolist()] for x in big.tolist()]


def brute_clusters(rows, k, rounds, scale, dims):
    ok = lambda v: v is not None and len(v) == dims and all(a is not None and math.isfinite(a) for a in v)
    used = [(i, v, [math.floor(scale * a) for a in v]) for i, v, *_ in rows if ok(v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [x[2] for x in sorted(used, key=lambda x: (*name(x[0]), x[1]))[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    for r in range(rounds + 1):
        own = [min((far(v, w), j) for j, w in enumerate(c)) for _, _, v in used]
        if r < rounds:
            for j in {j for _, j in own}:
                mine = [v for (_, _, v), (_, o) in zip(used, own, strict=True) if o == j]
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _, _), (d, j) in zip(used, own, strict=True))


def test_clusters(spark):
    rows = odd_vectors(np.random.default_rng(3)) + [(500, [1.0] * 63, 1, "", 0), (501, [1.0] * 65, 1, "", 0), (502, [], 1, "", 0)]
    df = spark.createDataFrame(rows, VEC)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for parts in (1, 7):
        got = lloyd.clustered(df.repartition(parts))
        assert got.columns == names and Counter(map(tuple, got.collect())) == brute_clusters(rows, 16, 3, 64, 64)
    assert Counter(map(tuple, lloyd.clustered(df.limit(9)).collect())) == brute_clusters(rows[:9], 16, 3, 64, 64)
    assert lloyd.clustered(df.limit(0)).count() == 0
    assert lloyd.clustered(df.where("vec_id = 7").union(spark.createDataFrame([(8, [1e300] * 64, 1, "", 0)], VEC))).count() == 1  # 1e300: no distance that fits a long
    ties = spark.createDataFrame([(i, [float(i % 2)] * 64, 1, "", 0) for i in range(40)], VEC)
    assert Counter(map(tuple, lloyd.clustered(ties).collect())) == brute_clusters([(i, [float(i % 2)] * 64) for i in range(40)], 16, 3, 64, 64)


URLS = [
    None, "", "example.org/en/", "http://example.org", "http://EXAMPLE.org/en/1", "http://a.b.Example.ORG/en/12?x=://", "https://example.org/en/2", "http://notexample.org/es/", "http://org/", "http://org", "x://.org/", "x://org./",
    "http://a..org/q", "http://example.org/es", "http://example.org/es/", "http://example.org/ES/", "ftp://m.com/fr/9#f", "ftp://m.com/de/9", "ftp://m.com/de?q=/de/", "http://m.com/fr", "http://com/de/x/../fr/", "://com/de/", "a://b://com/de/",
    "http://example.org:80/es/", "http://u@example.org/es/", "http://É.org/é/1", "http://example.net/" + "a/" * 30_000, "http://example.org/en/1" + "z" * 50_000, "http:///en/1", "http://x.org/\n?y", "http://\n.org/a",
]


def brute_verdict(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, otherwise)


def test_url_filter(spark):
    more = [("block", "com", ""), ("allow", "b.example.org", "/"), ("block", "org", "/en/12345678"), ("allow", "ab.com", "/"), ("block", "com", "/abc"), ("allow", "net", "/a/a"), ("block", "net", "/a/a"), ("allow", "", "/"), ("block", "x.org", None), ("allow", "é.org", "/é/")]
    words = ["http://ab.com/abc", "http://ab.com/abcd", "http://b.example.org/en/12345678", "http://zz.net/a/ab/c", "http://net/a", "http://a.é.org/é/"]
    df = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate([*URLS, *words, *URLS])], "page_id long, url string, host string, Rule string")
    for rules in (urls.RULES, urls.RULES + more, []):
        known = spark.createDataFrame(rules, "verdict string, host string, path string")
        for most in (1000, 0):  # as a trie, and joined
            got = urls.judged(df, known, otherwise="block", most_rules=most)
            assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
            assert {r.page_id: tuple(r)[2:] for r in got.collect()} == {i: brute_verdict(u, rules, "block") for i, u in enumerate([*URLS, *words, *URLS])}
    known = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    assert urls.judged(df.limit(0), known).count() == 0
