"""The training-data operators against brute force, exact round trips and held-out accuracy, and their behaviour on odd tables."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfloom.llm import common, forest, hamming, jaccard, licenses, packing, pieces, pii, pseudo, registry, tokenfile, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, label int"
ODD = ["", "  ", "don't  stop'S it's\n\n  x ", "<|endoftext|> a<|startoftext|>", "日本語 text  混ぜ\tfoo 漢字bar, baz", "é café ﬁ İstanbul ΣΑΣ", "a　b  　c\xa0 d", "1234 ²³ ½x 12a", "emoji 😀😀 ok \n 😀", "ab\r\n\r\ncd   ", "ABC'D'LL", "x\x00y \x07", "▁x ▁", "word " * 3000]


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.prepared(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, odd and repeated texts, ties, repeated rows, columns with clashing names."""
    rows = [(i, t, None, "s", 1, 0.5, 7, 1) for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None, None, None, None), (None, "no id here at all", "en", None, None, None, None, None), rows[2], rows[2]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids_of(name, texts):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_words_equal_the_library(name, kind):
    enc = tokens.WordEncoder(P.path(name), kind, most_words=200)
    rng = np.random.default_rng(1)
    texts = ODD + ["".join(rng.choice(list("ab cE'\n\t .,1²é日😀́-_sStTlL "), int(n))) for n in rng.integers(1, 40, 500)]
    for batch in (texts, texts[::-1]):
        assert [x.tolist() for x in enc.ids(batch)] == [x[:-1].tolist() for x in ids_of(name, batch)]


def check_packing(rows, docs, size=2048):
    ids = {k: v for k, v in zip(docs.doc_id, ids_of("byte_bpe_50k.json", docs.text), strict=True)}
    for r in rows.itertuples():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length > 0
    assert rows.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for _, s in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= size


def test_packing(spark, documents):
    rows = registry.queries()["op1_packing"](spark, SF).toPandas()
    check_packing(rows, documents.toPandas())
    total = rows.groupby("sequence_id").length.sum()
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in total) < 0.03 * total.sum()


def test_packing_of_odd_documents(spark, odd):
    own = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.packed(own, P.path("byte_bpe_50k.json")).toPandas(), own.toPandas())
    assert packing.packed(odd, P.path("byte_bpe_50k.json")).count() >= odd.count()
    assert packing.packed(odd.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_windows_are_cheapest():
    rng = np.random.default_rng(2)

    def cost(at, pen, size, least):
        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                n = at[j] - at[i]
                if n <= size:
                    pad = 0 if n >= least and n & (n - 1) == 0 else size - n
                    best[j] = min(best[j], best[i] + pad + pen[j])
        return best[-1]

    for _ in range(60):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, int(rng.integers(1, 40))))])
        pen = rng.integers(0, 6, len(at))
        path = packing.windows(at, pen, 16, 4)
        own = sum((0 if (n := at[b] - at[a]) >= 4 and n & (n - 1) == 0 else 16 - n) + pen[b] for a, b in zip(path, path[1:], strict=False))
        assert path[0] == 0 and path[-1] == len(at) - 1 and own == cost(at.tolist(), pen.tolist(), 16, 4)


def test_licenses(spark, odd):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    key = lambda d: sorted(map(tuple, d[["doc_id", "license_id", "whole", "n_lines"]].values.tolist()))
    assert key(registry.queries()["op2_license_scan"](spark, SF).toPandas()) == key(c.execute(registry.oracle_sql()["op2_license_scan"]).df())
    known = licenses.known_digests(spark)
    text = "Copyright (c) 2020 Someone\n\n" + licenses.KNOWN[0][1].replace("Permission", "PERMISSION").replace(",", " ,").replace("sublicense", "sub-license")
    docs = spark.createDataFrame([(1, text), (1, "x"), (2, "Licenced under the Apache Licence -- version 2.0!\nprose"), (3, None), (4, ""), (None, "Licensed under CC BY 4.0")], "doc_id long, text string")
    got = {tuple(r) for r in licenses.license_scan(docs, known).collect()}
    assert got == {(1, "MIT", True, 0), (2, "Apache-2.0", False, 1), (None, "CC-BY-4.0", True, 1)}
    assert licenses.license_scan(odd, known).count() == 0


def test_license_notices(spark):
    notices = [
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Released under GPLv3"), ("GPL-2.0-or-later", "This program is licensed under the GNU General Public License v2.0 or later."),
        ("LGPL-2.1", "This library is licensed under the LGPL-2.1 license."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("Apache-2.0", "This project is licensed under the Apache License 2.0"),
        ("MIT", "This file is licensed under the MIT licence."), ("MPL-2.0", "This software is licensed under the Mozilla Public License, v. 2.0."), ("BSD-3-Clause", "This code is licensed under the BSD 3-Clause License"),
        ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("CC-BY-SA-3.0", "This content is licensed under CC BY-SA 3.0"), ("CC0-1.0", "Released under CC0 1.0 Universal."),
        ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ]
    texts = [(n, t) for n, t in licenses.KNOWN if len(t) > 5000]
    assert {n for n, _ in texts} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"}
    docs = [(k, "Some prose.\n" + t + "\nMore prose.") for k, (_, t) in enumerate(notices)] + [(1000 + k, t.upper()) for k, (_, t) in enumerate(texts)]
    got = {tuple(r)[:3] for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), licenses.known_digests(spark)).collect()}
    assert got == {(k, n, False) for k, (n, _) in enumerate(notices)} | {(1000 + k, n, True) for k, (n, _) in enumerate(texts)}


def vectors(rng, n=600, d=16):
    x = rng.standard_normal((n, d))
    x[100:150] = x[0] + 0.01 * rng.standard_normal((50, d))
    x[200:230] = x[1]
    rows = [(i, v.tolist(), int(i % 3) if i % 50 else None, "extra") for i, v in enumerate(x)]
    rows[5] = (5, None, 1, "")
    rows[6] = (6, [0.0] * d, 1, "")
    rows[7] = (7, [*x[7][:-1].tolist(), None], 1, "")
    rows[8] = (8, [*x[8][:-1].tolist(), float("nan")], 1, "")
    rows[9] = (9, [*x[9][:-1].tolist(), float("inf")], 1, "")
    return rows


VEC = "vec_id long, embedding array<double>, label int, key string"


def usable(v):
    return v is not None and all(a is not None and np.isfinite(a) for a in v) and any(v)


def test_nearest(spark):
    rows = vectors(np.random.default_rng(4))
    df = spark.createDataFrame(rows, VEC)
    got = forest.nearest(df, df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), shard=200, block=10).toPandas()
    good = {r[0]: np.array(r[1]) for r in rows if usable(r[1])}
    hit = total = 0
    for q in [i for i in good if i % 20 == 0]:
        own = got[got.query_id == q].sort_values("rank")
        exact = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:20]
        hit += len({i for _, i in exact} & set(own.vec_id))
        total += 20
        assert own["rank"].tolist() == list(range(1, 21))
        assert [(-s, v) for s, v in zip(own.score, own.vec_id, strict=True)] == sorted((-s, v) for s, v in zip(own.score, own.vec_id, strict=True))
        assert np.allclose([(good[q] * good[v]).sum() for v in own.vec_id], own.score, rtol=0, atol=1e-12)
    assert hit / total > 0.9
    assert forest.nearest(df.limit(0), df.limit(0).select(F.col("vec_id").alias("query_id"), "embedding")).count() == 0


def test_nearest_reads_little_of_clustered_vectors(spark):
    rng = np.random.default_rng(21)
    centre = rng.standard_normal((200, 32))
    x = np.repeat(centre, 20, axis=0) + 0.15 * rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = forest.Forest(x, 1.0)
    hit = read = 0
    for q, own in zip(range(0, 4000, 40), f.candidates(x[::40], int(0.3 * len(x))), strict=True):
        best = np.lexsort((np.arange(4000), -(x @ x[q])))[1:21]
        hit += np.isin(best, own).sum()
        read += len(own)
    assert hit / 2000 >= 0.9 and read / 100 / 4000 < 0.3
    with pytest.raises(ValueError, match="several dimensions"):
        rows = spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [1.0], 1, "")], VEC)
        forest.nearest(rows, rows.select(F.col("vec_id").alias("query_id"), "embedding"))


def test_queries_on_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    good = {r.vec_id: np.array(r.embedding, float) for r in e.itertuples() if usable(r.embedding)}
    ids, x = np.array(sorted(good)), np.stack([good[i] for i in sorted(good)])
    got = registry.queries()["op3_nearest"](spark, sf).toPandas()
    hit = total = 0
    for q in [i for i in ids.tolist() if i % 20 == 0]:
        own = got[got.query_id == q].sort_values("rank")
        score = (x * good[q]).sum(1)
        best = [i for i in ids[np.lexsort((ids, -score))].tolist() if i != q][:20]
        assert np.allclose(own.score, [(good[v] * good[q]).sum() for v in own.vec_id], rtol=0, atol=1e-12)
        hit, total = hit + len(set(best) & set(own.vec_id)), total + len(best)
    assert hit >= 0.9 * total
    links = registry.queries()["op4_embedding_dedup"](spark, sf).toPandas().set_index("vec_id")
    label = dict(zip(e.vec_id, e.label, strict=True))
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([label[i] for i in ids.tolist()])
    expected = ((n @ n.T >= 0.98) & (same[:, None] == same[None, :])).sum(1) - 1
    assert len(links) == len(e) and links.n_links[ids].tolist() == expected.tolist()


def test_hamming_tables_at_scale(spark):
    # 20,000 vectors in two labels; a third of them one group of near copies, pairs just above the threshold elsewhere
    rng = np.random.default_rng(22)
    x = rng.standard_normal((20_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:3000] = x[0] + 0.01 * rng.standard_normal((3000, 24))
    for k in range(4000, 6000, 2):
        side = rng.standard_normal(24)
        side -= side @ x[k] * x[k]
        x[k + 1] = 0.981 * x[k] + np.sqrt(1 - 0.981**2) * side / np.linalg.norm(side)
    label = (np.arange(20_000) // 2) % 2
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x.tolist(), "label": label}), "vec_id long, embedding array<double>, label int")
    got = hamming.linked_vectors(df, block=512).toPandas().set_index("vec_id").sort_index()
    n = x / np.sqrt((x * x).sum(1))[:, None]
    for own in (0, 1):
        at = np.flatnonzero(label == own)
        expected = np.concatenate([(n[at[i : i + 500]] @ n[at].T >= 0.98).sum(1) - 1 for i in range(0, len(at), 500)])
        assert (got.n_links.to_numpy()[at] == expected).mean() > 0.999 and abs(got.n_links.to_numpy()[at].sum() - expected.sum()) <= 0.002 * expected.sum()


def test_embedding_dedup(spark):
    rows = vectors(np.random.default_rng(5))
    got = hamming.linked_vectors(spark.createDataFrame(rows, VEC), block=32).toPandas().set_index("vec_id")
    good = [(i, np.array(v), lab) for i, v, lab, _ in rows if usable(v) and lab is not None]
    parent = {r[0]: r[0] for r in rows}
    links = defaultdict(int)

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, v, lab) in enumerate(good):
        for j, w, other in good[:k]:
            if lab == other and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    assert {i: got.n_links[i] for i in parent} == {i: links[i] for i in parent}
    assert {i: got.component_id[i] for i in parent} == {i: top(i) for i in parent}
    assert (got.kept == (got.index == got.component_id)).all()
    twice = spark.createDataFrame([*rows, rows[0], rows[0], (None, rows[0][1], 1, "x"), (1, rows[3][1], 2, "other vector")], VEC)
    again = hamming.linked_vectors(twice).toPandas()
    assert len(again) == len(rows) + 4 and (again[again.vec_id == 0].n_links == links[0] + (2 if rows[0][2] is not None else 0)).all() and again.vec_id.isna().sum() == 1
    with pytest.raises(ValueError, match="several dimensions"):
        hamming.linked_vectors(spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [1.0], 1, "")], VEC))
    assert hamming.linked_vectors(spark.createDataFrame([], VEC)).count() == 0


def brute_jaccard(rows):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 180 * len(s & sets[j]) >= 80 * (len(s) + len(sets[j])):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least[top(i)], d)
    return {d: (len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)}


def near_copies(rng, n=120):
    words = [f"w{i}" for i in range(400)]
    base = [str(w) for w in rng.choice(words, 80)]
    rows = []
    for i in range(n):
        own = list(base) if i % 3 else [str(w) for w in rng.choice(words, int(rng.integers(1, 90)))]
        for _ in range(int(rng.integers(0, 4)) if i % 3 else 0):
            own[int(rng.integers(len(own)))] = str(rng.choice(words))
        rows.append((i * 3 + 1, " ".join(own)))
    return [*rows, (1000, ""), (1001, None), (1002, "One two"), (1003, "one  TWO"), (1004, rows[0][1])]


def test_jaccard(spark, documents):
    rows = near_copies(np.random.default_rng(6))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block_entries=500)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_jaccard(rows)
    own = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op5_ngram_jaccard"](spark, SF).collect()} == brute_jaccard(own)


def test_jaccard_blocks():
    rng = np.random.default_rng(7)
    rows = near_copies(rng, 90)
    expected = brute_jaccard(rows)
    sets = jaccard.shingle_sets([t or "" for _, t in rows])
    keep = [k for k, s in enumerate(sets) if len(s)]
    nodes = np.array([rows[k][0] for k in keep])
    label = dict(zip(nodes.tolist(), nodes.tolist(), strict=True)) | dict(jaccard.linked(nodes, [sets[k] for k in keep], np.zeros(len(keep), int), 80, cells=300))
    assert label == {d: expected[d][1] for d in label}


def test_jaccard_of_short_pairs_at_the_threshold(spark):
    # 4 to 36 shingles; the copy lacks so many words of its end that the similarity is just 0.8 or next above
    rng = np.random.default_rng(11)
    rows = []
    for k in range(1500):
        n = int(rng.integers(9, 41))
        own = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: n - (n - 4) // 5]))]
    expected = {d: (len(t.split()) - 4, d // 2 * 2) for d, t in rows}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == expected
    some = rows[:300]
    assert {d: expected[d] for d, _ in some} == brute_jaccard(some)


def test_jaccard_of_odd_documents(spark, odd):
    got = jaccard.jaccard_components(odd).toPandas()
    assert len(got) == odd.count() and got[got.doc_id == 100].values.tolist() == [[100, 0, 100]]
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0


def test_split_clusters(spark):
    rows = near_copies(np.random.default_rng(8), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(d, jaccard.digest(s), len(s)) for (d, t), s in zip(rows, jaccard.shingle_sets([t or "" for _, t in rows]), strict=True) if len(s)]
    members = spark.createDataFrame([(d, k, n, 1) for d, k, n in {k: (d, k, n) for d, k, n in reversed(sets)}.values()], "doc_id long, node long, n_shingles long, cluster long")
    found = common.components(jaccard.product(docs, members, 5, 80, block_nodes=7))
    comp = {r.node: r.component for r in found.collect()}
    expected = brute_jaccard(rows)
    groups, ours = defaultdict(set), defaultdict(set)
    for d, k, _ in sets:
        groups[expected[d][1]].add(d)
        ours[comp.get(k, k)].add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_components(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 460)] + [(1, 1), (None, 2)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p if x is not None}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


def test_pii(spark, odd):
    text = "mail a.b@c.de or x@y, ip 1.2.3.4 and 1.2.3.999 card 4539 1488 0343 6467, call +1 (469) 555-8958 now; password=b7db7aa4a5fcc78305 ok"
    base, every = next(iter(pii.spans_of([text], pii.field())))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in base] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (469) 555-8958")]
    assert set(base) <= set(every) and "b7db7aa4a5fcc78305" in [text[a:b] for a, k, b in every if pii.KINDS[k] == "secret"]
    assert pii.found(odd).count() == odd.count() and pii.found(odd.limit(0)).count() == 0
    masked = pii.redacted(spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id long, text string, spans string")).collect()
    assert masked[0].text.startswith("mail [email] or x@y, ip [ip]") and masked[1].text is None and masked[0].spans == "x"


def test_viterbi_and_skipping():
    rng = np.random.default_rng(10)
    w, t = pii.field()
    for n in range(1, 6):
        e = rng.standard_normal((1, n, 5))
        paths = np.stack(np.meshgrid(*[range(5)] * n, indexing="ij"), -1).reshape(-1, n)
        score = e[0, np.arange(n), paths].sum(1) + t[paths[:, :-1], paths[:, 1:]].sum(1)
        assert pii.viterbi(e, np.array([n]), t)[0].tolist() == paths[score.argmax()].tolist()
    held = pii.labelled()
    wrong = sum((pii.tagged(" ".join(toks).encode(), (w, t))[2] != np.array(y)).sum() for toks, y in held)
    assert wrong <= 0.01 * sum(len(y) for _, y in held)


def literal_scores(docs, weights, counts):
    """Each text's sum of log P(group) P(class | group) P(word | class), word by word."""
    e, b, og, cg, om, cm = pseudo.split(weights)
    order = sorted(counts, key=lambda h: (-counts[h], int(np.array([h], np.uint64).astype(np.int64)[0])))
    own = {h: 1 + pseudo.SHARED + k for k, h in enumerate(order[: pseudo.CLASSES - 1 - pseudo.SHARED])}
    number = lambda h: own.get(h, 1 + h % pseudo.SHARED)
    total, kinds = defaultdict(int), defaultdict(int)
    for h, n in counts.items():
        total[number(h)] += n
        kinds[number(h)] += 1
    log_softmax = lambda z, k: float(z[k] - np.log(np.exp(z.astype(float)).sum()))
    out = []
    for t in docs:
        h = pseudo.words([t or ""])[0].tolist()
        c, s = [number(x) for x in h], 0.0
        for i, x in enumerate(h):
            z = b.copy()
            for n, k in enumerate([*range(-pseudo.WINDOW, 0), *range(1, pseudo.WINDOW + 1)]):
                z = z + e[n][c[i + k] if 0 <= i + k < len(c) else 0]
            z = np.tanh(z)
            g, m = divmod(c[i], pseudo.MEMBERS)
            s += log_softmax(z @ og + cg, g) + log_softmax(z @ om[g] + cm[g], m)
            if x not in own:
                s += np.log((counts[x] + 0.5) / (total[c[i]] + 0.5 * (kinds[c[i]] + 1)))
        out.append(s)
    return out


def test_pseudo_likelihood_equals_the_literal_sum(spark, documents, monkeypatch):
    monkeypatch.setattr(pseudo, "FREQUENT", 600)  # so that most words are joined, not sent
    docs = documents.where("length(text) < 4000").limit(40)
    counts = pseudo.counted(docs)
    vocab = pseudo.vocabulary(counts)
    rows = pseudo.classed(docs, vocab)
    weights = pseudo.fit(rows, vocab.prior)
    got = {r.doc_id: r for r in pseudo.scored(rows, weights, counts, vocab).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = defaultdict(int)
    for t in texts.values():
        for h in pseudo.words([t or ""])[0].tolist():
            held[h] += 1
    assert {r["hash"] & (2**64 - 1): r.n for r in counts.collect()} == dict(held)
    for (d, t), s in zip(texts.items(), literal_scores(texts.values(), weights, held), strict=True):
        assert got[d].n_words == len((t or "").split()) and abs(got[d].score - s) < 1e-3 * max(1, abs(s))


def test_pseudo_likelihood(spark, documents, odd):
    got = registry.queries()["op7_pseudo_likelihood"](spark, SF).toPandas()
    assert sorted(got.n_words) == sorted(len(t.split()) if (t := r.text or "") else 0 for r in documents.collect()) and (got.score <= 0).all()
    # training raises the whole score over the classes' shares, and words in a random order score lower
    counts = pseudo.counted(documents)
    vocab = pseudo.vocabulary(counts)
    rows = pseudo.classed(documents, vocab)
    weights = pseudo.fit(rows, vocab.prior)
    rng = np.random.default_rng(1)
    d = documents.toPandas()
    mixed = spark.createDataFrame(pd.DataFrame({"doc_id": d.doc_id, "text": [" ".join(rng.permutation((t or "").split())) for t in d.text]}))
    whole = lambda w, r: pseudo.scored(r, w, counts, vocab).agg(F.sum("score")).first()[0]
    assert whole(weights, rows) > max(whole(pseudo.fresh(vocab.prior), rows), whole(weights, pseudo.classed(mixed, vocab)))
    # a text of words that the corpus lacks scores lower than one of its words
    other = pseudo.classed(spark.createDataFrame([(1, "zzqx vvkw qqqj xxzy"), (2, d.text.dropna().iloc[0][:40])], "doc_id long, text string"), vocab)
    means = {r.doc_id: r.mean_score for r in pseudo.scored(other, weights, counts, vocab).collect()}
    assert means[1] < means[2]
    result = pseudo.pseudo_likelihood(odd).toPandas()
    assert len(result) == odd.count() and result[result.doc_id == 100].score.tolist() == [0.0] and np.ptp(result[result.doc_id == 2].score) < 1e-4
    assert pseudo.pseudo_likelihood(odd.limit(0)).count() == 0


def test_pieces(spark, documents, odd):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, texts = pieces.Pieces(path, 0.0, 1), [t or "" for t in documents.toPandas().text[:60]] + [t for t in ODD if "▁" not in t]
    assert [x.tolist() for x in plain.encode(texts, list(range(len(texts))))] == [sp.encode(t) for t in texts]
    rough = pieces.Pieces(path, 0.5, 9)
    ids = rough.encode(texts + ODD, [None] + list(range(len(texts) + len(ODD) - 1)))
    assert [rough.decode(x) for x in ids] == texts + ODD
    # many occurrences together give what the agenda gives for each, and they vary
    units = ["▁".replace("▁", " ") + w for w in ("hello", "worthless", "naïve日", "aaaaaaaaaaaa", "x" * 60, "internationalisation")] * 40
    keys = rough.keys(np.zeros(len(units), np.uint64), np.arange(len(units)))
    names = list(dict.fromkeys(units))
    flat, lengths = rough.merge(names, np.array([names.index(u) for u in units]), keys)
    single = [rough.agenda(u, k) for u, k in zip(units, keys, strict=True)]
    assert flat.tolist() == sum(single, []) and lengths.tolist() == list(map(len, single))
    assert len({tuple(x) for x, u in zip(single, units, strict=True) if u == " internationalisation"}) > 20
    again = pieces.Pieces(path, 0.5, 9)
    assert [x.tolist() for x in again.encode(texts[:9], list(range(9)))] == [x.tolist() for x in rough.encode(texts, list(range(len(texts))))[:9]]
    rows = pieces.encoded(odd, path)
    assert rows.where("not lossless").count() == 0 and rows.count() == odd.count() and pieces.encoded(odd.limit(0), path).count() == 0
    back = {r.doc_id: r.text for r in pieces.decoded(rows, path).collect()}
    assert back[100] == "" and back[4] == ODD[4]
    got = registry.queries()["op8_piece_dropout"](spark, SF).toPandas()
    assert len(got) == documents.count() and got.lossless.all()


def test_toxicity(spark, odd):
    rng = np.random.default_rng(12)
    plain, bad = [f"w{i}" for i in range(300)], ["scum", "vequa", "vequio", "vequel", "loser"]
    rows = []
    for i in range(900):
        s = [[str(w) for w in rng.choice(plain, 12)] for _ in range(int(rng.integers(1, 8)))]
        if i % 6 == 0:
            s[int(rng.integers(len(s)))][3] = str(rng.choice(bad))
        rows.append((i, ". ".join(" ".join(x) for x in s) + ".", int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.learned(docs.drop("label"), docs.where("doc_id < 700").select("doc_id", "label"))
    got = toxicity.scored(docs, model).where("doc_id >= 700").toPandas()
    assert (got.predicted == got.label).mean() > 0.98
    assert got[got.predicted == 1].offending.str.contains("scum|vequ|loser").all()
    none = toxicity.learned(odd, odd.limit(0).select("doc_id", "label"))
    rows = toxicity.scored(odd, none).toPandas()
    assert len(rows) == odd.count() and rows.score.between(0, 1).all() and rows[rows.doc_id == 100].score.tolist() == [0.0]
    assert toxicity.scored(odd.limit(0), none).count() == 0


def test_toxicity_held_out(spark):
    got = registry.queries()["op9_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.96


def test_toxicity_of_odd_labels(spark):
    rows = [(i, "you scum. fine day" if i % 4 == 0 else f"fine day w{i}", 1.5) for i in range(400)] + [(0, "you scum too", 2.5), (None, "you scum", 3.5), (None, None, None)] + [(1, "word. " * 40_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] * 2 + [(None, 1), (3, None)], "doc_id long, label int")
    model = toxicity.learned(docs, labels)
    got = toxicity.scored(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted", "offending", "offending_score"] and got.count() == len(rows)
    assert {bool(r.predicted) for r in got.collect() if r.text and "scum" in r.text} == {True} and not [r for r in got.where("length(text) < 1000").collect() if r.predicted and "scum" not in r.text]
    for few in (labels.where("label = 1"), labels.where("label = 0"), labels.limit(0)):
        assert toxicity.scored(docs, toxicity.learned(docs, few)).where("predicted = 1").count() == 0


def test_token_files(spark, documents, odd, tmp_path):
    path = P.path("word_bpe_49k.json")
    for n, df in enumerate((documents, odd)):
        out = f"file://{tmp_path}/{n}"
        tokenfile.write_token_files(df, out, path, "word", shard_chars=20_000)
        got = tokenfile.read_token_files(spark, out).toPandas().sort_values("start")
        d = df.toPandas()
        own = ids_of("word_bpe_49k.json", d.text)
        assert sorted(got.ids) == sorted(x.tobytes() for x in own)
        assert got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
        assert got.doc_id.dropna().is_monotonic_increasing
    hot = spark.createDataFrame([(7 if i % 3 else None, f"text number {i} of one id") for i in range(900)] + [(i, "x") for i in range(20)], "doc_id long, text string")
    manifest = tokenfile.write_token_files(hot, f"file://{tmp_path}/hot", path, "word", shard_chars=1000)
    assert manifest.count() > 15 and manifest.agg(F.max("n_docs")).first()[0] < 200  # rows of one id, and without one, are split
    got = tokenfile.read_token_files(spark, f"file://{tmp_path}/hot").toPandas().sort_values("start")
    assert got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]] and got.doc_id.isna().tolist() == sorted(got.doc_id.isna(), reverse=True) and got.doc_id.dropna().is_monotonic_increasing
    assert tokenfile.read_token_files(spark, f"file://{tmp_path}/hot", [7]).count() == 601
    some = tokenfile.read_token_files(spark, f"file://{tmp_path}/0", [3, 77]).toPandas().sort_values("doc_id")
    assert some.doc_id.tolist() == [3, 77]
    file = next((tmp_path / "0").glob("*.ztok"))
    raw = bytearray(file.read_bytes())
    raw[5] ^= 255
    file.write_bytes(bytes(raw))
    from pyarrow import fs

    with pytest.raises(Exception):  # noqa: B017  zstandard's own error or ours
        list(tokenfile.read_frames(fs.LocalFileSystem(), str(file)))
    tokenfile.write_token_files(documents.limit(0), f"file://{tmp_path}/none", path, "word")
    assert tokenfile.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline(spark, documents):
    import corpus_pipeline as cp

    docs, sf = documents, SF
    for name, stage in cp.STAGES[:-1]:
        new = common.saved(stage(spark, docs, sf), "test")
        assert new.columns == documents.columns, name
        if name == "toxicity":
            model = toxicity.learned(docs, toxicity.training_labels(spark, sf))
            assert {r.doc_id for r in new.collect()} == {r.doc_id for r in toxicity.scored(docs, model).where("predicted = 0").collect()}
        elif name == "near_copies":
            expected = brute_jaccard([tuple(r) for r in docs.select("doc_id", "text").collect()])
            assert {r.doc_id for r in new.collect()} == {d for d, (_, c) in expected.items() if d == c}
        else:
            assert new.where("n_chars <> length(text)").count() == 0 and new.count() == docs.count()
        docs = new
    pieces_ = cp.STAGES[-1][1](spark, docs, sf).toPandas()
    check_packing(pieces_, docs.toPandas())


def test_near_copies_by_row(spark):
    import corpus_pipeline as cp

    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, a, "x", 0.777, 3), (1, a, "x", 0.777, 3), (3, b, "y", 0.5, 4), (3, a + " more", "y", 0.5, 4), (None, a, "z", None, 5), (None, b.replace("v3 ", "u3 "), "z", None, 5), (9, "", "e", 1.0, 0), (9, None, "e", 1.0, 0), (5, "alone in the world with its own words", "f", 0.1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, component_id int")
    kept = cp.drop_near_copies(spark, docs, SF)
    key = lambda r: tuple(map(str, r))
    assert kept.columns == docs.columns and sorted(map(key, kept.collect())) == sorted(map(key, [rows[0], rows[2], *rows[6:]]))
    assert cp.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_stages_keep_columns_of_any_name(spark, documents):
    import corpus_pipeline as cp

    docs = documents.withColumn("score", F.lit(0.777)).withColumn("offending", F.lit("mine")).withColumn("spans", F.col("doc_id"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {tuple(r) for r in out.select("score", "offending").distinct().collect()} == {(0.777, "mine")}, name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_components_with_a_hub(spark):
    links = spark.range(5000).select(F.when(F.col("id") % 2 == 0, F.lit(10**6)).otherwise(F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    got = common.components(links)
    assert {r.component for r in got.select("component").distinct().collect()} == {0} and got.count() == 5001


def literal_base(text):
    """The base spans as the contract says, by the patterns as they stand."""
    import hashlib
    import re

    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            double = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])]
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), ("email", "ip", "card", "phone").index(kind), kind, m.end()))
    out.sort()
    return [sum(k == n for _, n, _, _ in out) for k in range(4)] + [hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, k, z in out).encode()).hexdigest()], {f"{k}:{a}:{z}" for a, _, k, z in out}


def test_pii_query_equals_the_patterns(spark, documents, odd):
    for rows, df in ((registry.queries()["op6_pii"](spark, SF), documents), (pii.found(odd), odd)):
        texts = sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
        got = sorted(((str(r[0]), *r[1:]) for r in rows.collect()), key=lambda r: (r[0], r[-2]))
        by = defaultdict(list)
        for d, t in texts:
            by[d].append(literal_base(t))
        assert len(got) == len(texts)
        for r in got:
            match = [x for x in by[r[0]] if x[0] == list(r[1:6])]
            assert match and match[0][1] <= set(r[6].split(","))


def test_field_on_lines_it_was_not_trained_on():
    weights = pii.field()
    rng = np.random.default_rng(99)
    wrong = total = found = spans = 0
    for toks, y in pii.labelled(rng, 600):
        got = pii.tagged(" ".join(toks).encode(), weights)[2]
        wrong, total = wrong + (got != np.array(y)).sum(), total + len(y)
        spans, found = spans + any(y), found + (any(y) and bool((got[np.array(y) > 0] > 0).all()))
    assert wrong <= 0.02 * total and found >= 0.95 * spans


def test_pii_of_long_lines():
    long = "word " * 30_000 + "password=b7db7aa4a5fcc78305 " + "word " * 30_000
    texts = [long, "a\nb\npassword=aaaabbbbccccdddd1234 end", "plain"]
    spans = [every for _, every in pii.spans_of(texts, pii.field())]
    assert [texts[0][a:b] for a, _, b in spans[0]] == ["b7db7aa4a5fcc78305"] and len(spans[1]) == 1 and not spans[2]
