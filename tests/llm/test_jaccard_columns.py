"""The n-gram join where hashes share a column and where documents share passages in a chain."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import common, jaccard

from test_llm import brute_jaccard, near_copies

DOC = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.prepared(spark)


def colliding(bits):
    """Nine words whose first and last five-word shingles agree in so many low bits of their hashes."""
    rng = np.random.default_rng(1)
    sides = ["".join(f" {c}{x}" for c, x in zip("abcd", row, strict=True)) for row in rng.integers(0, 1 << 30, (400_000, 4)).tolist()]
    mask = np.uint64((1 << bits) - 1)
    first = np.concatenate(jaccard.shingle_sets([f"{s} mid" for s in sides])) & mask
    last = np.concatenate(jaccard.shingle_sets([f"mid{s}" for s in sides])) & mask
    common_, i, j = np.intersect1d(first, last, return_indices=True)
    assert len(common_)
    return f"{sides[i[0]]} mid{sides[j[0]]}".split()


def test_shingles_of_one_column_lose_no_link(spark):
    words = colliding(35)  # eight blocks of 32 bits
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "something else that stands alone here"), (4, " ".join(words[1:]))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOC)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(rows) == {1: (5, 1), 2: (4, 1), 3: (2, 3), 4: (4, 1)}


def test_chains_of_shared_passages_stay_linear(spark):
    rng = np.random.default_rng(2)
    passage = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 30)) for _ in range(301)]
    rows = [(i, passage[i] + " " + passage[i + 1]) for i in range(300)] + [(1000 + i, passage[i] + " " + passage[i + 1] + " end") for i in range(0, 300, 50)]
    docs = spark.createDataFrame(rows, DOC)
    own, several = jaccard.clusters(docs, 8, np.zeros(0, np.uint64), 5, 80, block_nodes=16)
    assert several
    groups = own.groupBy("cluster").count().agg(F.max("count"), F.sum("count")).first()
    assert groups[0] <= 16 and groups[1] < 300 * 30  # a block at the most
    got = jaccard.jaccard_components(docs, block_nodes=16).collect()
    expected = {i: i for i in range(300)} | {1000 + i: i for i in range(0, 300, 50)}
    assert {r.doc_id: r.component_id for r in got} == expected


def test_clusters_taken_apart_keep_all_links(spark):
    rows = near_copies(np.random.default_rng(3))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOC), block_entries=500, block_nodes=8)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_jaccard(rows)
