"""Finite vectors of any size, against brute force over scaled ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import common, forest, hamming

VEC = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.prepared(spark)


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": np.arange(len(x)) % 2}), VEC)


@pytest.mark.parametrize("size", [1e20, 1e200, 1e-200, 1e-310, 1.0])
def test_nearest_of_any_size(spark, size):
    x = np.random.default_rng(1).standard_normal((200, 16)) * size
    x[7] *= 1e-20 if size < 1e-200 else 1e-100
    df = frame(spark, x)
    got = forest.nearest(df, df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), shard=80).toPandas()
    unit = x / np.abs(x).max()
    hit = 0
    for q in range(0, 200, 20):
        own = got[got.query_id == q].sort_values("rank")
        near = unit @ (unit[q] / np.abs(unit[q]).max())
        hit += len({v for v in np.lexsort((np.arange(200), -near)).tolist() if v != q} and set([v for v in np.lexsort((np.arange(200), -near)).tolist() if v != q][:20]) & set(own.vec_id))
        assert len(own) == 20 and own["rank"].tolist() == list(range(1, 21)) and not own.score.isna().any()
        assert (np.diff(near[own.vec_id]) <= 1e-12).all()
        if size in (1.0, 1e20):
            assert own.score.tolist() == [(x[q] * x[v]).sum() for v in own.vec_id]
    assert hit >= 0.9 * 200


@pytest.mark.parametrize("size", [1e20, 1e200, 1e-200, 1e-310, 1.0])
def test_near_duplicates_of_any_size(spark, size):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16))
    x[10:18] = x[10] * np.array([1, 2, 0.5, 3, 1, 1, 7, 1.5])[:, None]
    x *= size
    x[12] *= 1e-5
    got = hamming.linked_vectors(frame(spark, x)).toPandas().set_index("vec_id").sort_index()
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    label = np.arange(60) % 2
    expected = ((unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])).sum(1) - 1
    assert got.n_links.tolist() == expected.tolist() and expected.sum() == 24
