"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long string of bits (signs of random projections) and keeps the strings in a sorted array. A
query descends in each tree to the range of its longest prefix match by binary search, then ascends in all trees at once, a
bit at a time, until the ranges together hold enough candidates (Bawa, Condie and Ganesan 2005); candidates are ranked by the
inner product of original vectors. Inner products become angles by one more coordinate that gives all vectors one length.

Rows are dealt to shards, each with a forest of its own, and blocks of queries meet all shards, so no shard or block grows with
the data. Equal vectors are one entry with the smallest ids that a result can need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepared, saved, table
from .hamming import scaled, usable

#: Trees of a forest, bits of a string, and the share of a shard that the ranges hold when the ascent ends.
TREES, BITS, SHARE = 16, 32, 1.1
SHARD, QUERIES = 8192, 4096


class Forest:
    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.vectors, self.trees, self.bits = vectors, trees, bits
        wide = vectors.shape[1] + 1
        planes = rng.standard_normal((trees, max(wide, bits), wide))
        # a tree's planes are orthogonal as far as the dimensions go: its bits then tell more
        self.planes = np.stack([np.concatenate([np.linalg.qr(p[i : i + wide].T)[0] for i in range(0, bits, wide)], 1)[:, :bits] for p in planes])
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        codes = self.codes(np.column_stack([vectors, rest]))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def codes(self, lifted: np.ndarray) -> np.ndarray:
        """trees x rows strings as integers, first bit highest."""
        weight = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return np.stack([(lifted @ p >= 0) @ weight for p in self.planes])

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the numbers of vectors in the ranges of the deepest common level that hold `enough` together (counted per tree)."""
        own = self.codes(np.column_stack([queries, np.zeros(len(queries))]))
        low = np.empty((self.bits + 1, self.trees, len(queries)), np.int64)
        high = np.empty_like(low)
        for t in range(self.trees):
            for level in range(self.bits + 1):
                free = self.bits - level
                base = own[t] >> free << free
                low[level, t] = np.searchsorted(self.sorted[t], base)
                high[level, t] = np.searchsorted(self.sorted[t], base + (1 << free))
        total = (high - low).sum(1)
        level = (total >= enough).sum(0) - 1  # totals fall from level to level
        for q in range(len(queries)):
            mask = np.zeros(len(self.vectors), bool)
            for t in range(self.trees):
                mask[self.order[t, low[level[q], t, q] : high[level[q], t, q]]] = True
            yield np.flatnonzero(mask)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors (vec_id, embedding) of largest inner product found for each query.

    Scores are inner products of original vectors in double precision; ties go to the smaller vec_id; a query (query_id,
    embedding) never finds the row of its own id. Unusable vectors (null, zero, or with null or non-finite components) and
    rows without an id take no part, as rows or as queries; repeated rows count once; other columns are ignored; no rows give
    none; vectors of several dimensions are an error. Finite vectors may have any size: products are of scaled ones, so a score
    beyond the range of double precision is infinite (or 0), and such scores stand in the order of the scaled products. Fewer candidates than k give fewer rows. `share`: of the sum
    over trees of their ranges, in units of the shard's rows; more gives more recall.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable("embedding") & F.col("vec_id").isNotNull()).distinct()
    by = Window.partitionBy("embedding").orderBy("vec_id")
    own = saved(rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable("embedding") & F.col("query_id").isNotNull()).distinct()
    count, largest, *wide = own.agg(F.count("*"), F.max(F.array_max(F.transform("embedding", F.abs))), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    wide += asked.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if len({n for n in wide if n}) > 1:
        raise ValueError(f"vectors of several dimensions: {sorted({n for n in wide if n})}")
    shards, blocks = max(1, -(-count // shard)), max(1, -(-asked.count() // block))
    # rows times one power of two, so that the largest component is near one and no product leaves the range of numbers
    power = int(np.frexp(largest or 1.0)[1])
    halves = [2.0 ** (-power // 2), 2.0 ** (-power - -power // 2)]
    longest = float(np.sqrt(own.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x * halves[0] * halves[1]) ** 2))).first()[0] or 0.0))
    a = own.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            given, asking = np.array(left.embedding.tolist()), np.array(right.embedding.tolist())
            exponent = np.frexp(np.abs(given).max(1))[1]
            x, rows, q = given * halves[0] * halves[1], scaled(given), scaled(asking)
            powers = np.frexp(np.abs(asking).max(1))[1]
            ids, short = left["ids"].tolist(), x.astype(np.float32)
            sizes = np.array([len(i) for i in ids])
            dims = x.shape[1]
            # enough: a share of the rows, but never fewer than could fill a result in every tree
            found = Forest(x, longest).candidates(q, max(int(share * len(x)), min(len(x), k + 1) * TREES))
            for query, vector, up, own in zip(right.query_id, q, powers.tolist(), found, strict=True):
                if len(own) > k + 1:  # rough products leave out what is clearly below the last that can count
                    rough = short[own] @ vector.astype(np.float32)
                    least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
                    own = own[rough >= least - (dims + 4) * 2.0**-22 * longest * float(np.sqrt((vector * vector).sum()))]
                with np.errstate(over="ignore", under="ignore"):
                    score = np.ldexp(np.ldexp((rows[own] * vector).sum(1), exponent[own]), up)
                near = (x[own] * vector).sum(1)
                vec = np.concatenate([ids[i] for i in own]).astype(np.int64)
                score, near = np.repeat(score, sizes[own]), np.repeat(near, sizes[own])
                other = vec != query
                vec, score, near = vec[other], score[other], near[other]
                best = np.lexsort((vec, -near, -score))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": vec[best], "score": score[best], "near": near[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "near": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "near": "float64"})

    found = a.groupBy("shard", "block").cogroup(b.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double, near double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("near"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose vec_id is divisible by 20."""
    prepared(spark)
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
