"""Centroid clustering by plain Lloyd rounds on whole numbers.

Vectors become integers, so sums are exact and a run gives the same clusters however its rows are split. Each round sends the
few centroids to every task; a task adds up its own vectors by centroid, and those sums (a row for each centroid and task)
merge through groupBy. The driver sees centroids alone: k rows a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, table

#: Largest integer component: squared distances of 64 such components fit a long.
MOST = 1 << 27


def finite(name: str, size: int | None, most: float) -> Column:
    """Is the vector there, of `size` components (any, if None), none null or non-finite, none beyond +-most?"""
    v = F.col(name)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > most))
    return F.coalesce(v.isNotNull() & (F.lit(True) if size is None else F.size(v) == size) & ~bad, F.lit(False))


def whole(cells: pd.Series, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of each vector, a row each."""
    return np.floor(np.stack(cells.to_numpy()) * float(scale)).astype(np.int64) if len(cells) else np.zeros((0, dims), np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance to it."""
    apart = np.stack([((vectors - c) ** 2).sum(1) for c in centroids])
    return apart.argmin(0), apart.min(0)


def sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, int, list[int]]]:
    """Per non-empty centroid: its vectors, the sum of their distances, and the sum of each component."""
    dims = centroids.shape[1]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, far, total = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            v = whole(batch.embedding, scale, dims)
            own, apart = nearest(v, centroids)
            count += np.bincount(own, minlength=len(centroids))
            np.add.at(total, own, v)
            np.add.at(far, own, apart)
        used = np.flatnonzero(count)
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], "far": far[used], "total": list(total[used])})

    parts = rows.select("embedding").mapInPandas(add, "cluster int, n long, far long, total array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("far").cast("decimal(38,0)")).alias("far"), *(F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(dims)))
    return {r.cluster: (r.n, int(r.far), [int(r[f"d{d}"]) for d in range(dims)]) for r in merged.collect()}


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector (vec_id, embedding) that takes part.

    A component x becomes floor(scale * x). Vectors that are null, have not exactly `dims` components, or hold null or
    non-finite ones take no part; nor do those with an integer beyond +-2^27, whose distances would not fit a long. Centroids
    start as the k vectors of smallest sha256 of `seed:vec_id` (ties: the smaller vector); after each assignment to the
    nearest (ties: the smaller number) non-empty ones become the componentwise floor of their vectors' mean, empty ones stay;
    `rounds` such rounds, then a last assignment. Fewer vectors than k give as many centroids. Repeated rows count each; a row
    without a vec_id takes part and never starts a centroid, unless no row has one. Other columns are ignored; no rows give no
    rows. Inertias beyond a long are an error.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(finite("embedding", dims, MOST / scale))
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "embedding").limit(k).toPandas()
    centroids = whole(first.embedding, scale, dims)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, _, total) in sums(rows, centroids, scale).items():
            centroids[c] = [t // n for t in total]
    last = sums(rows, centroids, scale)
    inertia = {c: far for c, (_, far, _) in last.items()}
    every = sum(inertia.values())
    if every >= 1 << 63:
        raise OverflowError("the inertia does not fit a long")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, apart = nearest(whole(batch.embedding, scale, dims), centroids)
            yield pd.DataFrame({"vec_id": batch.vec_id.astype("Int64"), "cluster": own.astype(np.int32), "distance": apart, "cluster_inertia": [inertia[c] for c in own.tolist()], "inertia": every, "centroid_sha256": [names[c] for c in own.tolist()]})

    return rows.mapInPandas(assign, schema)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the embeddings after three rounds."""
    prepared(spark)
    return clustered(table(spark, sf_dir, "embeddings"))


def op13_sql(k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> str:
    """The same clusters in SQL, a pair of steps for each round."""
    near = "select v.id, c.c, sum((v.x - c.x) * (v.x - c.x)) as far from cells v join {c} c on v.d = c.d group by all"
    steps = [
        f"kept as (select row_number() over () as id, vec_id, embedding from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"cells as (select id, vec_id, unnest(range({dims})) as d, unnest(list_transform(embedding, lambda x: floor({scale} * x::double)::hugeint)) as x from kept)",
        f"start as (select id, row_number() over (order by sha256('{seed}:' || vec_id::varchar), embedding) - 1 as c from kept qualify c < {k})",
        "c0 as (select s.c, v.d, v.x from start s join cells v using (id))",
    ]
    for r in range(rounds + 1):
        steps += [f"far{r} as ({near.format(c=f'c{r}')})", f"own{r} as (select id, min(far) as far, arg_min(c, (far, c)) as c from far{r} group by id)"]
        if r < rounds:
            mean = f"select o.c, v.d, (sum(v.x) - (((sum(v.x) % count(*)) + count(*)) % count(*))) // count(*) as x from own{r} o join cells v using (id) group by all"
            steps += [f"m{r} as ({mean})", f"c{r + 1} as (select p.c, p.d, coalesce(m.x, p.x) as x from c{r} p left join m{r} m using (c, d))"]
    return f"""with {", ".join(steps)}, sha as (select c, sha256(string_agg(x::varchar, ',' order by d)) as s from c{rounds} group by c)
select kept.vec_id, c::int as cluster, far::bigint as distance, (sum(far) over (partition by c))::bigint as cluster_inertia, (sum(far) over ())::bigint as inertia, s as centroid_sha256
from own{rounds} join kept using (id) join sha using (c)"""
