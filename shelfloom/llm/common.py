"""Helpers that the training-data operators share: session settings, shared folders, text bytes, links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, saved, shared_root, workers_find_library  # noqa: F401  for the operators

#: Rows in an Arrow batch that goes to Python: whole texts are long, so batches are short.
BATCH_ROWS = 512


def prepared(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, a shared folder for checkpoints, and this library's folder on the path of Python workers."""
    workers_find_library(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_root(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts with at most `most` characters together, or one text."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


# -- words of a text as 64-bit hashes, without a Python object for each word -------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII character but letters and digits.
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)]))
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def hashed_words(raw: bytes, spaces: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Words [^\\x20\\x09-\\x0D]+ (or between other `spaces`) of UTF-8 bytes, A-Z lower-cased: starts, ends, hashes, lower-cased bytes.

    For each of `prefixes`, the hashes of the words' first bytes follow.
    """
    b = np.frombuffer(raw, np.uint8)
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = spaces[b]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    low = _LOWER[b]
    p, inverse = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=total[1:])
        h = (total[end] - total[start]) * inverse[start]
        more = [mixed((total[np.minimum(start + k, end)] - total[start]) * inverse[start] + np.uint64(k)) for k in prefixes]
        return start, end, mixed(h + (end - start).astype(np.uint64) * np.uint64(_BASE)), low, *more


# -- components ----------------------------------------------------------------------------------------------------------


def attached(rows: DataFrame, own: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m of own (u, m, n), where n is u's number of rows and total that of all.

    A u with a 256th of all rows would land in one task of a join, so such ones (256 at most) are broadcast.
    """
    hot = own.where(F.col("n") >= max(1000, total // 256)).select("u", F.col("m").alias("__m"))
    marked = rows.join(F.broadcast(hot), "u", "left")
    rest = marked.where("__m is null").drop("__m").join(own.select("u", "m"), "u")
    return marked.where("__m is not null").select("u", "v", F.col("__m").alias("m")).union(rest.select("u", "v", "m"))


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), component the smallest node reachable.

    Large-star and small-star steps (Kiveris et al. 2014): each is one aggregation and one join on a node; every round's
    links are cut off by a checkpoint in the shared folder. Null ends and loops are ignored; without links: no rows.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = lambda: links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark()  # stars are settled from the start
    for _ in range(rounds):
        both = links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = attached(both.where("v > u"), least, 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = attached(large, low, 2 * seen[0])
        links = (
            small.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct().checkpoint()
        )
        if (now := mark()) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
