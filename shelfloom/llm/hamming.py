"""Near-duplicate embeddings: binary codes by iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation is learnt on a bounded sample so that the signs of the rotated principal components lose little (Gong and
Lazebnik 2011): balanced bits of which near vectors share most. Each vector gets its code once; the tables hold codes and
numbers, never vectors.

1. Tables: each of m tables keys every code by w chosen bits. Longer keys for more rows keep blocks small, and m grows with w so
   that a pair at the threshold meets in some table with a chance of 0.9995 or more.
2. Hamming filter: codes that meet are compared in blocks; vectors with no code within the radius go. The radius is the number
   of differing bits that a pair at the threshold exceeds with a chance of a millionth.
3. Rerank: the vectors of those left are fetched and compared by cosine, block by block. A pair counts in the first table in
   which it meets; a block returns each vector's count and the least vector it reaches, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, prepared, saved, table

COSINE = 0.98
#: Bound of the vectors that the rotation is learnt on, in the order of a hash of vec_id.
SAMPLE = 8000
#: Bits of a code.
BITS = 128
#: Vectors of a key at the most, on average; vectors of a block at the most.
PER_KEY, BLOCK = 32, 1024


def usable(name: str):
    """Is the vector there, without null or non-finite components, and not zero?"""
    v = F.col(name)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 5) -> np.ndarray:
    """dimensions x bits: projections whose signs are the code. Dimensions beyond bits are dropped by variance; missing ones padded by further rotations."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    values, vectors = np.linalg.eigh(sample.T @ sample / len(sample))
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        k = min(d, bits - sum(p.shape[1] for p in parts))
        main = vectors[:, np.argsort(-values)[:k]]
        v = sample @ main
        r = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(main @ r)
    return np.concatenate(parts, 1)


def key_bits(rows: int, per_key: int = PER_KEY) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, rows / per_key))), 6, 24))


def pick(bits: int, width: int, angle: float, seed: int = 9) -> np.ndarray:
    """tables x width bit numbers. Enough tables that vectors at the angle meet with a chance of 0.9995, bits differing independently."""
    meet = (1 - angle / np.pi) ** width
    tables = int(np.ceil(np.log(0.0005) / np.log(1 - meet)))
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(bits) for _ in range(-(-tables * width // bits) + 1)])
    out = []
    while len(out) < tables:  # bits in turn, so that tables differ as much as they can
        own, order = order[:width], order[width:]
        if len(set(own.tolist())) < width:
            own = rng.permutation(bits)[:width]
        out.append(np.sort(own))
    return np.stack(out)


def radius(bits: int, angle: float, miss: float = 1e-6) -> int:
    """Differing bits that vectors at the angle exceed with at most this chance, bits differing independently."""
    p, k, rest = angle / np.pi, 0, 1.0
    while k < bits and (rest := rest - comb(bits, k) * p**k * (1 - p) ** (bits - k)) > miss:
        k += 1
    return k


def keys(codes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """rows x tables keys of packed codes (rows x bytes)."""
    bits = np.unpackbits(codes, axis=1)
    return np.stack([bits[:, own] @ (1 << np.arange(len(own), dtype=np.int64)) for own in chosen], 1)


def codes_of(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(rows.schema.get_field_index("code")).to_pylist()), np.uint8).reshape(rows.num_rows, -1)


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, which lie together, of sorted batches."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        key = np.stack([rows.column(c).to_numpy() for c in by])
        edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for a, z in zip(np.append(0, edge)[:-1].tolist(), edge.tolist(), strict=True):
            if z > a + 1:
                yield rows.slice(a, z - a)
        held = rows.slice(int(edge[-1]) if len(edge) else 0)
    if held is not None and held.num_rows > 1:
        yield held


def across(side: np.ndarray) -> np.ndarray:
    """Which pairs a block compares: all of a part with itself (side 0), else those of its two parts; never a vector with itself."""
    pair = side[:, None] != side[None, :] if side.any() else np.ones((len(side),) * 2, bool)
    np.fill_diagonal(pair, False)
    return pair


SLOT = ["slot", "i", "j"]


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, per_key: int = PER_KEY, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine in double precision is at least `cosine`. Unusable
    vectors (null, zero, or with null or non-finite components) and rows without a vec_id link with nothing. Equal vectors of
    one label are one vector to the tables and count as links of each other; so do rows of one vec_id, which keep a result
    each. Other columns are ignored; no rows give no rows; vectors of several dimensions are an error. Finite
    vectors may have any size, as each is scaled by a power of two before norms and codes.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    good = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    name = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "label", "embedding").alias("h2")]  # 128 bits stand for label and vector
    own = rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    own = saved(own.select("*", *name, F.monotonically_increasing_id().alias("node")), "vectors")
    per_label = own.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    sample = own.orderBy("h1", "h2").limit(SAMPLE).select("embedding").toPandas()
    sizes = own.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of several dimensions: {sizes[0]} to {sizes[1]}")
    if not len(sample):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    x = scaled(np.array(sample.embedding.tolist()))
    turn, angle = rotation(x / np.linalg.norm(x, axis=1, keepdims=True)), float(np.arccos(cosine))
    chosen, near = pick(BITS, key_bits(per_label, per_key), angle), radius(BITS, angle)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = scaled(vectors_of(batch))
            code = np.packbits(v @ turn >= 0, axis=1) if len(v) else np.zeros((0, BITS // 8), np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("label", "node")), pa.array([r.tobytes() for r in code], pa.binary())], names=["label", "node", "code"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tables = batch.num_rows, len(chosen)
            k = keys(codes_of(batch), chosen) if n else np.zeros((0, tables), np.int64)
            out = batch.take(pa.array(np.repeat(np.arange(n), tables)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(k.reshape(-1))], names=["label", "node", "code", "t", "key"])

    codes = saved(own.select("label", "node", "embedding").mapInArrow(encode, "label string, node long, code binary"), "codes")
    tables = codes.mapInArrow(spread, "label string, node long, code binary, t int, key long").select(F.xxhash64("label", "t", "key").alias("slot"), "t", "node", "code")
    # slots with more vectors than a block are split into parts that meet in pairs
    large = tables.groupBy("slot").count().where(F.col("count") > block).select("slot", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    dealt = tables.join(large, "slot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("slot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "t", "node", "code")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, SLOT):
            c = codes_of(rows)
            words = c.view(np.uint64)
            far = np.zeros((len(c),) * 2, np.uint16)
            for w in words.T:
                far += np.bitwise_count(w[:, None] ^ w[None, :])
            held = np.flatnonzero(((far <= near) & across(rows.column("side").to_numpy())).any(1))
            if len(held):
                yield from rows.take(held).select([*SLOT, "side", "t", "node"]).combine_chunks().to_batches()

    left = dealt.repartition(*SLOT).sortWithinPartitions(*SLOT).mapInArrow(sift, "slot long, i int, j int, side int, t int, node long")
    close = left.join(own.select("node", "label", "embedding", "copies").join(codes.select("node", "code"), "node"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, SLOT):
            rows = rows.sort_by("node")
            node, copies, t, label = rows.column("node").to_numpy(), rows.column("copies").to_numpy(), int(rows.column("t")[0].as_py()), np.array(rows.column("label").to_pylist())
            hit = (cosines(vectors_of(rows)) >= cosine) & across(rows.column("side").to_numpy()) & (label[:, None] == label[None, :])
            a, b = np.nonzero(hit)
            if not len(a):
                continue
            k = keys(codes_of(rows), chosen[: t + 1])
            first = ~(k[a, :t] == k[b, :t]).any(1)
            count = np.bincount(a[first], copies[b[first]], minlength=len(node)).astype(np.int64)
            least = np.arange(len(node))
            while True:  # least vector within reach
                low = least.copy()
                np.minimum.at(low, a, least[b])
                low = low[low]
                if (low == least).all():
                    break
                least = low
            used = np.flatnonzero((count > 0) | (least != np.arange(len(node))))
            yield pa.RecordBatch.from_arrays([pa.array(node[used]), pa.array(count[used]), pa.array(node[least[used]])], names=["node", "links", "least"])

    found = saved(close.repartition(*SLOT).sortWithinPartitions(*SLOT).select(*SLOT, "side", "t", "node", "label", "embedding", "copies", "code").mapInArrow(compare, "node long, links long, least long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    names = own.select("node", "h1", "h2", "first", "copies")
    group = names.join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = group.groupBy("component").agg(F.min("first").alias("component_id"))
    about = group.join(least, "component").join(links, "node", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    keyed = rows.select("vec_id", *(F.when(good, h).alias(n) for h, n in zip(name, ("h1", "h2"), strict=True)))
    out = keyed.join(saved(about, "about"), ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def vectors_of(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The vectors of rows, of one dimension and without nulls, as a matrix."""
    cells = rows.column(rows.schema.get_field_index("embedding"))
    flat = (cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, their largest component between a half and one: cosines stay, and no norm leaves the range of numbers."""
    if not v.size:
        return v
    # in two steps, as the least numbers are further from one than a power of two can go
    down = -np.frexp(np.abs(v).max(1, keepdims=True))[1]
    return np.ldexp(np.ldexp(v, down // 2), down - down // 2)


def cosines(v: np.ndarray) -> np.ndarray:
    """All cosines of rows in double precision."""
    v = scaled(v)
    norm = np.sqrt((v * v).sum(1))
    return (v @ v.T) / (norm[:, None] * norm[None, :])


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings within each label."""
    prepared(spark)
    return linked_vectors(table(spark, sf_dir, "embeddings"))
