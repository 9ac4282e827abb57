"""Hard negatives by ball-tree branch and bound.

Rows are dealt to shards of bounded size by a hash of their id, so neither a frequent label nor equal vectors meet in one task;
each shard's task builds a ball tree over its rows: first split by label, then by distance. Anchors stream past the tree in
batches. A node's centre c and radius r bound the inner product of an anchor a with all its rows from both sides, by
a.c - r|a| and a.c + r|a|: nodes are passed over when they lie wholly above or below the score window, or strictly beneath the
anchor's current k-th score. What is left is scored exactly, in whole numbers, and the shards' best are merged by rank.

Two searches: each anchor's best rows of its own label (the positives), then for each positive the best rows of other labels in
its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepared, saved, table
from .lloyd import finite

#: Rows of a shard, on average, at the most; rows of a leaf.
SHARD, LEAF = 16_384, 64
#: Largest integer component: 256 products of two such add up within a long.
MOST = 1 << 27
NONE, ALL = 1 - (1 << 63), (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exactly: in floating point where no sum can pass 2^53."""
    if not (len(a) and len(b)):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class BallTree:
    """Nodes in preorder: a node's first child follows it, `second` is the other one (-1: a leaf)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.rows: list[tuple[int, int]] = []
        self.second: list[int] = []
        self.grow(0, len(ids), leaf)
        size = np.array([z - a for a, z in self.rows])[:, None]
        exact = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(self.vectors.astype(np.float64), 0)])
        first, last = np.array(self.rows).T
        self.centres = (exact[last] - exact[first]) / size
        # from the centre as it was rounded, so that bounds hold for it
        self.radii = np.array([np.sqrt(((self.vectors[a:z] - c) ** 2).sum(1)).max() for (a, z), c in zip(self.rows, self.centres, strict=True)])
        self.lows, self.highs = self.labels[first], self.labels[last - 1]

    def grow(self, a: int, z: int, leaf: int) -> None:
        todo: list[tuple[int, int, int]] = [(a, z, -1)]  # with the node whose second child this is
        while todo:
            a, z, parent = todo.pop()
            me = len(self.rows)
            if parent >= 0:
                self.second[parent] = me
            self.rows.append((a, z))
            self.second.append(-1)
            if z - a > leaf and (cut := self.cut(a, z)):
                todo += [(cut, z, me), (a, cut, -1)]

    def cut(self, a: int, z: int) -> int:
        """Reorders rows a to z and returns where the second half begins; 0 if they can't be told apart."""
        own = self.labels[a:z]
        if own[0] != own[-1]:  # between two labels, nearest to the middle
            edges = np.flatnonzero(own[1:] != own[:-1]) + 1
            return a + int(edges[np.abs(edges - (z - a) / 2).argmin()])
        v = self.vectors[a:z].astype(np.float64)
        one = v[((v - v[0]) ** 2).sum(1).argmax()]
        other = v[((v - one) ** 2).sum(1).argmax()]
        side = v @ (other - one)
        if (side == side[0]).all():
            return 0
        order = np.argsort(side, kind="stable")
        for x in (self.ids, self.labels, self.vectors):
            x[a:z] = x[a:z][order]
        return a + (z - a) // 2

    def best(self, anchors: np.ndarray, own_id: np.ndarray, own_label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores (anchors x k, -1 and NONE where fewer) of the best rows; and how many rows were scored.

        Only rows of the anchor's label (same) or of others count, never the anchor's own id, with low <= score <= high.
        """
        n = len(anchors)
        length = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
        ids, scores, read = np.full((n, k), -1, np.int64), np.full((n, k), NONE, np.int64), 0
        stack = [(0, np.arange(n))]
        while stack:
            node, active = stack.pop()
            label = own_label[active]
            if same:
                active = active[(self.lows[node] <= label) & (label <= self.highs[node])]
            elif self.lows[node] == self.highs[node]:
                active = active[label != self.lows[node]]
            if not len(active):
                continue
            middle, reach = anchors[active] @ self.centres[node], length[active] * self.radii[node]
            slack = 1e-9 * (length[active] * (self.radii[node] + float(np.sqrt((self.centres[node] ** 2).sum())))) + 1e-6  # covers rounding
            keep = (middle + reach + slack >= np.maximum(low[active], scores[active, -1])) & (middle - reach - slack <= high[active])
            active, middle = active[keep], middle[keep]
            if not len(active):
                continue
            if self.second[node] >= 0:
                first, second = node + 1, self.second[node]
                closer = (anchors[active] @ self.centres[first] >= anchors[active] @ self.centres[second]).mean() >= 0.5
                stack += [(second, active), (first, active)] if closer else [(first, active), (second, active)]
                continue
            a, z = self.rows[node]
            read += len(active) * (z - a)
            score = products(anchors[active], self.vectors[a:z])
            fits = ((self.labels[None, a:z] == own_label[active, None]) == same) & (self.ids[None, a:z] != own_id[active, None])
            fits &= (score >= low[active, None]) & (score <= high[active, None])
            score = np.where(fits, score, NONE)
            used = np.flatnonzero((score >= scores[active, -1:]).any(1) & fits.any(1))
            own = active[used]
            both, names = np.concatenate([scores[own], score[used]], 1), np.concatenate([ids[own], np.broadcast_to(self.ids[a:z], (len(own), z - a))], 1)
            order = np.lexsort((names, -both), axis=1)[:, :k]
            scores[own], ids[own] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        ids[scores == NONE] = -1
        return ids, scores, read


def vectors_of(cells: pa.Array, n: int) -> np.ndarray:
    return cells.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def searched(rows: DataFrame, asked: DataFrame, shards: int, same: bool, k: int) -> DataFrame:
    """query, vec_id, score: the k best rows (vec_id, label, embedding of integers) of each question.

    asked: query, vec_id, label, embedding, low, high.
    """
    kinds = [F.lit(0).alias("kind"), "vec_id", "label", "embedding", F.lit(None).cast("long").alias("query"), F.lit(NONE).alias("low"), F.lit(ALL).alias("high")]
    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), *kinds)
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "label", "embedding", "query", "low", "high")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            place = get("shard").to_numpy() * 2 + get("kind").to_numpy()
            edge = np.flatnonzero(place[1:] != place[:-1]) + 1
            for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(place)], strict=True):
                if z == a:
                    continue
                part = batch.slice(a, z - a)
                ids, labels, v = (part.column(part.schema.get_field_index(c)) for c in ("vec_id", "label", "embedding"))
                one = ids.to_numpy(), labels.to_numpy(), vectors_of(v, z - a)
                if place[a] >> 1 != shard:
                    shard, held, tree = place[a] >> 1, [], None
                if not place[a] & 1:
                    held.append(one)
                    continue
                if held:
                    tree, held = BallTree(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if tree is None:  # a shard without rows
                    continue
                query, low, high = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("query", "low", "high"))
                got, score, _ = tree.best(one[2], one[0], one[1], same, low, high, k)
                q, j = np.nonzero(score > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(query[q]), pa.array(got[q, j]), pa.array(score[q, j])], names=["query", "vec_id", "score"])

    both = own.unionByName(every).repartition("shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(search, "query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, scale: int = 256, percent: int = 80, shard: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label. anchors: vec_id of the rows that are anchors. A component x becomes floor(scale * x);
    a score is the integer inner product with the anchor; higher ones come first, ties by smaller vec_id. An anchor's positives
    are its first `positives` other rows of its label; for each, the first `negatives` rows of other labels with percent *
    positive_score <= 100 * negative_score <= 100 * positive_score (none where a positive score is below 0).

    Rows with a null id, label or vector, or with null or non-finite components take no part; nor do those with an integer
    beyond +-2^27 (less beyond 256 dimensions), whose scores would not fit a long. Zero vectors take part. Repeated rows count
    once; rows of one id are all scored, and never for an anchor of that id. An anchor without other rows of its label gives
    no rows. Other columns are ignored; no rows give no rows; vectors of several dimensions are an error.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = given.where(finite("embedding", None, float(MOST))).agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of several dimensions: {sizes[0]} to {sizes[1]}")
    most = 1 << ((62 - max(8, int(sizes[0] or 1).bit_length())) // 2)
    used = given.where(finite("embedding", None, most / scale) & (F.size("embedding") > 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = saved(used.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * scale))).distinct(), "rows")
    count = rows.count()
    shards = max(1, -(-count // shard), min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), count // 512))
    asked = rows.join(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").withColumn("query", F.monotonically_increasing_id())
    asked = saved(asked, "anchors")
    first = searched(rows, asked.select("*", F.lit(NONE + 1).alias("low"), F.lit(ALL).alias("high")), shards, True, positives)
    pairs = first.select(F.col("query").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
    pairs = saved(pairs.withColumn("query", F.monotonically_increasing_id()), "positives")
    floor = F.expr(f"(positive_score div 100) * {percent} + ((positive_score % 100) * {percent} + 99) div 100")  # the least whole score in the window
    windows = pairs.join(asked.withColumnRenamed("query", "anchor"), "anchor").select("query", "vec_id", "label", "embedding", floor.alias("low"), F.col("positive_score").alias("high"))
    found = searched(rows, windows, shards, False, negatives).select("query", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.join(asked.select(F.col("query").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(found, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose vec_id is divisible by 100, with the labels of every seventh moved on by one."""
    prepared(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0").select("vec_id"))


def op11_sql() -> str:
    return """with cells as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as a, a.label as al, b.vec_id as b, b.label as bl, list_inner_product(a.v, b.v)::bigint as s from cells a join cells b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
pos as (select a, b, s from scored where al = bl qualify row_number() over (partition by a order by s desc, b) <= 5)
select pos.a as anchor_id, pos.b as positive_id, (row_number() over (partition by pos.a, pos.b order by n.s desc, n.b))::int as rank, n.b as negative_id, pos.s as positive_score, n.s as negative_score
from pos join scored n on n.a = pos.a and n.al <> n.bl and 80 * pos.s <= 100 * n.s and 100 * n.s <= 100 * pos.s qualify rank <= 5"""
