"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Two sets link when 100 * |A & B| >= percent * |A | B|. Then A lacks at most (100 - percent) % of its own elements in B, so
of A's elements in any common order the first floor(n * (100 - percent) / 100) + 1 hold one of B's first ones. The order here
is by the number of sets that hold an element, rarest first, so most sets' first elements are theirs alone.

1. Sets: each text's distinct shingles as 64-bit hashes; equal sets become one node, named by a digest of the set.
2. Columns: the incidence of all elements, dealt by blocks of n-grams in packed arrays; each block counts its columns and
   returns entries of columns with two sets or more. The bound needs one order of all elements for both sets of a pair.
3. First elements: per node, the rarest of the returned entries, as far as the bound goes beyond the elements of its own.
   Nodes sharing one fall in a cluster, by links to the least node of each column. No linked pair is outside a cluster.
   A large cluster that is rather a chain of small columns than a group of copies is taken apart again: its columns become
   clusters of their own, so that documents that share passages without being near copies cost no product of all with all.
4. Product: each cluster's nodes meet with their whole sets, in blocks of nodes (clusters over a block in pairs of blocks);
   overlap counts accumulate row by row, pairs below the size-derived bound are dropped, and each block returns links to the
   least node that it can reach, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attached, column, components, hashed_words, mixed, prepared, saved, table, text_chunks

WORDS, PERCENT = 5, 80
#: Nodes, and elements, of a block of the product.
BLOCK_NODES, BLOCK_ELEMENTS = 1024, 2_000_000
_FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct word shingles as hashes; a text with fewer words has one, of all its words; without words, none."""
    out: list[np.ndarray] = []
    for i, j in text_chunks(texts):
        raws = [t.encode() for t in texts[i:j]]
        start, _, h, _ = hashed_words(b"\n".join(raws))
        begin = np.cumsum([0] + [len(r) + 1 for r in raws])
        cut = np.searchsorted(start, begin)
        with np.errstate(over="ignore"):
            g = np.zeros(max(len(h) - words + 1, 0), np.uint64)
            for k in range(words):
                g += (h[k : len(h) - words + 1 + k] ^ _FOLD[k % len(_FOLD)]) * _FOLD[(k + 3) % len(_FOLD)]
            g = mixed(g)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a >= words:
                    out.append(np.unique(g[a : b - words + 1]))
                elif b > a:
                    out.append(mixed((h[a:b] * _FOLD[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
                else:
                    out.append(h[:0])
    return out


def digest(own: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        x = mixed(own + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) * _FOLD[1] + np.bitwise_xor.reduce(mixed(own ^ _FOLD[2])) + np.uint64(len(own))
    return int(mixed(np.array([x], np.uint64)).astype(np.int64)[0])


def slack(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements of a set of n that a linked set may lack."""
    return n * (100 - percent) // 100


def with_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node (null for an empty set or a null doc_id), n_shingles, of each document; and, in rows of column and held, the n-grams that at least 1 % of the sets near them hold."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}

        def frequent() -> tuple[np.ndarray, np.ndarray]:
            value, held = np.unique(np.concatenate([*near.values(), np.zeros(0, np.uint64)]), return_counts=True)
            hot = held >= max(32, 0.01 * len(near))
            near.clear()
            return value[hot].astype(np.int64), held[hot]

        def rows(doc: list, node: list, n: list, value: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
            none = [None] * len(value)
            return pa.RecordBatch.from_arrays([pa.array([*a, *b], pa.int64()) for a, b in ((doc, none), (node, none), (n, none), ([None] * len(doc), value.tolist()), ([None] * len(doc), held.tolist()))], names=["doc_id", "node", "n_shingles", "column", "held"])

        for batch in batches:
            ids = column(batch, "doc_id")
            own = shingle_sets([t or "" for t in column(batch, "text")], words)
            nodes = [digest(s) if len(s) else None for s in own]
            near |= {k: s for k, s in zip(nodes, own, strict=True) if k is not None}
            yield rows(ids, [None if d is None else k for d, k in zip(ids, nodes, strict=True)], [len(s) for s in own], *(frequent() if sum(map(len, near.values())) > 1_500_000 else (np.zeros(0, np.int64),) * 2))
        if near:
            yield rows([], [], [], *frequent())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, "doc_id long, node long, n_shingles long, column long, held long")


#: Most frequent n-grams, at most, that stand last in the order; a bounded list that every task knows.
MOST_HOT = 1 << 16


def packed(*arrays: np.ndarray) -> bytes:
    return np.stack(arrays, 1).astype("<i8").tobytes() if len(arrays[0]) else b""


def unpacked(cells: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<i8").reshape(-1, width)


def dealt(docs: DataFrame, blocks: int, hot: np.ndarray, words: int, percent: int) -> DataFrame:
    """The incidence by blocks of n-grams: packed residues of hashes, and their rows in `nodes`.

    meta: (node, size, entries sent) of nodes that this block keeps account of; direct: (node, n-gram) of hot n-grams among
    a node's first elements.
    """
    bits = int(blocks).bit_length() - 1
    mask = np.uint64((1 << (32 + bits)) - 1)  # what of a hash names a column

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        meta: list[tuple[int, int, int]] = []
        direct: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            node = np.fromiter(held, np.int64, len(held))
            h = np.concatenate([*held.values(), np.zeros(0, np.uint64)])
            row = np.repeat(np.arange(len(held)), [len(x) for x in held.values()])
            block = (h & np.uint64(blocks - 1)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cut = np.searchsorted(block[order], np.arange(blocks + 1))  # one number a block
            about = np.array(meta, np.int64).reshape(-1, 3)
            place = about[:, 0] & (blocks - 1)
            straight = np.array([(k, x) for k, own in direct for x in own.astype(np.int64).tolist()], np.int64).reshape(-1, 2)
            where = straight[:, 0] & (blocks - 1)
            out = []
            for b in np.unique(np.concatenate([block, place, where])).tolist():
                own = order[cut[b] : cut[b + 1]]
                used, local = np.unique(row[own], return_inverse=True)
                out.append((b, (h[own] >> np.uint64(bits)).astype("<u4").tobytes(), local.astype("<u2").tobytes(), node[used].astype("<i8").tobytes(), about[place == b].astype("<i8").tobytes(), straight[where == b].astype("<i8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["block", "h", "row", "nodes", "meta", "direct"])

        for batch in batches:
            for own in shingle_sets([t or "" for t in column(batch, "text")], words):
                node = digest(own) if len(own) else None
                if node is None or node in held:
                    continue
                need = int(slack(np.int64(len(own)), percent)) + 1
                common = np.isin(own, hot, assume_unique=True)
                rare = own[~common]
                # n-grams of one set on one column count once, here as in the blocks: a linked set then lacks as few columns as elements
                rare = rare[np.unique(rare & mask, return_index=True)[1]]
                if len(rare) < need:
                    direct.append((node, own[common][: need - len(rare)]))
                held[node] = rare
                meta.append((node, len(own), len(rare)))
                size += len(rare)
                if size > 2_000_000 or len(held) > 60_000:
                    yield flush()
                    held, meta, direct, size = {}, [], [], 0
        if held:
            yield flush()

    return docs.where("doc_id is not null").select("text").mapInArrow(deal, "block int, h binary, row binary, nodes binary, meta binary, direct binary")


def shared_entries(rows: pd.DataFrame, blocks: int) -> pd.DataFrame:
    """One block: entries of columns with two nodes or more, by the block that keeps account of the node."""
    h, node = [], []
    for a, b, c in zip(rows.h, rows.row, rows.nodes, strict=True):
        h.append(np.frombuffer(a, "<u4"))
        node.append(np.frombuffer(c, "<i8")[np.frombuffer(b, "<u2")])
    h, node = np.concatenate(h).astype(np.int64), np.concatenate(node)
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])  # equal sets of several tasks
    h, node = h[once], node[once]
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(first, len(h)))
        sets = np.repeat(count, count)
        keep = sets > 1
        h, node, sets = h[keep] * blocks + int(rows.block.iloc[0]), node[keep], sets[keep]
    else:
        sets = h
    part = node & (blocks - 1)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(blocks + 1))
    out = [(b, packed(node[own], h[own], sets[own]), b"", b"") for b in np.flatnonzero(np.diff(cut)).tolist() if len(own := order[cut[b] : cut[b + 1]])]
    out.append((int(rows.block.iloc[0]), b"", b"".join(rows.meta), b"".join(rows.direct)))
    return pd.DataFrame(out, columns=["part", "entries", "meta", "direct"])


def first_elements(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Nodes of one part and their first elements that other nodes hold too."""
    meta = np.unique(unpacked(rows.meta, 3), axis=0)
    direct = np.unique(unpacked(rows.direct, 2), axis=0)
    e = unpacked(rows.entries, 3)
    e = e[np.lexsort((e[:, 1], e[:, 2], e[:, 0]))]
    node, first, back, count = np.unique(e[:, 0], return_index=True, return_inverse=True, return_counts=True)
    of = np.searchsorted(meta[:, 0], node)
    need = slack(meta[of, 1], percent) + 1 - (meta[of, 2] - count)
    keep = np.arange(len(e)) - first[back] < need[back]
    out = np.concatenate([e[keep, :2], np.stack([direct[:, 0], -1 - (direct[:, 1] & 0x7FFFFFFFFFFFFFFF)], 1)])
    return pd.DataFrame(out, columns=["node", "col"])


def clusters(docs: DataFrame, blocks: int, hot: np.ndarray, words: int, percent: int, block_nodes: int = BLOCK_NODES) -> tuple[DataFrame, bool]:
    """(node, cluster): nodes that share a first element, directly or through others; nodes without company are left out.

    In a cluster of more nodes than a block, whose columns together have fewer pairs than it has, each column is a cluster:
    then, and only then, a node can be in several, and the second result is true.
    """
    entries = dealt(docs, blocks, hot, words, percent).groupBy("block").applyInPandas(lambda rows: shared_entries(rows, blocks), "part int, entries binary, meta binary, direct binary")
    first = saved(entries.groupBy("part").applyInPandas(lambda rows: first_elements(rows, percent), "node long, col long"), "first")
    entries = first.select(F.col("col").alias("u"), F.col("node").alias("v"))
    total = entries.count()
    least = saved(entries.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("n > 1"), "columns")
    links = attached(entries, least, total).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    found = saved(components(links).withColumnRenamed("component", "cluster"), "clusters")
    large = saved(found.groupBy("cluster").agg(F.count("*").alias("k")).where(F.col("k") > block_nodes), "large")
    if large.isEmpty():
        return found.select("node", "cluster"), False
    columns = least.join(found.withColumnRenamed("node", "m"), "m").join(large, "cluster")
    chains = columns.groupBy("cluster").agg((F.sum(F.col("n").cast("double") * F.col("n")) < F.max("k").cast("double") * F.max("k")).alias("chain")).where("chain").select("cluster")
    apart = saved(columns.join(chains, "cluster").select("u", F.col("m"), "n", "cluster"), "apart")
    if apart.isEmpty():
        return found.select("node", "cluster"), False
    whole = found.join(apart.select("cluster").distinct(), "cluster", "left_anti").select("node", "cluster")
    return whole.union(attached(entries, apart.select("u", F.xxhash64(F.lit("column"), "u").alias("m"), "n"), total).select(F.col("v").alias("node"), F.col("m").alias("cluster"))), True


def linked(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, cells: int = 4_000_000) -> list[tuple[int, int]]:
    """Links (node, least node reached) of one block of the product. side: 0 all pairs; 1 and 2: pairs across only."""
    order = np.argsort(nodes)
    nodes, side, sets = nodes[order], side[order], [sets[k] for k in order]
    k, n = len(nodes), np.array([len(s) for s in sets])
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(k), n)
    by = np.argsort(value, kind="stable")
    col_owner = owner[by]
    fresh = np.concatenate([[True], value[by][1:] != value[by][:-1]])
    start = np.flatnonzero(fresh)
    width = np.diff(np.append(start, len(by)))
    col = np.empty(len(by), np.int64)
    col[by] = np.cumsum(fresh) - 1
    work = np.concatenate([[0], np.cumsum(width[col])])[np.concatenate([[0], np.cumsum(n)])]  # entries to add up, before each row
    edge = np.concatenate([[0], np.cumsum(n)])
    label = np.arange(k)
    r = 0
    while r < k:
        stop = max(r + 1, min(r + max(1, cells // k), int(np.searchsorted(work, work[r] + cells, side="right")) - 1))
        own = col[edge[r] : edge[stop]]
        w = width[own]
        at = np.repeat(start[own] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        overlap = np.bincount(np.repeat(owner[edge[r] : edge[stop]] - r, w) * k + col_owner[at], minlength=(stop - r) * k).reshape(stop - r, k)
        hit = (100 + percent) * overlap >= percent * (n[r:stop, None] + n[None, :])
        if side.any():
            hit &= side[r:stop, None] != side[None, :]
        hit[np.arange(stop - r), np.arange(r, stop)] = False
        for i in np.flatnonzero(hit.any(1)):
            found = np.unique(label[np.append(np.flatnonzero(hit[i]), r + i)])
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
        r = stop
    moved = np.flatnonzero(label != np.arange(k))
    return list(zip(nodes[moved].tolist(), nodes[label[moved]].tolist(), strict=True))


def product(docs: DataFrame, members: DataFrame, words: int, percent: int, block_nodes: int = BLOCK_NODES, block_elements: int = BLOCK_ELEMENTS, several: bool = True) -> DataFrame:
    """Links (a, b) of the blocked product. members: doc_id (of a node's first document), node, n_shingles, cluster; several: can a node be in several clusters?"""
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n_shingles") / block_elements)).cast("int").alias("blocks"))
    places = F.struct("cluster", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"))
    # a text is read and cut once for all its clusters, of which it has no more than first elements
    wanted = members.join(sizes, "cluster")
    wanted = wanted.groupBy("doc_id", "node").agg(F.collect_list(places).alias("places")) if several else wanted.select("doc_id", "node", F.array(places).alias("places"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for s, node, places in zip(shingle_sets([t or "" for t in column(batch, "text")], words), *(column(batch, c) for c in ("node", "places")), strict=True):
                if not len(s) or digest(s) != node:  # another row may have the same doc_id
                    continue
                raw = s.astype("<u8").tobytes()
                for place in places:
                    cluster, blocks, own = place["cluster"], place["blocks"], place["own"]
                    for j in range(blocks):
                        rows.append((cluster, min(own, j), max(own, j), 0 if own == j else 1 + (own > j), node, raw))
                        size += len(raw)
                        if size > 1 << 24 or len(rows) > 4096:
                            yield batch_of(rows)
                            rows, size = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["cluster", "i", "j", "side", "node", "elements"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, {}, []

        def done() -> list[tuple[int, int]]:
            # a pair of blocks compares across; a block with itself, all
            return linked(np.fromiter(held, np.int64, len(held)), [s for s, _ in held.values()], np.array([x for _, x in held.values()]), percent) if len(held) > 1 else []

        for batch in batches:
            for cluster, i, j, side, node, raw in zip(*(column(batch, c) for c in ("cluster", "i", "j", "side", "node", "elements")), strict=True):
                if (cluster, i, j) != key:
                    out += done()
                    key, held = (cluster, i, j), {}
                held[node] = (np.frombuffer(raw, "<u8"), side)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out = []
        out = done()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = texts.select("text", "node", "places").mapInArrow(sets, "cluster long, i int, j int, side int, node long, elements binary")
    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(multiply, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_entries: int = 1_500_000, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row of docs (doc_id, text).

    Null and empty texts have no shingles and link with nothing. Rows are judged each by its own text: rows of one doc_id with
    different texts can lie in different components. A row without a doc_id keeps its count and has no component. Texts of
    any length are whole; other columns are ignored; no rows give no rows.
    """
    rows = saved(with_sets(docs, words), "sets")
    docs_sets = rows.where("column is null").select("doc_id", "node", "n_shingles")
    hot = rows.where("column is not null").groupBy("column").agg(F.sum("held").alias("held")).orderBy(F.desc("held"), "column").limit(MOST_HOT).toPandas()["column"].to_numpy(np.int64).astype(np.uint64)
    total = docs_sets.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = 1 << max(3, int(np.ceil(np.log2(max(1, total / block_entries)))))
    nodes = docs_sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.max("n_shingles").alias("n_shingles"))
    cluster, several = clusters(docs, blocks, np.sort(hot), words, percent, block_nodes)
    members = nodes.join(cluster, "node").select(F.col("first_doc").alias("doc_id"), "node", "n_shingles", "cluster")
    found = components(product(docs, members, words, percent, block_nodes, several=several))
    least = found.join(nodes, "node").groupBy("component").agg(F.min("first_doc").alias("least"))
    named = nodes.join(found.join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "first_doc").alias("component_id"))
    named = saved(named, "named")  # a plain side, so that a node with very many documents can be split
    return docs_sets.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by five-word shingles at a similarity of 0.8."""
    prepared(spark)
    return jaccard_components(table(spark, sf_dir, "documents"))
