"""Masked pseudo-likelihood of documents by a bidirectional window network over the whole vocabulary.

A word's probability given the words on both sides is a product of three (a hierarchical softmax):
P(group | sides) * P(class | group, sides) * P(word | class). The most frequent words have a class each, the others share
classes by hash; a group holds classes of like frequency. The first two factors come from a network that sees the classes of
the words before and after: h = tanh(b + sum over offsets k of E_k[class at k]), log softmax(O h + c) over groups and over the
group's classes. The third is the word's share of its class by counts over all documents, so the table of words grows with the
corpus: the most frequent ones are sent to the tasks, all others are joined on Spark.

Texts are turned into classes once. The network is trained in numpy on every document and place, in rounds: each task takes
gradient steps over its own documents from the common weights, and the tasks' weights are averaged by their numbers of words
(so the weights depend on how the rows are split). A document's score is the sum of its words' log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, hashed_words, prepared, saved, table, text_chunks

#: Words before and after; units of the hidden layer; groups, and classes of a group; classes that rarer words share. No word stands at class 0.
WINDOW, HIDDEN, GROUPS, MEMBERS, SHARED = 2, 16, 16, 32, 64
CLASSES = GROUPS * MEMBERS
ROUNDS, BATCH, RATE = 2, 2048, 4.8
#: Words, at most, whose counts are sent to the tasks. Each of the others holds a small share of all words, so a join by word is even.
FREQUENT = 1 << 18
#: Added to the count of each word, and of one unseen word a class.
SMOOTH = 0.5
_PARTS = 8


def shapes() -> list[tuple[int, ...]]:
    """Of E, b, the groups' O and c, the classes' O and c."""
    return [(2 * WINDOW, CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, MEMBERS), (GROUPS, MEMBERS)]


def split(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes():
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s).astype(np.float32))
        at += n
    return out


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.reshape(-1) for p in parts]).astype(np.float64)


class Words(NamedTuple):
    """The most frequent words, by hash in ascending order: their classes and the logarithms of their shares of the class; and of each class the logarithm of its smoothed count and its share of all words."""

    known: np.ndarray
    number: np.ndarray
    share: np.ndarray
    size: np.ndarray
    prior: np.ndarray


def fresh(prior: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights to begin with: small embeddings, biases that give each class its share of all words."""
    rng = np.random.default_rng(seed)
    e, b, og, cg, om, cm = (rng.standard_normal(s) * (0.1 if n in (0, 2, 4) else 0) for n, s in enumerate(shapes()))
    by = prior.reshape(GROUPS, MEMBERS)
    return joined([e, b, og, np.log(by.sum(1)), om, np.log(by / by.sum(1, keepdims=True))])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, and where each text's begin (and the last end)."""
    raws = [t.encode() for t in texts]
    start, _, h, _ = hashed_words(b"\n".join(raws))
    return h, np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raws]))


def contexts(c: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Classes around each word, 0 beyond the text's ends: offsets x words."""
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    out = np.zeros((2 * WINDOW, len(c)), np.int64)
    for n, k in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        a, b = (slice(max(0, -k), len(c) - max(0, k)), slice(max(0, k), len(c) + min(0, k)))
        out[n, a] = np.where(text[a] == text[b], c[b], 0)
    return out


def hidden(x: np.ndarray, e: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = e[0].take(x[0], axis=0)
    for k in range(1, len(x)):
        h += e[k].take(x[k], axis=0)
    h += b
    return np.tanh(h, out=h)


_ONES = np.ones((max(GROUPS, MEMBERS), 1), np.float32)


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z), in place, and its sums by row."""
    np.exp(np.clip(z, -60, 60, out=z), out=z)
    return z, z @ _ONES[: z.shape[1]]


def by_group(h: np.ndarray, edge: list[int], om: np.ndarray, cm: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Logits of the classes of each row's own group; rows are sorted by group, edge: where each begins."""
    z = np.empty((len(h), MEMBERS), np.float32)
    for g in range(GROUPS):
        if edge[g] < edge[g + 1]:
            np.matmul(h[edge[g] : edge[g + 1]], om[g], out=z[edge[g] : edge[g + 1]])
    z += cm.take(group, axis=0)
    return z


def trained(weights: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    """Weights after one pass of gradient steps over examples (offsets x words, words)."""
    e, b, og, cg, om, cm = split(weights)
    unit, every = np.arange(HIDDEN), np.arange(BATCH)
    groups, members = np.divmod(y, MEMBERS)
    groups = groups.astype(np.uint8)
    for i in range(0, len(y), BATCH):
        order = i + np.argsort(groups[i : i + BATCH], kind="stable")  # a group's examples together
        xs, n, group, member = x.take(order, axis=1), len(order), groups[order], members[order]
        rows, step = every[:n], np.float32(rate / n)
        edge = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        h = hidden(xs, e, b)
        p, total = exponentials(h @ og + cg)
        p /= total
        p[rows, group] -= 1
        back = p @ og.T
        og -= step * (h.T @ p)
        cg -= step * p.sum(0)
        p, total = exponentials(by_group(h, edge, om, cm, group))
        p /= total
        p[rows, member] -= 1
        for g in range(GROUPS):
            a, z = edge[g], edge[g + 1]
            if a < z:
                back[a:z] += p[a:z] @ om[g].T
                om[g] -= step * (h[a:z].T @ p[a:z])
                cm[g] -= step * p[a:z].sum(0)
        back *= 1 - h * h
        b -= step / 16 * back.sum(0)
        back *= step
        flat = back.reshape(-1).astype(np.float64)
        for k in range(2 * WINDOW):
            e[k] -= np.bincount((xs[k, :, None] * HIDDEN + unit).reshape(-1), flat, CLASSES * HIDDEN).reshape(CLASSES, HIDDEN).astype(np.float32)
    np.clip(og, -6, 6, out=og)
    np.clip(om, -6, 6, out=om)
    return joined([e, b, og, cg, om, cm])


def log_probabilities(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each word's class, given the classes around it."""
    e, b, og, cg, om, cm = weights
    out = np.empty(len(y), np.float32)
    groups, members = np.divmod(y, MEMBERS)
    groups = groups.astype(np.uint8)
    for i in range(0, len(y), 4096):
        order = i + np.argsort(groups[i : i + 4096], kind="stable")
        group, rows = groups[order], np.arange(len(order))
        edge = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        h = hidden(x.take(order, axis=1), e, b)
        p, total = exponentials(h @ og + cg)
        q, rest = exponentials(by_group(h, edge, om, cm, group))
        out[order] = np.log(p[rows, group] / total[:, 0]) + np.log(q[rows, members[order]] / rest[:, 0])
    return out


def counted(docs: DataFrame) -> DataFrame:
    """hash, n of every word of all documents, saved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            texts = [t or "" for t in column(batch, "text")]
            for i, j in text_chunks(texts):
                held.append(words(texts[i:j])[0])
                if sum(map(len, held)) > 2_000_000:
                    yield flush()
        yield flush()

    return saved(docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "counts")


def vocabulary(counts: DataFrame) -> Words:
    """Classes and shares from the counts of all words."""
    # a histogram of some hundred steps finds the least count of a frequent word, so no task sorts or sends more than those
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).toPandas()
    steps = steps[steps["words"].cumsum() <= FREQUENT]
    top = counts.where(step >= int(steps["step"].min())).toPandas() if len(steps) else counts.limit(0).toPandas()
    top = top.sort_values(["n", "hash"], ascending=[False, True])
    by = counts.groupBy(F.pmod("hash", F.lit(SHARED)).cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    h, n = top["hash"].to_numpy(np.int64).astype(np.uint64), top["n"].to_numpy(np.int64)
    number = 1 + (h % np.uint64(SHARED)).astype(np.int64)
    total, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    total[1 + by["c"].to_numpy(int)], kinds[1 + by["c"].to_numpy(int)] = by["n"], by["words"]
    own = CLASSES - 1 - SHARED  # words with a class of their own
    np.subtract.at(total, number[:own], n[:own])
    np.subtract.at(kinds, number[:own], 1)
    number[:own] = 1 + SHARED + np.arange(len(h[:own]))
    total[number[:own]] = n[:own]
    size = np.log(total + SMOOTH * (kinds + 1))
    share = np.where(number > SHARED, 0.0, np.log(n + SMOOTH) - size[number])
    order = np.argsort(h)
    return Words(h[order], number[order], share[order], size, (total + 0.5) / (total + 0.5).sum())


def classed(docs: DataFrame, vocab: Words) -> DataFrame:
    """Every row's row number, doc_id, n_words, the classes of its words (unsigned 16-bit), the sum of frequent words' log shares, and the hashes of the others; saved."""
    names = ["row", "doc_id", "n_words", "classes", "share", "rare"]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = column(batch, "doc_id"), [t or "" for t in column(batch, "text")]
            for i, j in text_chunks(texts):
                h, cut = words(texts[i:j])
                number, share, rare = 1 + (h % np.uint64(SHARED)).astype(np.int64), np.zeros(len(h)), np.ones(len(h), bool)
                if len(vocab.known):
                    at = np.minimum(np.searchsorted(vocab.known, h), len(vocab.known) - 1)
                    rare = vocab.known[at] != h
                    number = np.where(rare, number, vocab.number[at])
                    share = np.where(rare, 0.0, vocab.share[at])
                raw, edge = memoryview(number.astype("<u2").tobytes()), cut.tolist()
                total = np.concatenate([[0.0], np.cumsum(share)])
                left = np.concatenate([[0], np.cumsum(rare)])[cut]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(j - i)), pa.array(ids[i:j], pa.int64()), pa.array(np.diff(cut)), pa.array([bytes(raw[2 * a : 2 * b]) for a, b in zip(edge, edge[1:], strict=False)], pa.binary()),
                    pa.array(np.diff(total[cut])), pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(h[rare].astype(np.int64))),
                ], names=names)
                row += j - i

    return saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(turn, "row long, doc_id long, n_words long, classes binary, share double, rare array<long>"), "classes")


def examples(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows [i, j), their words' classes and where each row's begin, some hundred thousand words at a time."""
    raws = column(batch, "classes")
    i = size = 0
    for j in range(len(raws) + 1):
        if j == len(raws) or (j > i and size + len(raws[j]) > 1 << 19):
            if j > i:
                yield i, j, np.frombuffer(b"".join(raws[i:j]), "<u2").astype(np.int64), np.cumsum([0] + [len(r) // 2 for r in raws[i:j]])
            i, size = j, 0
        if j < len(raws):
            size += len(raws[j])


def fit(rows: DataFrame, prior: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Weights trained on every place of every row of `classed`, once a round."""
    weights = fresh(prior)
    for r in range(rounds):

        def learn(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights, r: int = r) -> Iterator[pa.RecordBatch]:
            own, seen = weights, 0
            for batch in batches:
                for _, _, c, cut in examples(batch):
                    if len(c):
                        own = trained(own, contexts(c, cut), c, rate / (1 + r))
                        seen += len(c)
            if seen:
                lane = TaskContext.get().partitionId() % 64
                part = np.array_split((own * seen), _PARTS)
                yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([lane] * _PARTS, pa.int32()), pa.array([seen] * _PARTS, pa.int64()), pa.array([p.tolist() for p in part], pa.list_(pa.float64()))], names=["part", "lane", "seen", "w"])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": rows.part.iloc[:1], "lane": [0], "seen": [rows.seen.sum()], "w": [np.sum(np.stack(rows.w.to_numpy()), 0)]})

        kind = "part int, lane int, seen long, w array<double>"
        total = rows.select("classes").mapInArrow(learn, kind).groupBy("part", "lane").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind).toPandas().sort_values("part")
        if len(total):
            weights = np.concatenate(total.w.to_list()) / total.seen.iloc[0]
    return weights


def scored(rows: DataFrame, weights: np.ndarray, counts: DataFrame, vocab: Words) -> DataFrame:
    """doc_id, n_words, score (sum of conditional log-probabilities), mean_score of every row of `classed`; without words 0, 0 and null. A rare word that counts lacks is unseen."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = split(weights)
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for i, j, c, cut in examples(batch):
                p = np.concatenate([[0.0], np.cumsum(log_probabilities(own, contexts(c, cut), c), dtype=np.float64)])
                total[i:j] = np.diff(p[cut])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in ("row", "doc_id", "n_words", "share")), pa.array(total)], names=["row", "doc_id", "n_words", "share", "network"])

    found = rows.select("row", "doc_id", "n_words", "share", "classes").mapInArrow(score, "row long, doc_id long, n_words long, share double, network double")
    size = F.element_at(F.array(*(F.lit(float(x)) for x in vocab.size[1 : 1 + SHARED])), (F.pmod("hash", F.lit(SHARED)) + 1).cast("int"))
    rest = rows.select("row", F.explode("rare").alias("hash")).join(counts, "hash", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(0)) + SMOOTH) - size).alias("rest"))
    both = found.join(rest, "row", "left").withColumn("score", F.col("network") + F.col("share") + F.coalesce("rest", F.lit(0.0)))
    return both.select("doc_id", "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_score"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on all rows of docs (doc_id, text), then score them all.

    doc_id, n_words, score, mean_score. Null texts are empty and score 0 with a null mean; rows with equal or null doc_ids
    are scored each; texts of any length are whole; other columns are ignored; an empty table gives none.
    """
    counts = counted(docs)
    vocab = vocabulary(counts)
    rows = classed(docs, vocab)
    return scored(rows, fit(rows, vocab.prior), counts, vocab)


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pseudo-likelihood under a network trained on all documents."""
    prepared(spark)
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
