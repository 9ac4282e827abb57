"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from labels of documents.

A sentence s of words with features w (the word, its beginnings) has the score p(s) = sigmoid(bias + sum of weight(w)); a document is toxic with probability
1 - product of (1 - p(s)). The weights are fitted by gradient steps on the documents' likelihood; the sentences are never
labelled, and the fitted scores then point at the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SIGNS, column, hashed_words, prepared, saved, table, text_chunks

#: A word's features are itself and its first bytes, numbered by so many bits of their hashes.
PREFIXES, BITS = (4, 6), 20
PER_WORD = 1 + len(PREFIXES)
#: Bound of the labelled rows that the weights are fitted on, taken in the order of a hash of doc_id.
MOST_ROWS = 8000
#: Columns that scoring adds.
ADDED = ("score", "predicted", "offending", "offending_score")
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Features (PER_WORD rows, a column for each word), the words' sentence numbers (from 0, without gaps), and of each sentence its text's number and its first and last byte in the joined bytes, which come last."""
    raws = [t.encode() for t in texts]
    joined = b"\n".join(raws)
    start, end, h, low, *more = hashed_words(joined, SIGNS, PREFIXES)
    stops = np.concatenate([np.zeros(1, np.int64), np.cumsum(_STOP[low])])
    own = stops[start]
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    first = np.flatnonzero(fresh)
    begin = np.cumsum([0] + [len(r) + 1 for r in raws])
    span = np.stack([start[first], end[np.append(first[1:], len(own)) - 1] if len(first) else start[first]], 1)
    features = np.stack([x >> np.uint64(64 - BITS) for x in (h, *more)]).astype(np.int32)
    return features, np.cumsum(fresh) - 1, np.searchsorted(begin, span[:, 0], side="right") - 1, span, joined


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def telling(counts: pd.DataFrame, pos: int, neg: int) -> np.ndarray:
    """Features that toxic documents hold clearly more often. counts: feature, a (toxic documents that hold it), b (others)."""
    a, b = counts["a"].to_numpy(), counts["b"].to_numpy()
    share = (a + b) / (pos + neg)
    z = (a / pos - b / neg) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / pos + 1 / neg))
    return np.sort(counts["feature"].to_numpy()[(a >= max(3, 0.01 * pos)) & (z > 4.5) & (a / pos > 3 * b / neg)])


def fitted(short: list[tuple[int, np.ndarray, np.ndarray]], labels: np.ndarray, used: np.ndarray, steps: int = 1200, batch: int = 128, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> Model:
    """short: of each document the number of its sentences, and of its words' features in `used` their places there and their sentences."""
    weights = np.zeros(1 << BITS, np.float32)
    bias = -5.0
    toxic = labels == 1
    w, m, v = (np.zeros(len(used) + 1) for _ in range(3))  # the last is the bias
    w[-1] = bias
    rng, order = np.random.default_rng(seed), np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(short))])
        own, order = order[:batch], order[batch:]
        sizes = np.array([short[k][0] for k in own])
        shift = np.cumsum(sizes) - sizes
        words = np.concatenate([short[k][1] for k in own])
        sent = np.concatenate([short[k][2] + d for k, d in zip(own, shift, strict=True)]).astype(np.int64)
        of = np.repeat(np.arange(len(own)), sizes)
        score = w[-1] + np.bincount(sent, w[words], minlength=len(of))
        total = np.maximum(np.bincount(of, softplus(score), minlength=len(own)), 1e-9)
        pull = np.where(toxic[own], -1 / np.expm1(np.minimum(total, 50)), 1.0)
        g = pull[of] / (1 + np.exp(-np.clip(score, -50, 50)))
        grad = np.append(np.bincount(words, g[sent], minlength=len(used)), g.sum()) / len(own) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * min(1, 2 - 2 * step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def learned(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """The model of at most most_rows labelled documents. labels: doc_id, label.

    Features are counted and chosen on Spark; the driver gets the chosen ones' places in the documents, and no text. Rows
    without a doc_id or a label are left out; of several texts of one doc_id the least counts; without toxic or without
    other documents no text is toxic.
    """
    rows = labels.where("doc_id is not null and label is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # broadcast: most_rows short rows
    found = saved(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")
    sizes = found.agg(F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") != 1, 1))).first()
    if not min(sizes):
        return Model(np.zeros(1 << BITS, np.float32), -np.inf)  # every score is 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[list[np.ndarray], ...] = ([], [])
            for t, y in zip(column(batch, "text"), column(batch, "label"), strict=True):
                held[int(y == 1)].append(np.unique(sentences([t or ""])[0]))
            both = [np.unique(np.concatenate([*h, np.zeros(0, np.int32)]), return_counts=True) for h in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([both[1][0], both[0][0]]).astype(np.int32)), *(pa.array(np.concatenate([both[1][1] * (k == 1), both[0][1] * (k == 0)]).astype(np.int64)) for k in (1, 0))], names=["feature", "a", "b"])

    counts = found.select("label", "text").mapInArrow(count, "feature int, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3")
    used = telling(counts.where(F.col("a") >= 0.01 * sizes[0]).where(F.col("a") * sizes[1] > 3 * F.col("b") * sizes[0]).toPandas(), *sizes)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, np.int32)
        number[used] = np.arange(len(used))
        for batch in batches:
            out = []
            for t in column(batch, "text"):
                f, s, *_ = sentences([t or ""])
                n = number[f]
                hit = n >= 0
                out.append((int(s[-1]) + 1 if len(s) else 0, n[hit].astype("<i4").tobytes(), np.broadcast_to(s, n.shape)[hit].astype("<i4").tobytes()))
            size, w, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "label")] + [pa.array(size, pa.int32()), pa.array(w, pa.binary()), pa.array(s, pa.binary())], names=["doc_id", "label", "size", "w", "s"])

    got = found.mapInArrow(shorten, "doc_id long, label int, size int, w binary, s binary").toPandas().sort_values(["doc_id", "label", "size", "w", "s"])
    short = [(n, np.frombuffer(w, "<i4").astype(np.int64), np.frombuffer(s, "<i4")) for n, w, s in zip(got["size"], got.w, got.s, strict=True)]
    return fitted(short, got.label.to_numpy(), used)


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with score, predicted, offending (the worst sentence of a predicted document) and offending_score; columns of docs with these names go. Null and empty texts score 0."""
    weights, bias = model
    docs = docs.drop(*ADDED)
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in column(batch, "text")]
            scores, worst, worst_score = np.zeros(len(texts)), [None] * len(texts), [None] * len(texts)
            for i, j in text_chunks(texts):
                words, sent, of, span, joined = sentences(texts[i:j])
                if not len(of):
                    continue
                z = bias + np.bincount(sent, weights[words].sum(0), minlength=len(of))
                scores[i:j] = -np.expm1(-np.bincount(of, softplus(z), minlength=j - i))
                for d in np.flatnonzero(scores[i:j] >= threshold):
                    a, b = np.searchsorted(of, [d, d + 1])
                    k = a + int(np.argmax(z[a:b]))
                    worst[i + d] = joined[span[k][0] : span[k][1]].decode(errors="replace")
                    worst_score[i + d] = float(1 / (1 + np.exp(-z[k])))
            more = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(worst, pa.string()), pa.array(worst_score, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names))] + more, names=[f.name for f in out])

    out = T.StructType(list(docs.schema))
    for name, kind in zip(ADDED, (T.DoubleType(), T.IntegerType(), T.StringType(), T.DoubleType()), strict=True):
        out = out.add(name, kind)
    return docs.mapInArrow(score, out)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.toxic of the rows that are not held out."""
    rows = table(spark, sf_dir, "labels")
    return rows.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("toxic").alias("label"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted, offending, offending_score."""
    prepared(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, training_labels(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending", "offending_score")
