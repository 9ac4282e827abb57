"""Packing by order-preserving dynamic programming.

Documents follow each other as one stream of tokens. Windows of at most `size` tokens are cut from it at ends of documents
or sentences (or, in a sentence longer than `stride`, every `stride` tokens) so that padding plus penalties for cut
documents is least. A window of w tokens is padded to `size`, except at a power of two. With f(j) the least cost up to cut
j at token c(j), a full-size window gives f(j) = penalty(j) + size - c(j) + min of f(i) + c(i) over c(j) - c(i) <= size, so a
monotone queue over f(i) + c(i) finds each minimum in constant time; windows of an exact power of two are tried beside it.
Each task packs the documents it reads, in their order, `block` tokens at a time: no shuffle, and memory is bounded by a
block and one text.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, prepared
from .tokens import encoder

SIZE, END = 2048, 1
#: Cost in tokens of cutting a document after a sentence, and inside one.
SENTENCE, INSIDE = 4, 48
#: Shortest window that goes without padding as a power of two.
LEAST = 128


def sentence_ends(tokenizer) -> np.ndarray:
    """By id: does a sentence or line end after this token?"""
    end = re.compile(r"(?:[.!?…][\"')\]]*|Ċ)$")
    return np.array([bool(end.search(tokenizer.id_to_token(i) or "")) for i in range(tokenizer.get_vocab_size())])


def cuts(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may be cut, from 0 to len(ids), and their penalties. ends: by id; stops: ends of documents."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    soft = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    penalty[soft] = SENTENCE
    penalty[0] = 0
    penalty[stops] = 0
    at = np.flatnonzero(penalty >= 0)
    gap = np.diff(at)
    for k in np.flatnonzero(gap > stride):
        penalty[at[k] + stride : at[k + 1] : stride] = INSIDE
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def windows(at: np.ndarray, penalty: np.ndarray, size: int = SIZE, least: int = LEAST) -> list[int]:
    """Indices of the cuts of a cheapest packing, the first and the last included."""
    exact: list[list[int]] = [[] for _ in at]
    power = least
    while power < size:
        i = np.searchsorted(at, at - power)
        for j in np.flatnonzero(at[np.minimum(i, len(at) - 1)] == at - power):
            exact[j].append(int(i[j]))
        power *= 2
    c, pen = at.tolist(), penalty.tolist()
    f, back = [0] * len(c), [0] * len(c)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(c)):
        cj = c[j]
        while c[queue[0][1]] < cj - size:
            queue.popleft()
        key, i = queue[0]
        best = key + size - cj
        if best and exact[j]:
            for x in exact[j]:
                if f[x] < best:
                    best, i = f[x], x
        f[j] = best = best + pen[j]
        back[j] = i
        key = best + cj
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    path = [len(c) - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def packed(docs: DataFrame, tokenizer: str, kind: str = "byte", size: int = SIZE, end_id: int = END, block: int = 1 << 20, stride: int = 256) -> DataFrame:
    """Pieces of the documents' ids (the library's, then end_id) in sequences of at most size tokens.

    Rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit integers). Null texts are empty and
    give one piece with the end id; equal and null doc_ids are packed like others; long texts are cut into pieces; other
    columns are ignored, whatever their names; no documents give no rows.
    sequence_id: the task's number times 2^40, plus the sequence's number in the task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        ends = sentence_ends(enc.library)
        names, parts, held = [], [], 0
        sequence = TaskContext.get().partitionId() << 40

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            flat = np.concatenate(parts)
            stops = np.cumsum([len(p) for p in parts])
            at, penalty = cuts(flat, ends, stops, min(stride, size))
            edge = at[windows(at, penalty, size)]
            left = np.union1d(edge[:-1], np.concatenate([[0], stops[:-1]]))
            right = np.append(left[1:], len(flat))
            doc = np.searchsorted(stops, left, side="right")
            window = np.searchsorted(edge, left, side="right") - 1
            begin = stops - np.diff(stops, prepend=0)
            raw = memoryview(flat.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
            columns = [
                pa.array([names[d] for d in doc], pa.int64()), pa.array(left - begin[doc]), pa.array(right - left), pa.array(crc, pa.int64()),
                pa.array(np.diff(stops, prepend=0)[doc]), pa.array(window + sequence), pa.array(left - edge[window]),
                pa.ListArray.from_arrays(pa.array(np.append(left, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))),
            ]
            sequence += len(edge) - 1
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for d, ids in zip(column(batch, "doc_id"), enc.ids([t or "" for t in column(batch, "text")]), strict=True):
                names.append(d)
                parts.append(np.append(ids, np.uint32(end_id)))
                held += len(parts[-1])
                if held >= block:
                    yield from flush()
                    names, parts, held = [], [], 0
        if parts:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048; a row for each piece."""
    import public_tokenizers

    from .common import table

    prepared(spark)
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
