"""Merge-type sentence pieces with seeded merge-dropout, and their lossless decoding.

A text, with a blank before it, is cut at the ends of runs of blanks and at line ends, which no merge crosses. In each unit
the agenda holds the adjacent pairs whose union is a piece, best score first and leftmost among equals; a pair whose keyed
hash falls below the dropout is passed over for good. The key is of the seed, the document and the occurrence's place in it, so
an encoding depends on nothing but these and the text, and a unit has as many segmentations as its occurrences draw.

Occurrences of a unit walk together as long as their draws agree: a state is a unit's symbols and its pairs passed over, each
step takes the best pair of every state, asks the hash of each of its occurrences, and parts those that merge from those
that pass. Nothing is kept from one block of texts to the next, so memory is bounded by the block. Characters without a piece,
and the mark that stands for a blank, become byte pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, mixed, prepared, table, text_chunks

MARK = "▁"
DROPOUT, SEED = 0.1, 2024
#: Characters of texts that are encoded together, at least, unless they end.
BLOCK = 1 << 22
#: Longer units go through the agenda one by one.
LONGEST = 48
_UNITS = re.compile(r" *[^ \n]+| +|\n")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _place(begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number of the pair of symbols [begin, middle) and [middle, end)."""
    with np.errstate(over="ignore"):
        return begin.astype(np.uint64) * _A + middle.astype(np.uint64) * _B + end.astype(np.uint64) * _C


class Pieces:
    def __init__(self, model: str, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float32)
        self.bytes = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        own: dict[str, int] = {}
        for i, t in enumerate(self.text):
            if sp.is_byte(i):
                self.byte_id[int(t[3:5], 16)] = i
                self.bytes[i] = bytes([int(t[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                own[t] = i
                self.bytes[i] = t.replace(MARK, " ").encode()
        self.own, self.size = own, n
        #: Ids of single characters, -1 - code point without one; the mark itself has none, a blank has the mark's.
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)
        for t, i in own.items():
            if len(t) == 1 and t != MARK:
                self.of_char[ord(t)] = i
        self.of_char[ord(" ")] = own.get(MARK, -1 - ord(" "))
        pairs = [(own[t[:k]] * n + own[t[k:]], i) for t, i in own.items() for k in range(1, len(t)) if t[:k] in own and t[k:] in own]
        pairs.sort()
        self.pair, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.least, self.seed = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1)), np.uint64(seed)

    # -- merging -------------------------------------------------------------------------------------------------------

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pieces of pairs, -1 where there is none."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], -1)

    def _passed(self, key: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Is the pair, given by `_place`, passed over by the occurrence of this key?"""
        with np.errstate(over="ignore"):
            return mixed(key + pair) < self.least

    def keys(self, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Keys of occurrences: of the seed, the document's number and the place in the document."""
        with np.errstate(over="ignore"):
            return mixed(mixed(docs + self.seed) + places.astype(np.uint64) * _A)

    def _symbols(self, units: list[str]) -> np.ndarray:
        """Ids of the single characters of units, which have one length."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.of_char[points].reshape(len(units), -1)

    def _spelled(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            out += [s] if s >= 0 else self.byte_id[list(chr(-1 - s).encode("utf-8", "surrogatepass"))].tolist()
        return out

    def agenda(self, unit: str, key: np.uint64) -> list[int]:
        """One unit through a heap of candidate merges."""
        s = self._symbols([unit])[0].tolist()
        n = len(s)
        begin, end, following, before = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i < 0 or j >= n:
                return
            new = int(self._joined(np.array([s[i]]), np.array([s[j]]))[0])
            if new >= 0 and not self._passed(np.array([key]), _place(*(np.array([x]) for x in (begin[i], begin[j], end[j]))))[0]:
                heapq.heappush(heap, (-float(self.score[new]), i, j, end[i], end[j], new))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, j, ei, ej, new = heapq.heappop(heap)
            if gone[i] or gone[j] or end[i] != ei or end[j] != ej or following[i] != j:
                continue
            s[i], end[i], gone[j] = new, ej, True
            following[i] = following[j]
            if following[i] < n:
                before[following[i]] = i
            offer(before[i], i)
            offer(i, following[i])
        return self._spelled([x for x, g in zip(s, gone, strict=True) if not g])

    def merge(self, units: list[str], unit: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of occurrences, one after the other, and how many each has. unit: the number of each occurrence's unit."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # occurrences, their rows, rows of symbols, how many of a row count
        own = sizes[unit]
        for k in np.flatnonzero(own > LONGEST):
            found = self.agenda(units[unit[k]], keys[k])
            done.append((np.array([k]), np.zeros(1, np.int64), np.array([found], np.int64), np.array([len(found)])))
        by = np.argsort(own, kind="stable")
        for size in np.unique(sizes[sizes <= LONGEST]).tolist():
            occ = by[np.searchsorted(own[by], size) : np.searchsorted(own[by], size, side="right")]
            names, row = np.unique(unit[occ], return_inverse=True)
            self._walk(self._symbols([units[k] for k in names.tolist()]), occ, row, keys[occ], done)
        pool, start, length, of, at, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(unit), np.int64), 0, 0
        for occ, row, symbols, count in done:
            mine = np.arange(symbols.shape[1]) < count[:, None]
            odd = np.flatnonzero((mine & (symbols < 0)).any(1)).tolist()
            spelled = [self._spelled(symbols[r, : count[r]].tolist()) for r in odd]
            mine[odd] = False
            size = mine.sum(1)
            first = at + np.cumsum(size) - size
            pool.append(symbols[mine])
            at += len(pool[-1])
            for r, x in zip(odd, spelled, strict=True):
                first[r], size[r] = at, len(x)
                pool.append(np.array(x, np.int64))
                at += len(x)
            start.append(first)
            length.append(size)
            of[occ] = n + row
            n += len(size)
        first, lengths = np.concatenate(start)[of], np.concatenate(length)[of]
        shift = first - (np.cumsum(lengths) - lengths)
        return np.concatenate(pool)[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].astype(np.int32), lengths

    def _walk(self, s: np.ndarray, occ: np.ndarray, row: np.ndarray, keys: np.ndarray, done: list) -> None:
        """Occurrences of units of one length to their ends. s: symbols of the units; row: the number of each occurrence's unit there."""
        begin = np.tile(np.arange(s.shape[1] + 1), (len(s), 1))  # of each symbol, and the end
        new = self._joined(s[:, :-1], s[:, 1:])
        score = np.where(new >= 0, self.score[new], -np.inf)
        count = np.full(len(s), s.shape[1])
        while len(s):
            at = np.arange(len(s))
            best = score.argmax(1) if score.shape[1] else np.zeros(len(s), np.int64)
            live = score[at, best] > -np.inf if score.shape[1] else np.zeros(len(s), bool)
            if not live.all():
                out, number = ~live[row], np.cumsum(~live) - 1
                done.append((occ[out], number[row[out]], s[~live], count[~live]))
                row = (np.cumsum(live) - 1)[row[~out]]
                occ, keys = occ[~out], keys[~out]
                s, begin, new, score, count, best = (x[live] for x in (s, begin, new, score, count, best))
                at = at[: len(s)]
                if not len(s):
                    return
            passed = self._passed(keys, _place(begin[at, best], begin[at, best + 1], begin[at, best + 2])[row])
            stay, go = (np.bincount(row[x], minlength=len(s)) > 0 for x in (passed, ~passed))
            row = np.where(passed, (np.cumsum(stay) - 1)[row], (stay.sum() + np.cumsum(go) - 1)[row])
            j, i = best[go], np.flatnonzero(stay)
            left = [x[i] for x in (s, begin, new, score, count)]
            left[2][np.arange(len(i)), best[i]] = -1
            left[3][np.arange(len(i)), best[i]] = -np.inf
            merged = self._merged(*(x[go] for x in (s, begin, new, score, count)), j)
            s, begin, new, score, count = (np.concatenate(x) for x in zip(left, merged, strict=True))
            wide = int(count.max())
            s, begin, new, score = s[:, :wide], begin[:, : wide + 1], new[:, : wide - 1], score[:, : wide - 1]

    def _merged(self, s: np.ndarray, begin: np.ndarray, new: np.ndarray, score: np.ndarray, count: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """States after the pair j of each has become one symbol."""
        at, width = np.arange(len(s)), s.shape[1]
        s[at, j] = new[at, j]
        place = np.arange(width + 1)
        after = place + (place > j[:, None])
        s = np.take_along_axis(s, np.minimum(after[:, :width], width - 1), 1)
        begin = np.take_along_axis(begin, np.minimum(after, width), 1)
        pairs = np.minimum(after[:, : width - 1], width - 2)
        new, score, count = np.take_along_axis(new, pairs, 1), np.take_along_axis(score, pairs, 1), count - 1
        score[at, np.minimum(count - 1, width - 2)] = -np.inf
        for i in (j - 1, j):  # the new symbol's pairs
            ok = np.flatnonzero((i >= 0) & (i < count - 1))
            k = i[ok]
            found = self._joined(s[ok, k], s[ok, k + 1])
            new[ok, k] = found
            score[ok, k] = np.where(found >= 0, self.score[found], -np.inf)
        return s, begin, new, score, count

    # -- texts ---------------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str], docs: list[int | None]) -> list[np.ndarray]:
        """Ids of each text. docs: numbers that go into the keys. An empty text has none."""
        out: list[np.ndarray] = []
        for i, j in text_chunks(texts, BLOCK):
            own = [_UNITS.findall(" " + t) if t else [] for t in texts[i:j]]
            counts = np.array([len(u) for u in own])
            flat_units = list(chain.from_iterable(own))
            number = {u: k for k, u in enumerate(dict.fromkeys(flat_units))}
            unit = np.fromiter(map(number.__getitem__, flat_units), np.int64, len(flat_units))
            doc = np.array([(d or 0) & 0xFFFFFFFFFFFFFFFF for d in docs[i:j]], np.uint64)
            place = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
            flat, lengths = self.merge(list(number), unit, self.keys(np.repeat(doc, counts), place))
            cut = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
            out += [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids encode."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")


_MODELS: dict[tuple, Pieces] = {}


def pieces(*args) -> Pieces:
    """One for each worker process."""
    if args not in _MODELS:
        _MODELS[args] = Pieces(*args)
    return _MODELS[args]


def encoded(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit), lossless (do they decode to the text), ids of every row.

    A null text is empty and has no pieces; a null doc_id counts as 0 in the keys; rows with one doc_id and text have the
    same ids; texts of any length are whole; other columns are ignored; no rows give none.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model, dropout, seed)
        ids_of, texts, size = [], [], 0

        def block() -> pa.RecordBatch:
            ids = own.encode(texts, ids_of)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                pa.array(ids_of, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([own.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            ], names=["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"])

        for batch in batches:
            ids_of += column(batch, "doc_id")
            new = [t or "" for t in column(batch, "text")]
            texts += new
            size += sum(map(len, new))
            if size >= BLOCK:
                yield block()
                ids_of, texts, size = [], [], 0
        if texts:
            yield block()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(encode, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(np.array(x or [], np.int64)) for x in column(batch, "ids")], pa.string())], names=["doc_id", "text"])

    return rows.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def op8_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with merge-dropout, and whether they decode to their texts."""
    import public_tokenizers

    prepared(spark)
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")
