"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Both vocabularies first cut a text into words by a fixed pattern and then merge inside each word only, so the ids of a text
are those of its words in turn. Words are cut with numpy over characters whose classes every regex engine shares; a run with
any other character is one word, which the library cuts itself, and a text with unusual white space goes to the library
whole. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np

from .common import _powers, mixed, text_chunks

L, N, O, B, V, U, S = range(7)  # letter, digit, other, blank, other white space, unknown, end of a text
_CLASS = np.full(0x2200, U, np.uint8)
for _kind, _chars in ((L, "ªµºŒœ"), (N, "²³¹¼½¾"), (O, "×÷–—‘’“”…•€"), (B, " "), (V, "\t\n\x0b\x0c\r"), (S, "\x00")):
    _CLASS[[ord(c) for c in _chars]] = _kind
for _kind, _spans in ((L, "AZazÀÖØöøÿ"), (N, "09"), (O, "!/:@[`{~¡©«¬®±´´¶¸»»¿¿")):
    for _a, _b in zip(_spans[::2], _spans[1::2], strict=True):
        _CLASS[ord(_a) : ord(_b) + 1] = _kind
_ODD = re.compile("[\x00\x1c-\x1f\x85\xa0 ᠎ -‏    -⁤　﻿]")
_QUOTE = ord("'")


def _words(joined: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that each end with U+0000: starts, ends, hashes, and the numbers of words before each text's end."""
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    k = _CLASS[np.minimum(c, 0x21FF)]
    n = len(c)
    space = (k == B) | (k == V)
    run = np.where(space, B, k)
    start = np.ones(n, bool)
    np.not_equal(run[1:], run[:-1], out=start[1:])
    if kind == "word":
        start |= k == N
    solid = ~space & (k != S)
    # contractions: a quote where a word begins, then s, t, m, d, re, ve or ll
    q = np.flatnonzero(c[: n - 2] == _QUOTE) if n > 2 else np.zeros(0, np.int64)
    if len(q):
        before = np.where(q > 0, k[q - 1], S)
        q = q[(before != O) & (before != U) & ((before != B) | (kind == "word"))]
        lower = (lambda x: np.where((x >= 65) & (x <= 90), x + 32, x)) if kind == "word" else (lambda x: x)
        a, b = lower(c[q + 1]), lower(c[np.minimum(q + 2, n - 1)])
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ~one & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for hit, size in ((q[one], 2), (q[two], 3)):
            start[hit + 1] = False
            start[hit + size] = True
    odd = k == U
    if odd.any():  # a run of no white space with an unknown character is one word
        edge = np.ones(n, bool)
        np.not_equal(solid[1:], solid[:-1], out=edge[1:])
        piece = np.cumsum(edge) - 1
        bad = np.zeros(piece[-1] + 1, bool)
        bad[piece[odd]] = True
        inside = bad[piece]
        start[inside] = edge[inside]
    if kind == "word":
        first = np.flatnonzero(start & solid)
        last = start.copy()
        last[space | (k == S)] = True
    else:
        # white space before a word: its last character joins the word if it is a blank, else stands alone
        last_space = np.flatnonzero(space[:-1] & solid[1:])
        start[last_space] = True
        start[last_space[k[last_space] == B] + 1] = False
        first = np.flatnonzero(start & (k != S))
        last = start
    bounds = np.flatnonzero(last)
    end = np.append(bounds, n)[np.searchsorted(bounds, first, side="right")]
    p, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
        h = mixed((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return first, end, h, np.searchsorted(first, np.flatnonzero(k == S))


class WordEncoder:
    """ids(texts) equals the library's encode_batch(texts, add_special_tokens=False). kind: byte (byte-level BPE) or word."""

    def __init__(self, path: str, kind: str, most_words: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kind, self.most_words = kind, most_words
        size = self.library.get_vocab_size()
        if kind == "byte":  # ids after which a word of a list ends
            self.ends = np.arange(size) == self.library.encode("\n").ids[0]
        else:
            self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, flat: np.ndarray, lengths: np.ndarray, at: int) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while at + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.start[at : at + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + len(lengths)] = lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _encode(self, words: list[str], at: int) -> None:
        """The ids of words, which get the numbers from `at`; many words go to the library as one text."""
        for i in range(0, len(words), 2048):
            part = words[i : i + 2048]
            if all(_plain(w) for w in part):
                lines = [("\n" if self.kind == "byte" else " ").join(part[j : j + 64]) + "\n" * (self.kind == "byte") for j in range(0, len(part), 64)]
                flat = np.array([x for e in self.library.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], np.uint32)
                stop = np.flatnonzero(self.ends[flat])
                if len(stop) == len(part):
                    lengths = np.diff(stop, prepend=-1)
                    if self.kind == "byte":
                        flat, lengths = np.delete(flat, stop), lengths - 1
                    self._add(flat, lengths, at + i)
                    continue
            ids = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            self._add(np.array([x for e in ids for x in e], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)), at + i)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts) + "\0"
        first, end, h, upto = _words(joined, self.kind)
        if len(h):
            own, one, back = np.unique(h, return_index=True, return_inverse=True)
            known = self.known
            numbers = np.array([known.get(x, -1) for x in own.tolist()], np.int64)
            new = np.flatnonzero(numbers < 0)
            if len(new):
                at = len(known)
                words = [joined[a:b] for a, b in zip(first[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
                order = sorted(range(len(words)), key=lambda i: not _plain(words[i]))  # plain words in the same calls
                new = new[order]
                numbers[new] = np.arange(at, at + len(new))
                known.update(zip(own[new].tolist(), range(at, at + len(new)), strict=True))
                self._encode([words[i] for i in order], at)
            numbers = numbers[back]
        else:
            numbers = np.zeros(0, np.int64)
        lengths = self.length[numbers]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        flat = self.pool[np.repeat(self.start[numbers] - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([np.zeros(1, np.int64), upto])]
        if len(self.known) > self.most_words:
            self.clear()
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if _ODD.search(t)}
        out = [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if i in odd else None for i, t in enumerate(texts)]
        rest = [i for i in range(len(texts)) if i not in odd]
        for a, b in text_chunks([texts[i] for i in rest], 1 << 21):
            for i, ids in zip(rest[a:b], self._group([texts[i] for i in rest[a:b]]), strict=True):
                out[i] = ids
        return out


_SAFE = re.compile("^ ?[!-~ªµºÀ-ÖØ-öø-ÿŒœ]+$")


def _plain(word: str) -> bool:
    """Letters, digits or signs after one blank at most: alone on a line it stays one word."""
    return _SAFE.match(word) is not None and "\n" not in word


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, kind: str) -> WordEncoder:
    """One for each worker process; its words stay known from task to task."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = WordEncoder(path, kind)
    return _ENCODERS[path, kind]
