"""Personal data: fixed patterns, and spans found by a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table of token lines by the gradient of its log-likelihood (forward-backward) and
decoded by Viterbi, many lines at a time. A line on which no token's best label can beat "outside", even with the best
transitions, has the all-outside path as its optimum, so only other lines are decoded; that changes no result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, hashed_words, prepared, table, text_chunks

#: Kinds in the order in which spans of one start are listed: the patterns', then the field's.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "identity")
#: Fixed patterns. The lookbehind changes no match: a number's later digits fail where its first did.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the patterns' matches, leftmost and not overlapping in each kind."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:  # the local part is the run of its characters before the sign
        a = at
        while a > last and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((a, 0, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- the field ---------------------------------------------------------------------------------------------------------

LABELS = ("outside", "B-secret", "I-secret", "B-identity", "I-identity")
_SETS = (
    [range(48, 58)], [range(65, 91)], [range(97, 123)], [[45]], [[61]], [[58]], [[34, 39]], [[46, 44, 59]], [[47, 95, 43]], [range(128, 256)],
)
_BITS = np.zeros((len(_SETS), 256), np.int32)
for _k, _set in enumerate(_SETS):
    for _r in _set:
        _BITS[_k, list(_r)] = 1
#: Words that the labelled table has before or in its spans.
SECRET_CUES = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key")
IDENTITY_CUES = ("ssn", "passport", "iban")
CUES = (*SECRET_CUES, *IDENTITY_CUES, "id", "no", "number")
#: Tokens of a line, its own included, among which a cue is looked for.
REACH = 4


@cache
def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    """The cues' hashes, sorted, and the kind of each: 1 secret, 2 identity, 0 other."""
    h = np.array([hashed_words(c.encode())[2][0] for c in CUES], np.uint64)
    kind = np.array([1 if c in SECRET_CUES else 2 if c in IDENTITY_CUES else 0 for c in CUES])
    order = np.argsort(h)
    return h[order], kind[order]


_WORDS = np.array([c < 128 and not (chr(c).isalnum() or c == 95) for c in range(256)])


def shapes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens between white space: starts, ends, and their feature rows (0/1)."""
    start, end, _, _ = hashed_words(raw)
    b = np.frombuffer(raw, np.uint8)
    if not len(start):
        return start, end, np.zeros((0, FEATURES), np.float32)
    counts = []
    for bits in _BITS:
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(bits[b], dtype=np.int32)])
        counts.append(total[end] - total[start])
    digit, upper, lower, dash, equal, colon, quote, stop, slash, other = counts
    length = end - start
    part, _, h, _ = hashed_words(raw, _WORDS)  # the letters and digits that a token begins with
    own = np.searchsorted(start, part, side="right") - 1
    hashes, kinds = _cue_hashes()
    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    known = hashes[place] == h
    cue = np.zeros(len(start), bool)
    cue[own[known]] = True
    # is there a cue of a kind on the token or among those before it on its line?
    line = np.concatenate([np.zeros(1, np.int64), np.cumsum(b == 10)])[start]
    near = []
    for k in (1, 2):
        here = np.zeros(len(start), bool)
        here[own[known & (kinds[place] == k)]] = True
        reach = here.copy()
        for back in range(1, min(REACH, len(start))):
            reach[back:] |= here[:-back] & (line[back:] == line[:-back])
        near.append(reach)
    solid = length - stop - quote
    f = np.stack([
        np.ones(len(start), bool), cue, equal > 0, colon > 0, quote > 0, dash > 0, dash == 2, slash > 0, other > 0,
        digit == 0, (digit >= 1) & (digit <= 4), (digit >= 5) & (digit <= 8), digit == 9, digit >= 10, digit + dash == solid,
        upper > 0, (upper > 0) & (lower == 0) & (digit == 0), lower > 0, (lower + upper > 0) & (digit > 0), (lower + upper > 0) & (digit >= 4) & (length >= 16),
        length >= 12, length >= 24, (equal > 0) & (length == 1), cue & (equal > 0) & (length >= 12), (solid == 11) & (digit == 9) & (dash == 2),
        (upper >= 2) & (digit >= 6) & (lower == 0), *near, near[0] & (digit >= 3) & (length >= 12), near[1] & (digit >= 5), (slash > 0) & (colon > 0), dash >= 3,
    ], 1)
    return start, end, f.astype(np.float32)


FEATURES = 32
Weights = tuple[np.ndarray, np.ndarray]


def labelled(rng: np.random.Generator | None = None, lines: int = 720) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: lines of tokens and their labels, from patterns with fixed pseudo-random fillings; others for held-out lines.

    Twelve of twenty patterns hold no personal data, most of them things that look like it: digests, addresses with digests,
    times, numbers of models, orders and books, long hyphenated words, file names, and cues without a value.
    """
    rng = rng or np.random.default_rng(11)
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    pick = lambda *of: of[int(rng.integers(len(of)))]
    hexa, digit, upper, alnum = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: draw("abcdefghijklmnoprstuéöñ", int(rng.integers(2, 11)))
    plain = lambda: [[word(), word().capitalize(), word() + ".", word() + ",", draw(digit, int(rng.integers(1, 6))), f"{word()}={word()}", f"{word()}-{word()}", draw(digit, 4) + "-" + draw(digit, 2) + "-" + draw(digit, 2), word().upper(), "=", "the", "key", "token", "number", "id:", f"{word()}{rng.integers(9)}", "1,000.50", f"v{rng.integers(9)}.{rng.integers(9)}"][i] for i in rng.integers(0, 18, int(rng.integers(0, 6)))]
    rows = []
    for i in range(lines):
        kind, cue = i % 20, pick(*SECRET_CUES)
        value = draw(hexa if i % 2 else alnum, int(rng.integers(16, 44)))
        sum_ = draw(pick(hexa, hexa.upper()), pick(32, 40, 40, 64))
        iban, ssn = draw(upper, 2) + draw(digit, int(rng.integers(14, 22))), f"{draw(digit, 3)}-{draw(digit, 2)}-{draw(digit, 4)}"
        day = f"{draw('12', 1)}{draw(digit, 3)}-{draw('01', 1)}{draw(digit, 1)}-{draw('012', 1)}{draw(digit, 1)}"
        span = {
            0: [(f"{cue}={value}", 1)], 1: [(cue, 0), ("=", 0), (f'"{value}"' + pick("", "", "###", "!!", ","), 1)], 2: [(f"{cue}:", 0), (value, 1)], 3: [("ssn", 0), (ssn, 3)],
            4: [(ssn + ",", 3)], 5: [("iban", 0), (iban, 3)], 6: [("passport", 0), (pick("no", "number"), 0), (draw("ABCDEFGH", 2) + draw(digit, 7), 3)], 7: [(f"{cue}={draw(alnum, 12)};", 1)],
            8: [(pick("commit", "revision", "sha1", "md5", "digest", "of", word()), 0), (sum_ + pick("", ".", ","), 0)], 9: [(pick("sha256:", "md5:", "sha1-", "#", "git+") + sum_, 0)], 10: [(pick("https://", "//", "http://www.") + f"{word()}.com/{pick('', 'x/')}{sum_}{pick('', '.png', '?v=1')}", 0)],
            11: [(f"{day}T{draw('01', 1)}{draw(digit, 1)}:{draw('012345', 1)}{draw(digit, 1)}:{draw('012345', 1)}{draw(digit, 1)}{pick('', 'Z', '.' + draw(digit, 6), '+00:00')}", 0)], 12: [(pick("model", "part", "order", "no.", "type", "flight", word()), 0), (draw(upper, int(rng.integers(1, 5))) + draw(digit, int(rng.integers(5, 10))), 0)],
            13: [("-".join(word().capitalize() for _ in range(int(rng.integers(2, 5)))) + pick("", draw(digit, 4)), 0)], 14: [(f"{draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}", 0)], 15: [(pick("", "/usr/lib/", "./") + f"{word()}_{draw(digit, 8)}_{draw(digit, 6)}.{pick('jpg', 'so', 'log')}", 0)],
            16: [(pick("isbn", "ean", "sku", word()), 0), (pick(f"978-{draw(digit, 1)}-{draw(digit, 2)}-{draw(digit, 6)}-{draw(digit, 1)}", draw(digit, 13), draw(digit, 10)), 0)], 17: [(cue + pick("", ":", "="), 0), (word(), 0), (word(), 0)],
        }.get(kind, [])
        a, b = plain(), plain()
        if 8 <= kind < 17:  # no cue before what only looks like personal data
            a = [t for t in a if t not in CUES and t != "id:"]
        line = [(t, 0) for t in a] + span + [(t, 0) for t in b]
        if line:
            rows.append(([t for t, _ in line], [y for _, y in line]))
    return rows


def _padded(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lines])
    out = np.zeros((len(lines), int(size.max(initial=0)), lines[0].shape[1]), np.float64)
    for k, x in enumerate(lines):
        out[k, : len(x)] = x
    return out, size


def around(f: np.ndarray) -> np.ndarray:
    """Each token's features, then those of the token before and after."""
    none = np.zeros((1, f.shape[1]), f.dtype)
    return np.concatenate([f, np.concatenate([none, f[:-1]]), np.concatenate([f[1:], none])], 1)


@cache
def field(rounds: int = 150, l2: float = 0.01) -> Weights:
    """Emission weights (features x labels) and transitions, trained once by the driver and sent to the tasks."""
    rows = labelled()
    x, size = _padded([around(shapes(" ".join(t).encode())[2]) for t, _ in rows])
    y = np.zeros(x.shape[:2], np.int64)
    for k, (_, labels) in enumerate(rows):
        y[k, : len(labels)] = labels
    steps, own, n = x.shape[1], np.arange(x.shape[1]) < size[:, None], len(LABELS)
    w, t = np.zeros((x.shape[2], n)), np.zeros((n, n))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t)]
    lse = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
    for r in range(1, rounds + 1):
        e = x @ w
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for i in range(1, steps):
            forward[:, i] = np.where(own[:, i, None], lse(forward[:, i - 1, :, None] + t, 1) + e[:, i], forward[:, i - 1])
        for i in range(steps - 2, -1, -1):
            backward[:, i] = np.where(own[:, i + 1, None], lse(t + (e[:, i + 1] + backward[:, i + 1])[:, None], 2), 0)
        z = lse(forward[:, -1], 1)
        p = np.exp(forward + backward - z[:, None, None]) * own[:, :, None]
        gold = np.eye(n)[y] * own[:, :, None]
        gw = np.einsum("kif,kil->fl", x, gold - p) / len(rows) - l2 * w
        gt = np.zeros((n, n))
        for i in range(1, steps):
            pair = np.exp(forward[:, i - 1, :, None] + t + (e[:, i] + backward[:, i])[:, None] - z[:, None, None]) * own[:, i, None, None]
            gt += np.einsum("ka,kb->ab", gold[:, i - 1], gold[:, i]) - pair.sum(0)
        gt = gt / len(rows) - l2 * t
        for param, grad, (m, v) in ((w, gw, moments[0]), (t, gt, moments[1])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param += 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return w, t


def viterbi(e: np.ndarray, size: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best labels of padded lines: e (lines, tokens, labels)."""
    lines, steps, n = e.shape
    best, back = e[:, 0].copy(), np.zeros((lines, steps, n), np.int8)
    for i in range(1, steps):
        step = best[:, :, None] + t
        back[:, i] = step.argmax(1)
        best = np.where((i < size)[:, None], step.max(1) + e[:, i], best)
    out = np.zeros((lines, steps), np.int64)
    label = best.argmax(1)
    for i in range(steps - 1, -1, -1):
        own = i < size
        out[own, i] = label[own]
        if i:
            label = np.where(own, back[np.arange(lines), i, label], label)
    return out


def tagged(raw: bytes, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of lines of UTF-8 text and their labels."""
    w, t = weights
    start, end, f = shapes(raw)
    labels = np.zeros(len(start), np.int64)
    if not len(start):
        return start, end, labels
    breaks = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.frombuffer(raw, np.uint8) == 10)])
    line = breaks[start]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    stop = np.append(first[1:], len(start))
    k = f.shape[1]
    e = f @ w[:k].astype(np.float32)
    before, after = f @ w[k : 2 * k].astype(np.float32), f @ w[2 * k :].astype(np.float32)
    inner = np.ones(len(start), bool)
    inner[first] = False
    e[inner] += before[np.flatnonzero(inner) - 1]
    inner = np.ones(len(start), bool)
    inner[stop - 1] = False
    e[inner] += after[np.flatnonzero(inner) + 1]
    gain = e[:, 1:].max(1) - e[:, 0] + 2 * max(0.0, float((t - t[0, 0]).max()))
    live = np.flatnonzero(np.maximum.reduceat(gain, first) > 0)
    live = live[np.argsort((stop - first)[live], kind="stable")]
    size_of, i = (stop - first)[live], 0
    while i < len(live):  # lines of similar lengths together, within a bound of cells
        j = i + 1
        while j < len(live) and (j + 1 - i) * size_of[j] <= 400_000:
            j += 1
        own, i = live[i:j], j
        padded, size = _padded([e[first[x] : stop[x]] for x in own])
        found = viterbi(padded, size, t)
        for row, x, n in zip(found, own, size, strict=True):
            labels[first[x] : stop[x]] = row[:n]
    return start, end, labels


#: The value within marked tokens: after a name and its sign; up to the closing quote, or without the signs at its end.
_VALUE = re.compile(rb"""^(?:[A-Za-z_]+[=:])?(?:(["'])(?P<quoted>.+?)\1|["']?(?P<bare>.*?)[^A-Za-z0-9+/=_\x80-\xff-]*$)""", re.S)


def field_spans(raws: list[bytes], weights: Weights) -> list[list[tuple[int, int, int]]]:
    """Of each text, (first byte, number of the kind, last byte) of the spans that the field finds."""
    joined = b"\n".join(raws)
    start, end, labels = tagged(joined, weights)
    begin = np.cumsum([0] + [len(r) + 1 for r in raws])
    out: list[list[tuple[int, int, int]]] = [[] for _ in raws]
    i, marked = 0, np.flatnonzero(labels)
    while i < len(marked):
        j, kind = i + 1, (labels[marked[i]] - 1) // 2
        while j < len(marked) and marked[j] == marked[j - 1] + 1 and labels[marked[j]] == 2 * kind + 2 and b"\n" not in joined[end[marked[j - 1]] : start[marked[j]]]:
            j += 1
        a, b = int(start[marked[i]]), int(end[marked[j - 1]])
        m = _VALUE.match(joined[a:b])
        part = m and ("quoted" if m["quoted"] else "bare")
        if part and m[part]:
            a, b = a + m.start(part), a + m.end(part)
        k = int(np.searchsorted(begin, a, side="right")) - 1
        out[k].append((a - int(begin[k]), len(BASE) + int(kind), b - int(begin[k])))
        i = j
    return out


def spans_of(texts: list[str], weights: Weights) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text, its pattern spans and all its spans, by start and then kind, in code points."""
    for i, j in text_chunks(texts):
        raws = [t.encode() for t in texts[i:j]]
        for text, raw, more in zip(texts[i:j], raws, field_spans(raws, weights), strict=True):
            base = base_spans(text)
            found = list(base)
            if more and len(raw) != len(text):  # from bytes to code points
                point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]).tolist()
                more = [(point[a], k, point[b]) for a, k, b in more]
            starts, reach = [x for x, _, _ in base], [0, *accumulate((y for _, _, y in base), max)]
            found += [(a, k, b) for a, k, b in more if reach[bisect_left(starts, b)] <= a]  # none that a pattern's span meets
            yield base, sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of pattern spans by kind, base_sha256 and spans, of every row.

    A null text is empty; spans of one start are listed by kind; equal rows have equal results; texts of any length are
    whole; other columns are ignored; no rows give none.
    """
    weights = field()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, every in spans_of([t or "" for t in column(batch, "text")], weights):
                rows.append((*(sum(k == n for _, k, _ in base) for n in range(len(BASE))), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if n < len(BASE) else pa.string()) for n, c in enumerate(zip(*rows, strict=True)))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets (overlapping spans by the first's); null stays null.

    All columns stay, whatever their names; texts of any length are whole; equal rows have equal results; no rows give none.
    """
    schema, weights = T.StructType(list(docs.schema)), field()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = column(batch, "text"), batch.schema.get_field_index("text")
            out = []
            for text, (_, every) in zip(texts, spans_of([t or "" for t in texts], weights), strict=True):
                parts, last = [], 0
                for a, k, b in every:
                    if a >= last:
                        parts += [text[last:a], f"[{KINDS[k]}]"]
                    last = max(last, b)
                out.append(text if text is None else "".join(parts) + text[last:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(replace, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    prepared(spark)
    return found(table(spark, sf_dir, "documents"))
