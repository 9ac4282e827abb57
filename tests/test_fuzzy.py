"""Approximate joins against comparing all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.operators import fuzzy as fz


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def some_strings(rng, n, most=14):
    return ["".join(rng.choice(list("abcé "), int(rng.integers(1, most)))) for _ in range(n)]


@pytest.mark.parametrize("most", [0.0, 0.15, 0.3, 0.4, 0.49])
def test_edit_join_equals_all_pairs(spark, most):
    rng = np.random.default_rng(int(most * 100))
    a, b = some_strings(rng, 60), some_strings(rng, 60)
    base = "the same beginning of " * 3  # around the length from which pairs meet by length
    a += [base + "red things", base + "re", None, "", "", a[0], a[0]]
    b += [base + "bed thing", base + "r", base[3:] + "re", None, "", a[0], b[0]]
    expected = {(x, y, distance(x, y)) for x in a if x for y in b if y if distance(x, y) / max(len(x), len(y)) <= most}
    got = fz.edit_join(column(spark, "value", a), column(spark, "option", b), most).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    if most == 0.4:
        best = {}
        for x, y, d in expected:
            best[x] = min(best.get(x, (2, "")), (d / max(len(x), len(y)), y))
        near = fz.closest(column(spark, "value", a), column(spark, "option", b), most).collect()
        assert {r.value: r.option for r in near} == {x: y for x, (_, y) in best.items()} and len(near) == len(best)


def test_edit_join_compares_few(spark):
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12)) for _ in range(2000)]
    left = [n[:5] + "#" + n[6:] for n in names[:500]]
    v, o = column(spark, "value", left), column(spark, "option", names)
    met = v.select("value", F.explode(fz._value_keys(F.col("value"), 0.2, [12])).alias("key")).join(o.select("option", F.explode(fz._option_keys(F.col("option"), 0.2)).alias("key")), "key").select("value", "option").distinct().count()
    assert met < 500 * 2000 / 100
    assert {(r.value, r.option) for r in fz.edit_join(v, o, 0.2).collect()} >= set(zip(left, names, strict=False))


def test_odd_lists(spark):
    some, none = column(spark, "value", ["a", None, ""]), column(spark, "option", [None, ""])
    assert fz.edit_join(some, none).count() == 0 and fz.edit_join(some.limit(0), column(spark, "option", ["a"])).count() == 0
    assert fz.cascade(some, none).count() == 0 and fz.holding_join(some, none).count() == 0
    with pytest.raises(ValueError, match="below 0.5"):
        fz.edit_join(some, none, 0.5)


def test_cascade_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    words = ["red", "blue", "ring", "bolt", "bo", "of", "gear", "gaer", "rings"]
    a = [" ".join(rng.choice(words, int(rng.integers(1, 4)))) for _ in range(50)] + ["rung", "baelt", "zzz"]
    b = [" ".join(rng.choice(words, int(rng.integers(1, 4)))) for _ in range(30)] + ["rong"]
    expected = set()
    for x in set(a):
        found = []
        for y in set(b):
            shared = len({w for w in x.split() if len(w) > 2} & {w for w in y.split() if len(w) > 2})
            far = distance(x, y) / max(len(x), len(y))
            stage = 1 if x == y else 2 if x in y or y in x else 3 if shared else 4 if far <= 0.4 else None
            if stage:
                found.append((stage, -shared if stage == 3 else far if stage == 4 else 0, y))
        if found:
            expected.add((x, min(found)[2], min(found)[0]))
    got = fz.cascade(column(spark, "value", a), column(spark, "option", b)).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_fuzzy_search_equals_all_pairs(spark):
    weights = {"name": 2.0, "note": 1.0}
    items = [(1, "Red Widget", "for rings"), (2, "red widget", "For Rings"), (3, "blue gadget", None), (4, None, None), (None, "red", "red"), (5, "", "widgets, red!"), (5, "", "widgets, red!"), (6, "wigdet", "x")]
    queries = [(10, "rde WIDGET"), (11, "gadgit a"), (12, ""), (13, None), (14, "qqqq"), (15, "red red red")]
    split = lambda s: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower()).split()}
    expected = set()
    for q, text in queries:
        found = []
        for key, *fields in {i for i in items if i[0] is not None}:
            far = {}
            for term in split(text):
                near = [distance(term, w) / max(len(term), len(w)) * 2.0 / weight for f, weight in zip(fields, weights.values(), strict=True) for w in split(f) if distance(term, w) / max(len(term), len(w)) <= 0.4]
                if len(term) > 1 and near:
                    far[term] = min(near)
            if far:
                found.append((-len(far), round(sum(round(v, 9) for v in far.values()), 9), key))
        expected |= {(q, r + 1, key, -n, d) for r, (n, d, key) in enumerate(sorted(found)[:3])}
    got = fz.fuzzy_search(spark.createDataFrame(items, "item int, name string, note string"), spark.createDataFrame(queries, "query int, text string"), weights, limit=3)
    assert {tuple(r) for r in got.collect()} == expected
