"""Running values and breakers of keys that no task holds, against plain loops."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfloom.operators.scans import scanned
from shelfloom.operators.tables import ranged
from shelfloom.streaming import events as ev

START = dt.datetime(2024, 1, 1)


def some_events(rng, n, hot=0.9, gap=600):
    at = np.cumsum(rng.integers(0, 2 * gap, n))
    key = np.where(rng.random(n) < hot, 7, rng.integers(0, 5, n))
    return pd.DataFrame({"site": key.astype("int64"), "ts": [START + dt.timedelta(seconds=int(s)) for s in at], "event_id": np.arange(n), "ok": rng.random(n) < 0.6, "value": rng.integers(0, 100, n)})


@pytest.fixture
def small_ranges(spark):
    """Ranges as they are at scale: small ones are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_of_a_hot_key(spark, small_ranges):
    rows = some_events(np.random.default_rng(1), 4000)
    rows.loc[5, "site"] = None
    cells = [(None if pd.isna(r.site) else int(r.site), r.ts.to_pydatetime(), r.event_id, r.ok, r.value) for r in rows.itertuples()]
    df = spark.createDataFrame(cells, "site long, ts timestamp, event_id long, ok boolean, value long").repartition(5)
    value = F.when(F.col("value") >= 10, F.col("value"))
    got = scanned(df, "site", ["ts", "event_id"], {"total": value, "n": F.lit(1)}, {"before": value, "earlier": F.col("event_id")})
    assert got.columns == ["site", "ts", "event_id", "ok", "value", "total", "n", "before", "earlier"]
    state, expected = defaultdict(lambda: (None, 0, None, None)), {}
    for r in rows.itertuples():
        k = None if pd.isna(r.site) else int(r.site)
        total, n, before, earlier = state[k]
        v = r.value if r.value >= 10 else None
        total = total if v is None else (total or 0) + v
        expected[r.event_id] = (total, n + 1, before, earlier)
        state[k] = (total, n + 1, v, r.event_id)
    found = got.collect()
    assert len(found) == 4000 and {r.event_id: (r.total, r.n, r.before, r.earlier) for r in found} == expected
    # the hot key lies in several ranges: no task of the scan holds it
    sizes = [r["count"] for r in ranged(df, "site", "ts", "event_id").groupBy("__part", "site").count().collect()]
    assert max(sizes) < 0.6 * 4000
    assert scanned(df.limit(0), "site", ["ts"], {"n": F.lit(1)}).count() == 0


def test_breakers_equal_the_replay(spark, small_ranges):
    rng = np.random.default_rng(2)
    for gap, cool, threshold, stretch in ((600, 3600, 3, 50), (5, 3600, 2, 10), (4000, 60, 1, 7), (0, 0, 2, 3), (300, 1000, 4, 10**6)):
        df = spark.createDataFrame(some_events(rng, 3000, gap=max(gap, 1) if gap else 1))
        key = lambda d: sorted((r.site, r.state, r.failures, r.opened_at) for r in d.collect())
        assert key(ev.breaker_states(df, threshold, cool, stretch)) == key(ev.breaker_replay(df, threshold, cool))
    assert ev.breaker_states(df.limit(0)).count() == 0


def test_stretches_can_be_cut_anywhere():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, cool, threshold = int(rng.integers(1, 40)), int(rng.integers(0, 60)), int(rng.integers(1, 4))
        at, ok = np.cumsum(rng.integers(0, 20, n)).tolist(), (rng.random(n) < 0.5).tolist()
        state = ("closed", 0, None)
        for a, o in zip(at, ok, strict=True):
            state = ev.breaker_step(*state, o, dt.datetime.min + dt.timedelta(seconds=a), threshold, cool)
        cuts = sorted({0, n, *rng.integers(0, n, 4).tolist()})
        own = (False, 0, -1)
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = ev.follow(own, *ev.Stretch(at[i:j], ok[i:j], threshold, cool).row(), cool)
        assert own == (state[0] == "open", state[1], -1 if state[2] is None else int((state[2] - dt.datetime.min).total_seconds()))
