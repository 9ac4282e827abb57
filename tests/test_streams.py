"""Streams with state: breakers whose idle sites go, late events, and rollups that a replayed batch leaves right."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfloom.streaming import events as ev

START = dt.datetime(2024, 1, 1)
EVENT = "site long, ts timestamp, event_id long, ok boolean"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ev.with_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_breaker_forgets_idle_sites_and_takes_late_events(spark, tmp_path):
    batches = [
        [(1, at(0), 1, False), (1, at(0.1), 2, False), (2, at(0.2), 3, True), (2, at(0), 0, False)],
        [(1, at(0.05), 4, False), (2, at(5), 5, True)],  # site 1: late, within the watermark, counts as the third failure
        [(1, at(1), 6, True), (2, at(40), 7, False)],  # site 1: behind the watermark of 5 hours less one, dropped
        [(3, at(41), 8, True)],  # the watermark has passed a day after site 1's last event
    ]
    seen = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        out = ev.circuit_breaker(stream, threshold=3, cool_s=36000, idle_s=86400)
        told = []
        out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(lambda df, _, told=told: told.extend(df.collect())).start().awaitTermination(120)
        seen.append({r.site: (r.state, r.failures) for r in told})
    assert seen[0] == {1: ("closed", 2), 2: ("closed", 0)}
    assert seen[1] == {1: ("open", 3), 2: ("closed", 0)}
    assert seen[2][2] == ("closed", 1) and seen[2].get(1) in (None, ("idle", 0))
    last = seen[2] | seen[3]
    assert last[1] == ("idle", 0) and last[3] == ("closed", 0)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = [(k % 3, k, 1.5 * k) for k in range(100)]
    for n in range(4):
        spark.createDataFrame(rows[n * 25 : n * 25 + 25], "k int, v long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sink = ev.RollupSink(f"file://{tmp_path}/out", ["k"], {"total": F.col("v"), "n": F.lit(1)})
    expected = {k: (sum(v for j, v, _ in rows if j == k), sum(j == k for j, _, _ in rows)) for k in range(3)}
    killed = []

    def write(batch, number):
        sink(batch, number)
        if number == 1 and not killed:  # ends after the write, before the batch is known as done
            killed.append(number)
            raise RuntimeError("killed")

    def run():
        stream = spark.readStream.schema("k int, v long, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(write).start().awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    table = lambda: {r.k: (r.total, r.n) for r in sink.table(spark).collect()}
    assert killed and table() == expected
    sink.compact(spark)
    assert table() == expected
    sink(spark.createDataFrame([(7, 1, 0.0)], "k int, v long, x double"), 4)
    assert table() == expected | {7: (1, 1)}
    with pytest.raises(ValueError, match="nothing was written"):
        ev.RollupSink(f"file://{tmp_path}/none", ["k"], {"n": F.lit(1)}).table(spark)
