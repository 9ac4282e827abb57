"""Stateful work over the event stream: telemetry, deduplication, transitions, breakers. Each has a batch form over a snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import saved

#: Allowed transitions of the workflow: fixed values.
TRANSITIONS = {
    "imported": ("scraping",),
    "scraping": ("scraped", "failed", "imported"),
    "scraped": ("consolidating", "finalizing", "imported", "failed"),
    "consolidating": ("finalizing", "scraped", "failed"),
    "finalizing": ("exporting", "scraped", "failed"),
    "exporting": ("finalizing", "failed"),
    "failed": ("imported",),
}


def allowed(old, new):
    """May a status follow another? The same one may."""
    pairs = [f"{a}>{b}" for a, out in TRANSITIONS.items() for b in out]
    return (old == new) | F.concat(old, F.lit(">"), new).isin(*pairs)


def bulk_transition(rows: DataFrame, moves: DataFrame, key: str, reset: tuple[str, ...] = ()) -> DataFrame:
    """rows with the statuses of moves (key, to_status) if all are allowed; else an error. rows: key, status. Columns of `reset` are emptied where a status moves."""
    both = rows.join(moves, key, "left")
    bad = both.where(F.col("to_status").isNotNull() & ~allowed(F.col("status"), F.col("to_status"))).count()
    if bad:
        raise ValueError(f"{bad} transitions are not allowed; nothing changes")
    kept = {c: F.when(F.col("to_status").isNull(), F.col(c)) for c in reset}
    return both.withColumns(kept | {"status": F.coalesce("to_status", "status")}).drop("to_status")


def recent(events: DataFrame, job: str, n: int) -> DataFrame:
    """The newest n events of each job: the bounded buffer as a query."""
    r = F.row_number().over(Window.partitionBy(job).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def timed(stream: DataFrame) -> DataFrame:
    """ts as a timestamp, which watermarks need; times without a zone are taken in the session's."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """First arrival of each key within the watermark."""
    return timed(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and errors of each window of a stream with a watermark on ts; state for closed windows goes with it."""
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


BREAKER = "site long, state string, failures int, opened_at timestamp"


def breaker_step(state: str, failures: int, opened, ok: bool, at, threshold: int, cool_s: float):
    """One event through a breaker: closed until `threshold` failures in a row, open for cool_s, then half open for one try."""
    if state == "open":
        if (at - opened).total_seconds() < cool_s:
            return "open", failures, opened
        state = "half_open"
    if ok:
        return "closed", 0, None
    failures += 1
    if state == "half_open" or failures >= threshold:
        return "open", failures, at
    return state, failures, opened


class BreakerOfSite(StatefulProcessor):
    """A site's breaker as state with a timer: sites that stay idle give their state back."""

    def __init__(self, threshold: int, cool_s: float, idle_s: float) -> None:
        self.threshold, self.cool_s, self.idle_s = threshold, cool_s, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("breaker", "state string, failures int, opened_us long, last_us long")

    def row(self, site: int, state: str, failures: int, opened: int, last: int) -> pd.DataFrame:
        at = lambda us: pd.Series([None if us < 0 else pd.Timestamp(us, unit="us")], dtype="datetime64[ns]")
        return pd.DataFrame({"site": [site], "state": [state], "failures": np.array([failures], np.int32), "opened_at": at(opened), "last_at": at(last)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, failures, opened, last = self.own.get() if self.own.exists() else ("closed", 0, -1, -1)
        opened_at = None if opened < 0 else pd.Timestamp(opened, unit="us")
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for at, ok in zip(events.ts, events.ok, strict=True):
            state, failures, opened_at = breaker_step(state, failures, opened_at, bool(ok), at, self.threshold, self.cool_s)
        us = lambda t: -1 if t is None else int(t.value // 1000)
        last = max(last, us(pd.Timestamp(events.ts.max())))
        self.own.update((state, int(failures), us(opened_at), last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last // 1000 + self.idle_s * 1000))
        yield self.row(key[0], state, failures, us(opened_at), last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, _, last = self.own.get()
        self.own.clear()
        yield self.row(key[0], "idle", 0, -1, last)

    def close(self) -> None:
        pass


def circuit_breaker(stream: DataFrame, threshold: int = 3, cool_s: float = 3600, late: str = "1 hour", idle_s: float = 7 * 86400) -> DataFrame:
    """site, state, failures, opened_at, last_at of each site's breaker after each batch. stream: site, ts, event_id, ok.

    Events of a batch are taken in (ts, event_id) order, batches in turn: an event that comes a batch late, but within `late`,
    counts as if it came after the others; later ones are dropped by the watermark. A site without events for idle_s of event
    time is told once as idle and forgotten, so state is bounded by the sites of that time. Needs the RocksDB state store.
    """
    own = timed(stream).withWatermark("ts", late).groupBy("site")
    return own.transformWithStateInPandas(BreakerOfSite(threshold, cool_s, idle_s), "site long, state string, failures int, opened_at timestamp, last_at timestamp", "update", "eventtime")


def with_rocksdb(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RollupSink:
    """Sums by key of a stream, in files: each batch's sums lie in a folder of its own number, so a batch that is replayed after a failure replaces what it wrote before.

    path is in a shared or remote folder. sums: name of the sum: column or expression. A batch is one aggregation and one
    write; `compact` brings the folders of many batches together.
    """

    def __init__(self, path: str, keys: list[str], sums: dict[str, Column]) -> None:
        self.path, self.keys, self.sums = path, keys, sums

    def __call__(self, batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*self.keys).agg(*(F.sum(v).alias(c) for c, v in self.sums.items()))
        part.write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")

    def _folders(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the folders of a kind that were written to the end."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        store = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in store.listStatus(root) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if store.exists(root) else []
        return sorted(int(n.split("=")[1]) for n in names)

    def table(self, spark: SparkSession) -> DataFrame:
        """keys and sums over all batches: the last compacted state and the batches after it."""
        upto = max(self._folders(spark, "states"), default=-1)
        paths = [f"{self.path}/batches/batch={n}" for n in self._folders(spark, "batches") if n > upto] + [f"{self.path}/states/upto={upto}"] * (upto >= 0)
        if not paths:
            raise ValueError(f"{self.path}: nothing was written yet")
        return spark.read.parquet(*paths).groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums))

    def compact(self, spark: SparkSession) -> None:
        """Writes the state of all batches so far. Batches that it holds are passed over from then on, even if they stay."""
        done = self._folders(spark, "batches")
        if done:
            self.table(spark).write.mode("overwrite").parquet(f"{self.path}/states/upto={done[-1]}")


def breaker_replay(events: DataFrame, threshold: int = 3, cool_s: float = 3600) -> DataFrame:
    """The same over a snapshot, an event at a time: each site's events in order, as batches of one sorted partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, now, failures, opened = None, "closed", 0, None
        for f in frames:
            out = []
            for s, at, ok in zip(f.site, f.ts, f.ok, strict=True):
                if s != site:
                    if site is not None:
                        out.append((site, now, failures, opened))
                    site, now, failures, opened = s, "closed", 0, None
                now, failures, opened = breaker_step(now, failures, opened, bool(ok), at, threshold, cool_s)
            yield pd.DataFrame(out, columns=["site", "state", "failures", "opened_at"]).astype({"opened_at": "datetime64[ns]"})
        if site is not None:
            yield pd.DataFrame([(site, now, failures, opened)], columns=["site", "state", "failures", "opened_at"]).astype({"opened_at": "datetime64[ns]"})

    return events.select("site", "ts", "event_id", "ok").repartition("site").sortWithinPartitions("site", "ts", "event_id").mapInPandas(run, BREAKER)


class Stretch:
    """What a stretch of one site's events makes of any state that it begins with.

    closed: the end for each number of failures in a row before the stretch. For a breaker that was opened before: tries, the
    end by which event is the first one let through, as a step function of time (until, in microseconds). An end is (open?,
    failures, counted on from what came before?, opened at, or None).
    """

    def __init__(self, at: list[int], ok: list[bool], threshold: int, cool: int) -> None:
        n = len(at)
        after = [max(j + 1, k) for j, k in enumerate(np.searchsorted(at, np.array(at, np.int64) + cool).tolist())]
        closed = [(False, f, False, None) for f in range(threshold)]
        tries: list = [None] * n
        for j in range(n - 1, -1, -1):
            if ok[j]:
                tries[j] = closed[0]
                closed = [closed[0]] * threshold
            else:
                k = after[j]
                then = (True, 0, True, at[j]) if k >= n else tries[k]
                opened = lambda f, then=then: (then[0], then[1] + f, then[2], then[3]) if then[2] else then
                tries[j] = opened(1)
                whole = opened(threshold)
                closed = [*closed[1:], (whole[0], whole[1], False, whole[3])]
        self.closed, self.until, self.tries = closed, [], []
        for j in range(n):
            if self.tries and self.tries[-1] == tries[j]:
                self.until[-1] = at[j]
            else:
                self.until.append(at[j])
                self.tries.append(tries[j])
            if at[j] >= at[0] + cool:  # a breaker opened before the stretch lets this one through at the latest
                break

    def row(self) -> tuple:
        flat = lambda ends: [[int(e[0]), e[1], int(e[2]), -1 if e[3] is None else e[3]] for e in ends]
        return flat(self.closed), self.until, flat(self.tries)


def follow(state: tuple[bool, int, int], closed, until, tries, cool: int) -> tuple[bool, int, int]:
    """The state (open?, failures, opened at or -1) after a stretch."""
    is_open, failures, opened = state
    if not is_open:
        o, f, _, at = closed[failures]
        return bool(o), int(f), int(at)
    k = int(np.searchsorted(np.asarray(until), opened + cool))
    if k == len(until):
        return state
    o, f, on, at = tries[k]
    return bool(o), int(f) + (failures if on else 0), int(at)


def breaker_states(events: DataFrame, threshold: int = 3, cool_s: float = 3600, stretch: int = 200_000) -> DataFrame:
    """State of each site's breaker after a snapshot of events (site, ts, event_id, ok): breaker_replay for sites of any size.

    Events are ranged by (site, ts, event_id), so a busy site lies in many tasks. Each task sums its stretches up, of at most
    `stretch` events, without knowing the state before; then each site's summaries, a few rows, are followed in order.
    """
    cool = round(cool_s * 1_000_000)
    kind = "array<array<long>>"

    def sum_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            f = pd.concat(held)
            closed, until, tries = Stretch(f.at_us.tolist(), f.ok.tolist(), threshold, cool).row()
            held.clear()
            return pd.DataFrame({"site": [f.site.iloc[0]], "at_us": [f.at_us.iloc[0]], "event_id": [f.event_id.iloc[0]], "closed": [closed], "until": [until], "tries": [tries]})

        for frame in frames:
            for _, f in frame.groupby("site", sort=False):
                if held and (held[-1].site.iloc[0] != f.site.iloc[0] or sum(map(len, held)) >= stretch):
                    yield done()
                held.append(f)
        if held:
            yield done()

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, state = None, (False, 0, -1)

        def end() -> tuple:
            return site, "open" if state[0] else "closed", state[1], pd.Timestamp(state[2], unit="us") if state[0] else None

        for f in frames:
            out = []
            for r in f.itertuples():
                if r.site != site:
                    out += [end()] if site is not None else []
                    site, state = r.site, (False, 0, -1)
                state = follow(state, r.closed, r.until, r.tries, cool)
            yield pd.DataFrame(out, columns=["site", "state", "failures", "opened_at"]).astype({"opened_at": "datetime64[ns]"})
        if site is not None:
            yield pd.DataFrame([end()], columns=["site", "state", "failures", "opened_at"]).astype({"opened_at": "datetime64[ns]"})

    own = events.select("site", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_id", "ok").where("site is not null and ts is not null")
    order = ["site", "at_us", "event_id"]
    parts = own.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(sum_up, f"site long, at_us long, event_id long, closed {kind}, until array<long>, tries {kind}")
    return saved(parts, "stretches").repartition("site").sortWithinPartitions(*order).mapInPandas(chain, BREAKER)


def claimable(chunks: DataFrame, as_of: str, attempts: int, cap: int) -> DataFrame:
    """The next chunk of each job under its cap of running ones: pending, or running with a lease that has run out."""
    now = F.lit(as_of).cast("timestamp")
    free = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_until") < now))
    active = chunks.where((F.col("status") == "running") & (F.col("lease_until") >= now)).groupBy("job_id").agg(F.count("*").alias("active"))
    own = chunks.where(free & (F.col("attempts") <= attempts)).join(active, "job_id", "left").where(F.coalesce("active", F.lit(0)) < cap)
    r = F.row_number().over(Window.partitionBy("job_id").orderBy("created_at", "chunk_id"))
    return own.withColumn("__r", r).where("__r = 1").select("job_id", "chunk_id")
