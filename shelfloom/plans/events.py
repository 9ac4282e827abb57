"""Replay of the event log: telemetry, states, queues, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import scanned
from ..session import fresh_dir
from ..streaming import events as ev
from .registry import QUERIES, half_up, query, t


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5")
def o01_recent_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recent(t(spark, sf_dir, "events"), "user_id", 5).select("user_id", "event_id")


@query("select event_id from events where event_type in ('error', 'purchase') and ts >= timestamp '2024-01-10' order by ts desc, event_id desc limit 50")
def o02_event_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id")


@query("select user_id as job, cast(json_extract_string(props, '$.k') as bigint) as step, max_by(event_type, (ts, event_id)) as status, count(*) as events, max_by(event_id, (ts, event_id)) as last_event from events group by 1, 2")
def o03_step_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job"), F.get_json_object("props", "$.k").cast("long").alias("step")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"), F.count("*").alias("events"))
    return last.select("job", "step", F.col("x.event_type").alias("status"), "events", F.col("x.event_id").alias("last_event"))


_PAIRS = ", ".join(f"'{a}>{b}'" for a, out in ev.TRANSITIONS.items() for b in out)
_STATES = tuple(ev.TRANSITIONS)


@query(f"""with s as (select event_id, user_id, ts, ([{", ".join(f"'{s}'" for s in _STATES)}])[1 + cast(event_id % 7 as int)] as status from events), l as (select event_id, lag(status) over (partition by user_id order by ts, event_id) as before, status from s)
select event_id, before is null or before = status or before || '>' || status in ({_PAIRS}) as allowed from l""")
def o04_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _STATES))
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("status"))
    own = scanned(e, "user_id", ["ts", "event_id"], previous={"before": F.col("status")})
    return own.select("event_id", F.coalesce(ev.allowed(F.col("before"), F.col("status")), F.lit(True)).alias("allowed"))


@query("""with q as (select o_custkey as job_id, o_orderkey as chunk_id, o_orderdate as created_at, case o_orderstatus when 'O' then 'pending' when 'P' then 'running' else 'done' end as status, o_orderdate + interval 30 day as lease_until, o_orderkey % 4 as attempts from orders),
a as (select job_id, count(*) n from q where status = 'running' and lease_until >= timestamp '1996-01-01' group by 1)
select q.job_id, chunk_id from q left join a on a.job_id = q.job_id where (status = 'pending' or (status = 'running' and lease_until < timestamp '1996-01-01')) and attempts <= 2 and coalesce(n, 0) < 2 qualify row_number() over (partition by q.job_id order by created_at, chunk_id) = 1""")
def o07_claimable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    q = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("lease_until"), (F.col("o_orderkey") % 4).alias("attempts"))
    return ev.claimable(q, "1996-01-01", attempts=2, cap=2)


@query("select event_type, json_extract_string(props, '$.k') as k, min(event_id) as event_id from events group by 1, 2")
def o09_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.min("event_id").alias("event_id"))


@query("""with l as (select user_id, max(ts) as last from events group by 1) select c_custkey as key, case when last is null then 'missing' when timestamp '2024-01-31' - last > interval 20 day then 'expired' when timestamp '2024-01-31' - last > interval 5 day then 'stale' else 'valid' end as state from customer left join l on user_id = c_custkey""")
def o10_cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last"))
    age = F.lit("2024-01-31").cast("timestamp") - F.col("last")
    day = lambda n: F.expr(f"interval '{n}' day")
    state = F.when(F.col("last").isNull(), "missing").when(age > day(20), "expired").when(age > day(5), "stale").otherwise("valid")
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).join(last, "key", "left").select("key", state.alias("state"))


@query("""with recursive e as (select user_id % 20 as site, ts, event_type <> 'error' as ok, row_number() over (partition by user_id % 20 order by ts, event_id) as r from events),
run as (select site, 0::bigint as r, 'closed' as state, 0 as failures, null::timestamp as opened from (select distinct site from e)
union all select e.site, e.r, case when state = 'open' and e.ts - opened < interval 1 hour then 'open' when ok then 'closed' when state = 'open' or failures >= 2 then 'open' else 'closed' end,
case when state = 'open' and e.ts - opened < interval 1 hour then failures when ok then 0 else failures + 1 end, case when state = 'open' and e.ts - opened < interval 1 hour then opened when ok then null when state = 'open' or failures >= 2 then e.ts end
from run join e on e.site = run.site and e.r = run.r + 1)
select site, state, failures, strftime(opened, '%Y-%m-%d %H:%M:%S.%f') as opened_at from run qualify row_number() over (partition by site order by r desc) = 1""")
def o12_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent state, from summaries of stretches that can be joined on."""
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("site"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return ev.breaker_states(e).withColumn("opened_at", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""with o as (select *, event_type = 'error' as bad, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where ts > timestamp '2024-01-20'), f as (select user_id, min(r) filter (where not bad) as first_ok, count(*) as n, count(*) filter (where bad) as failures from o group by 1)
select user_id, failures, coalesce(first_ok - 1, n) as consecutive from f""")
def o13_consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").where(F.col("ts") > F.lit("2024-01-20").cast("timestamp"))
    bad, place = F.col("event_type") == "error", F.struct("ts", "event_id")
    f = e.groupBy("user_id").agg(F.count_if(bad).alias("failures"), F.max(F.when(~bad, place)).alias("last_ok"))
    after = e.where(bad).join(f.select("user_id", "last_ok"), "user_id").where(F.col("last_ok").isNull() | (place > F.col("last_ok"))).groupBy("user_id").agg(F.count("*").alias("n"))
    return f.join(after, "user_id", "left").select("user_id", "failures", F.coalesce("n", F.lit(0)).cast("long").alias("consecutive"))


@query("""with e as (select *, event_type = 'error' as bad, cast(json_extract_string(props, '$.k') as double) as k from events), h as (select user_id, hour(ts) as h, count(*) as n from e where bad group by 1, 2), p as (select user_id, h from h qualify row_number() over (partition by user_id order by n desc, h) = 1)
select e.user_id, count(*) filter (where bad) as failures, count(*) filter (where bad and ts > timestamp '2024-01-31' - interval 24 hour) as last_day, floor(avg(k) filter (where bad) * 100 + 0.5) / 100 as retries, floor(count(*) filter (where not bad) * 10000.0 / count(*) + 0.5) / 10000 as success_rate, any_value(h)::int as peak_hour from e left join p on e.user_id = p.user_id group by 1""")
def o13_failure_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each site: all and those of the day before the snapshot, mean retries, success rate and the hour with most of them (ties to the earlier)."""
    bad = F.col("event_type") == "error"
    e = t(spark, sf_dir, "events").withColumns({"bad": bad, "k": F.get_json_object("props", "$.k").cast("double")})
    day = F.col("ts") > F.lit("2024-01-31").cast("timestamp") - F.expr("interval 24 hours")
    failing = F.when(F.col("bad"), F.col("k"))
    # one row for each hour of a site, then one for the site
    c = e.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count("*").alias("n"), F.count_if("bad").alias("f"), F.count_if(F.col("bad") & day).alias("d"), F.sum(failing).alias("k"), F.count(failing).alias("kn"))
    peak = F.min_by(F.when(F.col("f") > 0, F.col("h")), F.struct(-F.col("f"), F.col("h")))
    f, n = F.sum("f"), F.sum("n")
    return c.groupBy("user_id").agg(f.alias("failures"), F.sum("d").alias("last_day"), half_up(F.try_divide(F.sum("k"), F.sum("kn"))).alias("retries"), half_up((n - f) / n, 4).alias("success_rate"), peak.alias("peak_hour"))


@query("""with s as (select user_id, count(*) filter (where event_type <> 'error') * 1.0 / count(*) as ok, count(*) filter (where event_type = 'purchase') * 1.0 / count(*) as done, least(count(*), 20) / 20.0 as seen from events group by 1), h as (select user_id, floor((0.5 * ok + 0.3 * done + 0.2 * seen) * 10000 + 0.5) / 10000 as score from s)
select user_id, score, case when score >= 0.85 then 'healthy' when score >= 0.6 then 'degraded' when score >= 0.3 then 'unhealthy' else 'critical' end as state from h""")
def o14_health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    score = 0.5 * F.count_if(F.col("event_type") != "error") / n + 0.3 * F.count_if(F.col("event_type") == "purchase") / n + 0.2 * F.least(n, F.lit(20)) / 20
    s = t(spark, sf_dir, "events").groupBy("user_id").agg(half_up(score, 4).alias("score"))
    v = F.col("score")
    return s.withColumn("state", F.when(v >= 0.85, "healthy").when(v >= 0.6, "degraded").when(v >= 0.3, "unhealthy").otherwise("critical"))


@query("select event_id from events where ts >= timestamp '2024-01-31' - interval 7 day")
def o16_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-31").cast("timestamp") - F.expr("interval 7 days")).select("event_id")


@query("""with s as (select user_id, max(ts) as last, count(*) filter (where event_type = 'error') as recent from events group by 1) select user_id, case when timestamp '2024-01-31' - last > interval 2 hour then greatest(0, recent - 1) else recent end as recent from s""")
def o16_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent failures of each site as of a snapshot: one fewer, not below none, where nothing came for two hours."""
    s = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "error").alias("recent"))
    idle = F.col("last") < F.lit("2024-01-31").cast("timestamp") - F.expr("interval 2 hours")
    return s.select("user_id", F.when(idle, F.greatest(F.lit(0), F.col("recent") - 1)).otherwise(F.col("recent")).alias("recent"))


@query("""with l as (select coalesce(json_extract_string(props, '$.k'), cast(event_id as varchar)) || '|' || event_type as key, * from events), m as (select key, max(ts) as ts, max(event_id) as event_id, count(*) as merged from l group by 1) select key, event_id, merged from m order by ts desc, key limit 100""")
def o20_log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.coalesce(F.get_json_object("props", "$.k"), F.col("event_id").cast("string")), F.lit("|"), F.col("event_type"))
    m = t(spark, sf_dir, "events").groupBy(key.alias("key")).agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"), F.count("*").alias("merged"))
    return m.orderBy(F.desc("ts"), "key").limit(100).select("key", "event_id", "merged")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, in the batches in which they are found."""
    return spark.readStream.schema(t(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def run_to_end(stream: DataFrame, sink, spark: SparkSession) -> None:
    stream.writeStream.outputMode("update").option("checkpointLocation", fresh_dir(spark, "stream")).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


@query("select user_id, event_type, count(*) as n, cast(sum(cast(value as decimal(18,6))) as double) as total from events group by 1, 2")
def b03_stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by user and type kept by a stream: a batch that is replayed replaces its own sums."""
    sink = ev.RollupSink(fresh_dir(spark, "rollup"), ["user_id", "event_type"], {"n": F.lit(1), "total": F.col("value").cast("decimal(18,6)")})
    run_to_end(streamed(spark, sf_dir, "events"), sink, spark)
    sink.compact(spark)
    return sink.table(spark).withColumn("total", F.col("total").cast("double"))


@query(QUERIES["o12_circuit_breaker"][1])
def o12_breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breakers' states after a stream of the events has been read to its end, from state with timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before, path = spark.conf.get(name), fresh_dir(spark, "states")
    ev.with_rocksdb(spark)
    try:
        e = streamed(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("site"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
        run_to_end(ev.circuit_breaker(e, idle_s=3650 * 86400), lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), spark)
    finally:
        spark.conf.set(name, before)
    last = spark.read.parquet(path).groupBy("site").agg(F.max_by(F.struct("state", "failures", "opened_at"), "batch").alias("x"))
    return last.select("site", "x.state", "x.failures", F.date_format("x.opened_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("opened_at"))
