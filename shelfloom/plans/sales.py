"""Sales, cost and dashboard aggregations over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import medians, ranked_globally, ranked_within
from .registry import half_up, money, query, t

DONE = ("F", "O")
#: The statuses that counts are filled up to: those of orders, and one that no order has.
STATUSES = ("F", "O", "P", "X")
_R2 = "floor({} * 100 + 0.5) / 100"


def sales_trend(orders: DataFrame, period: str = "month", start: str | None = None, end: str | None = None) -> DataFrame:
    """Revenue and number of finished orders by period, within [start, end]."""
    o = orders.where(F.col("o_orderstatus").isin(*DONE))
    if start:
        o = o.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp"))
    if end:
        o = o.where(F.col("o_orderdate") <= F.lit(end).cast("timestamp"))
    return o.groupBy(F.date_format(F.date_trunc(period, "o_orderdate"), "yyyy-MM-dd").alias("period_date")).agg(
        F.sum(money("o_totalprice")).cast("double").alias("revenue"), F.count("*").alias("orders")
    )


@query(f"""with o as (select o_orderkey, o_totalprice from orders where o_orderstatus in ('F','O') and o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-12-31'),
x as (select coalesce(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2))), 0) as tax from lineitem join o on l_orderkey = o_orderkey)
select cast(coalesce(sum(cast(o_totalprice as decimal(12,2))), 0) as double) as total_revenue, count(*) as total_orders,
case when count(*) > 0 then {_R2.format("cast(sum(cast(o_totalprice as decimal(12,2))) as double) / count(*)")} else 0 end as average_order_value, cast(max(tax) as double) as total_tax from o, x""")
def e01_sales_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(*DONE) & F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")))
    tax = t(spark, sf_dir, "lineitem").join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(F.coalesce(F.sum(money("l_extendedprice") * money("l_tax", "decimal(4,2)")), F.lit(0)).cast("double").alias("total_tax"))
    revenue = F.sum(money("o_totalprice")).cast("double")
    metrics = o.agg(F.coalesce(revenue, F.lit(0.0)).alias("total_revenue"), F.count("*").alias("total_orders"), F.when(F.count("*") > 0, half_up(revenue / F.count("*"))).otherwise(0.0).alias("average_order_value"))
    return metrics.join(tax)  # two single rows


@query("select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as period_date, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as revenue, count(*) as orders from orders where o_orderstatus in ('F','O') group by 1")
def e02_sales_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_trend(t(spark, sf_dir, "orders"))


@query("""select p_name as name, cast(sum(l_quantity) as bigint) as quantity, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as revenue
from lineitem join part on l_partkey = p_partkey group by p_partkey, p_name order by sum(cast(l_extendedprice as decimal(12,2))) desc, p_partkey limit 10""")
def e03_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.sum(money("l_extendedprice")).alias("revenue"))
    top = sums.orderBy(F.desc("revenue"), "l_partkey").limit(10)
    return top.join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("name"), "quantity", F.col("revenue").cast("double").alias("revenue"))


@query("select count(*) as total_count, count(*) filter (where p_retailprice >= 1000) as premium_count, count(*) filter (where p_size = 1) as smallest_count, count(*) filter (where p_size <= 5) as low_count, cast(max(p_size) as int) as largest from part")
def e04_product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").agg(
        F.count("*").alias("total_count"), F.count_if(F.col("p_retailprice") >= 1000).alias("premium_count"), F.count_if(F.col("p_size") == 1).alias("smallest_count"),
        F.count_if(F.col("p_size") <= 5).alias("low_count"), F.max("p_size").alias("largest"),
    )


AS_OF = "2024-01-20 00:00:00"


@query(f"""select count(*) as total_jobs, count(*) filter (where event_type = 'purchase') as completed_jobs, count(*) filter (where event_type = 'error') as failed_jobs,
strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_job_created from events where ts > timestamp '{AS_OF}' - interval 24 hour and ts <= timestamp '{AS_OF}'""")
def e05_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit(AS_OF).cast("timestamp")
    recent = t(spark, sf_dir, "events").where((F.col("ts") > end - F.expr("interval 24 hours")) & (F.col("ts") <= end))
    return recent.agg(F.count("*").alias("total_jobs"), F.count_if(F.col("event_type") == "purchase").alias("completed_jobs"), F.count_if(F.col("event_type") == "error").alias("failed_jobs"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_job_created"))


@query("select o_orderstatus as status, count(*) as count from orders where o_orderdate < timestamp '1998-01-01' group by 1")
def e06_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).groupBy(F.col("o_orderstatus").alias("status")).count()


def zero_filled(counts: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """A row for each of values: counts (key, count), 0 where there is none."""
    every = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(key))
    return every.join(counts, key, "left").select(key, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


_VALUES = ", ".join(f"('{s}')" for s in STATUSES)


@query(f"select s as status, coalesce(n, 0)::bigint as count from (values {_VALUES}) v(s) left join (select o_orderstatus, count(*) n from orders group by 1) o on s = o_orderstatus")
def e07_status_counts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_filled(t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).count(), "status", STATUSES)


@query(f"select s as status, coalesce(n, 0)::bigint as count, cast(floor(coalesce(n, 0) * 100.0 / (select count(*) from orders) + 0.5) as bigint) as percent from (values {_VALUES}) v(s) left join (select o_orderstatus, count(*) n from orders group by 1) o on s = o_orderstatus")
def e08_status_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = e07_status_counts_filled(spark, sf_dir)  # a row for each status
    return counts.withColumn("percent", F.floor(F.col("count") * 100 / F.sum("count").over(Window.partitionBy()) + 0.5))


@query("""select strftime(ts, '%Y-%m-%d') as date, event_type as run_type, count(*) as run_count, cast(sum(cast(value as decimal(18,6))) as double) as total_cost,
cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total_tokens, floor(cast(sum(cast(value as decimal(18,6))) as double) / count(*) * 10000 + 0.5) / 10000 as avg_cost_per_run from events group by 1, 2""")
def e09_daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(money("value", "decimal(18,6)")).cast("double")
    return t(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("run_type")).agg(
        F.count("*").alias("run_count"), total.alias("total_cost"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total_tokens"), half_up(total / F.count("*"), 4).alias("avg_cost_per_run")
    )


@query("select strftime(date_trunc('month', o_orderdate), '%Y-%m') as month, o_orderpriority as run_type, count(*) as run_count, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as total_cost from orders group by 1, 2")
def e10_monthly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("run_type")).agg(F.count("*").alias("run_count"), F.sum(money("o_totalprice")).cast("double").alias("total_cost"))


@query("select coalesce(cast(sum(cast(value as decimal(18,6))) as double), 0) as total_cost, count(*) as total_runs, coalesce(cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint), 0) as total_tokens from events where cast(ts as date) between date '2024-01-05' and date '2024-01-15'")
def e11_cost_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    # bounds on ts itself, so that they reach the scan
    own = t(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-16").cast("timestamp")))
    return own.agg(F.coalesce(F.sum(money("value", "decimal(18,6)")).cast("double"), F.lit(0.0)).alias("total_cost"), F.count("*").alias("total_runs"), F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("long")), F.lit(0)).alias("total_tokens"))


@query("""select user_id % 20 as config_id, strftime(ts, '%Y-%m-%d') as metric_date, count(*) as total_runs, count(*) filter (where event_type <> 'error') as passed_runs,
count(*) filter (where event_type = 'error') as failed_runs, cast(floor(cast(sum(cast(value as decimal(18,6))) as double) / count(*) + 0.5) as int) as avg_duration from events group by 1, 2""")
def e12_daily_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("config_id"), F.date_format("ts", "yyyy-MM-dd").alias("metric_date")).agg(
        F.count("*").alias("total_runs"), F.count_if(F.col("event_type") != "error").alias("passed_runs"), F.count_if(F.col("event_type") == "error").alias("failed_runs"),
        F.floor(F.sum(money("value", "decimal(18,6)")).cast("double") / F.count("*") + 0.5).cast("int").alias("avg_duration"),
    )


@query("""with d as (select user_id % 20 as config_id, cast(ts as date) as day, count(*) as n, count(*) filter (where event_type <> 'error') as ok, cast(floor(cast(sum(cast(value as decimal(18,6))) as double) / count(*) + 0.5) as bigint) as ms from events group by 1, 2)
select strftime(day, '%Y-%m-%d') as metric_date, cast(sum(n) as bigint) as total_runs, floor(sum(ok) * 100.0 / sum(n) * 100 + 0.5) / 100 as pass_rate, cast(floor(sum(ms * n) * 1.0 / sum(n) + 0.5) as bigint) as avg_duration from d group by 1""")
def e13_health_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e12_daily_health(spark, sf_dir).groupBy("metric_date").agg(
        F.sum("total_runs").alias("total_runs"), half_up(F.sum("passed_runs") * 100 / F.sum("total_runs")).alias("pass_rate"), F.floor(F.sum(F.col("avg_duration") * F.col("total_runs")) / F.sum("total_runs") + 0.5).alias("avg_duration")
    )


@query("""with s as (select user_id, count(*) as runs, count(*) filter (where event_type <> 'error') as ok, count(*) filter (where event_type = 'purchase') as extracted from events group by 1),
x as (select user_id, runs, cast(floor(70.0 * ok / runs + 30.0 * extracted / runs + 0.5) as int) as score from s)
select user_id, runs, score, case when score >= 90 then 'healthy' when score >= 60 then 'degraded' else 'broken' end as status from x""")
def e14_health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "purchase").alias("extracted"))
    s = s.select("user_id", "runs", F.floor(70 * F.col("ok") / F.col("runs") + 30 * F.col("extracted") / F.col("runs") + 0.5).cast("int").alias("score"))
    return s.withColumn("status", F.when(F.col("score") >= 90, "healthy").when(F.col("score") >= 60, "degraded").otherwise("broken"))


@query("select event_type, count(*) as runs, count(distinct user_id) as users, floor(count(*) filter (where value > 50) * 100.0 / count(*) * 100 + 0.5) / 100 as success_rate from events group by 1")
def e16_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.count_distinct("user_id").alias("users"), half_up(F.count_if(F.col("value") > 50) * 100 / F.count("*")).alias("success_rate"))


@query("""select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as step, count(*) as failures, max(page_id) as last_page from pages group by 1 order by failures desc, step limit 10""")
def e18_failing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("step")).agg(F.count("*").alias("failures"), F.max("page_id").alias("last_page")).orderBy(F.desc("failures"), "step").limit(10)


_PROVIDERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE")


@query("""select p as provider, coalesce(n, 0)::bigint as jobs, coalesce(c, 0) as cost from (values ('1-URGENT'),('2-HIGH'),('3-MEDIUM'),('9-NONE')) v(p)
left join (select o_orderpriority, count(*) n, cast(sum(cast(o_totalprice as decimal(12,2))) as double) c from orders group by 1) o on p = o_orderpriority""")
def e19_provider_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = t(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(*_PROVIDERS)).groupBy(F.col("o_orderpriority").alias("provider")).agg(F.count("*").alias("jobs"), F.sum(money("o_totalprice")).cast("double").alias("cost"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, _PROVIDERS))).alias("provider"))
    return every.join(sums, "provider", "left").select("provider", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


@query("select cast(sum(cast(o_totalprice as decimal(12,2))) as double) as total_cost, count(*) as jobs, count(*) filter (where o_orderstatus = 'F') as completed, count(*) filter (where o_orderstatus = 'P') as failed from orders")
def e20_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").agg(F.sum(money("o_totalprice")).cast("double").alias("total_cost"), F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"))


@query("""select f as field, cast(sum(case when ok then 1 else 0 end) as bigint) as filled, count(*) as total, cast(floor(sum(case when ok then 1 else 0 end) * 100.0 / count(*) + 0.5) as bigint) as percent from (
select 'text' f, text is not null and trim(text) <> '' ok from documents union all select 'lang', lang = 'en' from documents union all select 'source', source is not null from documents union all select 'long', n_chars >= 500 from documents) group by 1""")
def e24_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"text": F.trim("text") != "", "lang": F.col("lang") == "en", "source": F.col("source").isNotNull(), "long": F.col("n_chars") >= 500}
    sums = t(spark, sf_dir, "documents").agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in checks.items()))
    rows = sums.unpivot("total", list(checks), "field", "filled")
    return rows.select("field", "filled", "total", F.floor(F.col("filled") * 100 / F.col("total") + 0.5).alias("percent"))


@query("""select r as rating, coalesce(n, 0)::bigint as count, floor(coalesce(n, 0) * 1000.0 / (select count(*) from part) + 0.5) / 10 as percent from (select unnest([5,4,3,2,1]) as r)
left join (select p_size % 5 + 1 as k, count(*) n from part where p_retailprice >= 910 group by 1) on r = k""")
def e25_rating_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    counts = p.where("p_retailprice >= 910").groupBy((F.col("p_size") % 5 + 1).alias("rating")).count()
    every, total = spark.range(1).select(F.explode(F.sequence(F.lit(5), F.lit(1), F.lit(-1))).alias("rating")), p.agg(F.count("*").alias("total"))
    return every.join(counts, "rating", "left").join(total).select("rating", F.coalesce("count", F.lit(0)).alias("count"), half_up(F.coalesce("count", F.lit(0)) * 100 / F.col("total"), 1).alias("percent"))


@query("select c_mktsegment as scraper, count(*) as brands, max(c_acctbal) as best, cast(sum(cast(c_acctbal as decimal(12,2))) as double) as total from customer group by 1")
def e26_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("scraper")).agg(F.count("*").alias("brands"), F.max("c_acctbal").alias("best"), F.sum(money("c_acctbal")).cast("double").alias("total"))


def running_average(*parts: DataFrame) -> DataFrame:
    """Merge of partial averages (key, n, total): associative, so any grouping of parts gives the same."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("select event_type as key, count(*) as n, floor(cast(sum(cast(value as decimal(18,6))) as double) / count(*) * 10000 + 0.5) / 10000 as average from events group by 1")
def e27_running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "ts", money("value", "decimal(18,6)").alias("v"))
    part = lambda d: d.groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    cut = F.lit("2024-01-15").cast("timestamp")
    merged = running_average(part(e.where(F.col("ts") < cut)), part(e.where(F.col("ts") >= cut)))
    return merged.select("key", "n", half_up(F.col("total").cast("double") / F.col("n"), 4).alias("average"))


@query("""with g as (select s_nationkey as k, count(*) n from supplier group by 1) select count(*) as groups, floor(avg(n) * 100 + 0.5) / 100 as avg_size, min(n) as min_size, max(n) as max_size, count(*) filter (where n = 1) as single from g""")
def e32_group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), half_up(F.avg("n")).alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.count_if(F.col("n") == 1).alias("single"))


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """The value most rows of a group have; null where the two most frequent tie."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).count()
    best = c.groupBy(group).agg(F.max("count").alias("most"))
    return c.join(best, group).where(F.col("count") == F.col("most")).groupBy(group).agg(F.when(F.count("*") == 1, F.min(value)).alias("dominant"))


@query("""with c as (select p_brand, p_size, count(*) n from part group by 1, 2), m as (select p_brand, max(n) mx from c group by 1)
select c.p_brand, case when count(*) = 1 then min(p_size) end as dominant from c join m on c.p_brand = m.p_brand and n = mx group by 1""")
def e33_dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant(t(spark, sf_dir, "part"), "p_brand", "p_size")


@query("select p_brand, median(p_retailprice) as median_price from part group by 1")
def e34_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medians(t(spark, sf_dir, "part"), "p_brand", "p_retailprice").withColumnRenamed("median", "median_price")


@query("select event_type, count(*) as count, floor(count(*) * 1000.0 / (select count(*) from events) + 0.5) / 10 as percent, count(*) * 10 > (select count(*) from events) as critical from events group by 1")
def e35_type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "events").groupBy("event_type").count()
    total = F.sum("count").over(Window.partitionBy())  # over a row for each type
    return c.withColumn("percent", half_up(F.col("count") * 100 / total, 1)).withColumn("critical", F.col("count") * 10 > total)


@query("""select 'type' as histogram, event_type as key, count(*) as count from events group by 2 union all select 'hour', cast(hour(ts) as varchar), count(*) from events group by 2
union all select 'site', cast(user_id % 7 as varchar), count(*) from events group by 2 union all select 'size', case when value < 10 then 'small' when value < 100 then 'medium' else 'large' end, count(*) from events group by 2""")
def e36_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("value") < 10, "small").when(F.col("value") < 100, "medium").otherwise("large")
    keys = F.array(*(F.struct(F.lit(n).alias("histogram"), k.alias("key")) for n, k in (("type", F.col("event_type")), ("hour", F.hour("ts").cast("string")), ("site", (F.col("user_id") % 7).cast("string")), ("size", size))))
    return t(spark, sf_dir, "events").select(F.inline(keys)).groupBy("histogram", "key").count()


@query("""select cast(user_id % 11 as bigint) as site, count(*) as failures, floor(avg(cast(json_extract_string(props, '$.k') as double)) * 100 + 0.5) / 100 as avg_retries, max_by(event_id, (value, event_id)) as worst from events where event_type = 'error' group by 1""")
def e38_failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy((F.col("user_id") % 11).alias("site")).agg(F.count("*").alias("failures"), half_up(F.avg(F.get_json_object("props", "$.k").cast("double"))).alias("avg_retries"), F.max_by("event_id", F.struct("value", "event_id")).alias("worst"))


@query("""with e as (select *, user_id % 11 as site, hour(ts) as h from events where event_type = 'error'), ok as (select user_id, max(ts) as last from events where event_type <> 'error' group by 1)
select count(*) as failures, floor(avg(cast(json_extract_string(props, '$.k') as double)) * 100 + 0.5) / 100 as avg_retries, floor(count(*) filter (where last > ts) * 10000.0 / count(*) + 0.5) / 10000 as recovery_rate,
(select h from e group by 1 order by count(*) desc, h limit 1)::int as peak_hour, (select site from e group by 1 order by count(*) desc, site limit 1)::bigint as worst_site from e left join ok using (user_id)""")
def e38_failure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failures in one row: retries, the share that the same user got over later, and the hour and site with most of them (ties to the smaller)."""
    all_of = t(spark, sf_dir, "events")
    ok = all_of.where("event_type <> 'error'").groupBy("user_id").agg(F.max("ts").alias("last"))
    e = all_of.where("event_type = 'error'").join(ok, "user_id", "left")
    # counts of each hour and site, never more rows than those
    c = e.groupBy(F.hour("ts").alias("h"), (F.col("user_id") % 11).alias("site")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("double")).alias("r"), F.count(F.get_json_object("props", "$.k").cast("double")).alias("rn"), F.count_if(F.col("last") > F.col("ts")).alias("over"))
    most = lambda key: c.groupBy(key).agg(F.sum("n").alias("n")).agg(F.min_by(key, F.struct(-F.col("n"), F.col(key))))
    total = c.agg(F.sum("n").alias("failures"), half_up(F.sum("r") / F.sum("rn")).alias("avg_retries"), half_up(F.sum("over") / F.sum("n"), 4).alias("recovery_rate"))
    return total.crossJoin(most("h").toDF("peak_hour")).crossJoin(most("site").toDF("worst_site"))  # one row each


@query("""select user_id, count(*) as attempts, floor(count(*) filter (where event_type <> 'error') * 10000.0 / count(*) + 0.5) / 10000 as rate, min(value) as fastest, max(value) as slowest,
count(*) filter (where ts >= timestamp '2024-01-23') as recent from events group by 1""")
def e39_selector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("attempts"), half_up(F.count_if(F.col("event_type") != "error") / F.count("*"), 4).alias("rate"), F.min("value").alias("fastest"), F.max("value").alias("slowest"),
        F.count_if(F.col("ts") >= F.lit("2024-01-23").cast("timestamp")).alias("recent"),
    )


@query("""with s as (select user_id % 10 as site, user_id, count(*) filter (where event_type <> 'error') * 1.0 / count(*) as rate from events group by 1, 2)
select cast(site as bigint) as site, count(*) filter (where rate >= 0.9) as healthy, count(*) filter (where rate >= 0.7 and rate < 0.9) as degraded, count(*) filter (where rate < 0.7) as broken from s group by 1""")
def e40_site_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("site"), "user_id").agg((F.count_if(F.col("event_type") != "error") / F.count("*")).alias("rate"))
    r = F.col("rate")
    return s.groupBy("site").agg(F.count_if(r >= 0.9).alias("healthy"), F.count_if((r >= 0.7) & (r < 0.9)).alias("degraded"), F.count_if(r < 0.7).alias("broken"))


@query("select p_brand, string_agg(p_type, '|' order by p_type) as types from (select distinct p_brand, p_type from part) group by 1")
def e47_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("types"))


@query("""select event_type, list_sort(list(value))[1 + cast(floor((count(*) - 1) * 0.95) as bigint)] as p95_floor, case when count(*) >= 20 then list_sort(list(value))[1 + cast(floor(count(*) * 0.95) as bigint)] end as p95_index from events group by 1""")
def e48_floor_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at floor((n - 1) * 0.95) and, from 20 rows, at floor(n * 0.95) of each group, by rank: no group is collected."""
    r = ranked_globally(t(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")
    types = r.groupBy("event_type").agg(F.count("*").alias("n"), F.min("__rank").alias("first"))  # a row for each type
    r = r.join(types, "event_type").withColumn("r", F.col("__rank") - F.col("first"))
    return r.groupBy("event_type").agg(F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * 0.95), F.col("value"))).alias("p95_floor"), F.max(F.when((F.col("n") >= 20) & (F.col("r") == F.floor(F.col("n") * 0.95)), F.col("value"))).alias("p95_index"))


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as r, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, value as p95 from r where n >= 20 and r = cast(floor(n * 0.95) as bigint)""")
def e49_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at place floor(0.95 n) of each type's sorted values, from 20 values on; no task holds a whole type."""
    ranked = ranked_within(t(spark, sf_dir, "events").where("value is not null").select("event_type", "value", "event_id"), "event_type", "value", "event_id")
    n = ranked.groupBy("event_type").agg(F.count("*").alias("n")).where("n >= 20")
    return ranked.join(n, "event_type").where(F.col("__rank") == F.floor(F.col("n") * 0.95)).select("event_type", F.col("value").alias("p95"))


@query("select p_brand, floor(avg(p_retailprice) * 10000 + 0.5) / 10000 as mean, min(p_retailprice) as least, max(p_retailprice) as most, median(p_retailprice) as median, floor(stddev_samp(p_retailprice) * 10000 + 0.5) / 10000 as stdev from part group by 1")
def e50_benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice")
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(half_up(F.avg(p), 4).alias("mean"), F.min(p).alias("least"), F.max(p).alias("most"), half_up(F.stddev_samp(p), 4).alias("stdev")).join(medians(t(spark, sf_dir, "part"), "p_brand", "p_retailprice"), "p_brand")


@query("""select b as bucket, coalesce(n, 0)::bigint as count from (values ('0-20'),('20-40'),('40-60'),('60-80'),('80-100')) v(b) left join (
select case when q < 20 then '0-20' when q < 40 then '20-40' when q < 60 then '40-60' when q < 80 then '60-80' else '80-100' end as k, count(*) n from (select least(100, n_chars // 20) q from documents) group by 1) on b = k""")
def e53_quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.least(F.lit(100), F.floor(F.col("n_chars") / 20))
    own = F.when(q < 20, "0-20").when(q < 40, "20-40").when(q < 60, "40-60").when(q < 80, "60-80").otherwise("80-100")
    return zero_filled(t(spark, sf_dir, "documents").groupBy(own.alias("bucket")).count(), "bucket", ("0-20", "20-40", "40-60", "60-80", "80-100"))


@query("""select coalesce(nullif(l_returnflag, 'N'), 'standard') as batch, cast(sum(l_quantity) as bigint) as total, count(*) as lines, sum(l_quantity) >= 1000 as reached from lineitem group by 1""")
def e56_cart_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy(F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit("standard")).alias("batch")).agg(F.sum("l_quantity").cast("long").alias("total"), F.count("*").alias("lines"), (F.sum("l_quantity") >= 1000).alias("reached"))


@query("""with d as (select unnest(generate_series(timestamp '2024-01-14', timestamp '2024-02-02', interval 1 day)) as day) select strftime(day, '%Y-%m-%d') as day, count(event_id) as processed, count(event_id) filter (where event_type = 'error') as failed
from d left join events on date_trunc('day', ts) = day group by 1""")
def o18_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.expr("sequence(date'2024-01-14', date'2024-02-02')")).alias("d"))
    e = t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("processed"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return days.join(e, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("processed", F.lit(0)).alias("processed"), F.coalesce("failed", F.lit(0)).alias("failed"))
