"""Evaluation of extraction and ranking: comparisons, rates, intervals, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import statistics as st
from .registry import half_up, query, t


@query("""with a as (select p_partkey, w, count(*) n from (select p_partkey, unnest(string_split(lower(p_name), ' ')) w from part) group by 1, 2), b as (select p_partkey, w, count(*) n from (select p_partkey, unnest(string_split(lower(p_type), ' ')) w from part) group by 1, 2),
o as (select p_partkey, sum(least(a.n, b.n)) c from a join b using (p_partkey, w) group by 1)
select p_partkey, floor(2.0 * coalesce(c, 0) / (len(string_split(p_name, ' ')) + len(string_split(p_type, ' '))) * 10000 + 0.5) / 10000 as dice from part left join o using (p_partkey)""")
def r01_token_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset overlap inside each row, without exploding it."""
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    times = lambda words, w: F.size(F.filter(words, lambda v: v == w))
    overlap = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(times(a, w), times(b, w)))
    return t(spark, sf_dir, "part").select("p_partkey", half_up(2.0 * overlap / (F.size(a) + F.size(b)), 4).alias("dice"))


@query("select p_partkey, floor(len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), list_distinct(string_split(lower(p_type), ' ')))) * 1.0 / len(list_distinct(list_concat(string_split(lower(p_name), ' '), string_split(lower(p_type), ' ')))) * 10000 + 0.5) / 10000 as jaccard from part")
def r02_set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return t(spark, sf_dir, "part").select("p_partkey", half_up(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 4).alias("jaccard"))


@query("""select l_orderkey % 50 as sku, count(*) as n, floor(avg(case when l_linenumber = 1 then 1.0 else 0 end) * 10000 + 0.5) / 10000 as p_at_1, floor(avg(1.0 / l_linenumber) * 10000 + 0.5) / 10000 as mrr from lineitem group by 1""")
def r06_ranking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("sku")).agg(F.count("*").alias("n"), half_up(F.avg((F.col("l_linenumber") == 1).cast("double")), 4).alias("p_at_1"), half_up(F.avg(1 / F.col("l_linenumber")), 4).alias("mrr"))


@query("""with g as (select o_orderpriority as category, count(*) n, count(*) filter (where o_orderstatus = 'F') k from orders group by 1), i as (select *, k * 1.0 / n as p, 1.959963984540054 * sqrt(k * 1.0 / n * (1 - k * 1.0 / n) * n / (n - 1) / n) as h from g)
select category, n, floor(p * 10000 + 0.5) / 10000 as accuracy, floor(greatest(0, p - h) * 10000 + 0.5) / 10000 as low, floor(least(1, p + h) * 10000 + 0.5) / 10000 as high from i""")
def r08_normal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = st.normal_interval(F.col("k"), F.col("n"))
    return g.select("category", "n", half_up(F.col("k") / F.col("n"), 4).alias("accuracy"), half_up(low, 4).alias("low"), half_up(high, 4).alias("high"))


@query("""with g as (select event_type, count(*) n, count(*) filter (where value > 50) k from events group by 1), z as (select *, 1.959963984540054 as z, k * 1.0 / n as p from g)
select event_type, floor(((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n)) / (1 + z*z/n)) * 10000 + 0.5) / 10000 as low, floor(((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n)) / (1 + z*z/n)) * 10000 + 0.5) / 10000 as high from z""")
def r21_wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    low, high = st.wilson_interval(F.col("k"), F.col("n"))
    return g.select("event_type", half_up(low, 4).alias("low"), half_up(high, 4).alias("high"))


@query("""with p as (select p_brand, p_retailprice - (900 + p_size * 10) as d from part), s as (select p_brand, count(*) n, avg(d) m, stddev_samp(d) sd from p group by 1) select p_brand, n, floor(m * 1000 + 0.5) / 1000 as mean_diff, floor(m / (sd / sqrt(n)) * 1000 + 0.5) / 1000 as t, floor(m / sd * 1000 + 0.5) / 1000 as d from s""")
def r11_paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select("p_brand", (900 + F.col("p_size") * 10).alias("a"), F.col("p_retailprice").alias("b"))
    s = st.paired_t(p, "a", "b", "p_brand")
    return s.select("p_brand", "n", *(half_up(F.col(c), 3).alias(c) for c in ("mean_diff", "t", "d")))


def t_between_sql(x: str, df: str, steps: int) -> str:
    """SQL: the chance that |t| stays below x, as twice the integral of Student's density by Simpson's rule."""
    return (
        f"(2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * {x} / (3.0 * {steps}) * list_sum(list_transform(range(0, {steps} + 1), lambda i: "
        f"(case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end) * power(1 + power({x} * i / {steps}.0, 2) / {df}, -({df} + 1) / 2.0))))"
    )


@query(f"""with d as (select p_brand, p_retailprice - (900 + p_size * 10) as d from part), s as (select p_brand, count(*) - 1.0::double as v, least(60, abs(avg(d) / (stddev_samp(d) / sqrt(count(*))))) as t from d group by 1)
select p_brand, floor((1 - {t_between_sql('t', 'v', 20000)}) * 1000000 + 0.5) / 1000000 as p_value from s""")
def r11_paired_t_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-sided tail of t, by the incomplete beta function."""
    p = t(spark, sf_dir, "part").select("p_brand", (900 + F.col("p_size") * 10).alias("a"), F.col("p_retailprice").alias("b"))
    s = st.paired_t(p, "a", "b", "p_brand")
    return s.select("p_brand", half_up(st.t_p_value("t", (F.col("n") - 1).cast("double")), 6).alias("p_value"))


@query("""with w as (select s_suppkey, s_acctbal, row_number() over (order by s_suppkey) r from supplier) select count(*) filter (where s_acctbal > 5000) as wins, count(*) filter (where s_acctbal < 5000) as losses, count(*) filter (where s_acctbal = 5000) as ties from w""")
def r16_win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("s_acctbal")
    return t(spark, sf_dir, "supplier").agg(F.count_if(b > 5000).alias("wins"), F.count_if(b < 5000).alias("losses"), F.count_if(b == 5000).alias("ties"))


@query("""with m as (select o_orderpriority as metric, cast(sum(case when year(o_orderdate) = 1995 then cast(o_totalprice as decimal(12,2)) end) as double) as old, cast(sum(case when year(o_orderdate) = 1996 then cast(o_totalprice as decimal(12,2)) end) as double) as new from orders group by 1)
select metric, case when -((new - old) / abs(old)) > 0.1 then 'regression' when -((new - old) / abs(old)) < -0.1 then 'improvement' else 'neutral' end as status from m""")
def r17_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = lambda y: F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice").cast("decimal(12,2)"))).cast("double")
    m = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(year(1995).alias("old"), year(1996).alias("new"))
    return m.select("metric", st.regression(F.col("metric"), F.col("old"), F.col("new")).alias("status"))


@query("""with w as (select cast(floor((epoch(date_trunc('day', ts)) - epoch(timestamp '2024-01-01')) / 604800) as bigint) as week, event_type as field, count(*) n from events group by 1, 2)
select coalesce(a.week, b.week + 1) as week, coalesce(a.field, b.field) as field, coalesce(a.n, 0) as current, coalesce(b.n, 0) as previous, coalesce(a.n, 0) - coalesce(b.n, 0) as change from w a full join w b on a.week = b.week + 1 and a.field = b.field""")
def r19_weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    w = t(spark, sf_dir, "events").groupBy(week.alias("week"), F.col("event_type").alias("field")).agg(F.count("*").alias("current"))
    b = w.select((F.col("week") + 1).alias("week"), "field", F.col("current").alias("previous"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return w.join(b, ["week", "field"], "full_outer").select("week", "field", zero("current").alias("current"), zero("previous").alias("previous"), (zero("current") - zero("previous")).alias("change"))


@query("""with b as (select event_type, count(*) * 1.0::double / (select count(*) from events) as p from events group by 1)
select event_type, cast(ceil(power(1.959963984540054 * sqrt(2 * (p + 0.025) * (1 - (p + 0.025))) + 0.8416212335729143 * sqrt(p * (1 - p) + (p + 0.05) * (1 - (p + 0.05))), 2) / power(0.05, 2)) as bigint) as n from b""")
def r22_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to watch in each arm to see five points more on the rate of each type."""
    c = t(spark, sf_dir, "events").groupBy("event_type").count()
    rate = F.col("count") / F.sum("count").over(Window.partitionBy())  # over a row for each type
    return c.withColumn("rate", rate).select("event_type", st.sample_size(F.col("rate"), F.lit(0.05)).alias("n"))


@query("select event_type, case when r <= 0.2 then 'pass' when r <= 0.22 then 'warn' else 'fail' end as status from (select event_type, count(*) * 1.0 / (select count(*) from events) as r from events group by 1)")
def r24_threshold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "events").groupBy("event_type").count()
    r = F.col("count") / F.sum("count").over(Window.partitionBy())  # over a row for each type
    return c.select("event_type", F.when(r <= 0.2, "pass").when(r <= 0.22, "warn").otherwise("fail").alias("status"))


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity = 50) order by md5(cast(p_partkey as varchar) || '-7'), p_partkey limit 100")
def r25_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn by a seeded hash, without what was drawn lately."""
    lately = t(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return t(spark, sf_dir, "part").select("p_partkey").join(lately, "p_partkey", "left_anti").orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-7"))), "p_partkey").limit(100)
