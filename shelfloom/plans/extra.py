"""Further catalog operators over the driver's tables: fallbacks, feeds of usage, text classes, costs, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import tables as op
from .registry import half_up, money, query, t


@query("select n_regionkey as grp, n_name, row_number() over (partition by n_regionkey order by n_name) as position from nation")
def d03_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp"), "n_name", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).cast("long").alias("position"))


@query("""with s as (select p_type as line, list_sort(list(distinct p_brand)) as siblings, count(*) as n from part group by 1) select p_partkey, list_filter(siblings, lambda b: b <> p_brand) as other_brands, n from part join s on line = p_type""")
def d20_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    s = p.groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("siblings"), F.count("*").alias("n"))
    return p.join(s, "p_type").select("p_partkey", F.array_remove("siblings", F.col("p_brand")).alias("other_brands"), "n")


@query("select user_id as run, floor(count(*) filter (where event_type <> 'error') * 100.0 / count(*) * 100 + 0.5) / 100 as health from events group by 1")
def e15_selector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(half_up(F.count_if(F.col("event_type") != "error") * 100 / F.count("*")).alias("health"))


@query("select user_id % 5 as site, count(*) filter (where event_type = 'view') as found, count(*) filter (where event_type = 'error') as missed, strftime(max(case when event_type = 'error' then ts end), '%Y-%m-%d') as last_missed from events group by 1")
def e17_selector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return t(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("site")).agg(kind("view").alias("found"), kind("error").alias("missed"), F.date_format(F.max(F.when(F.col("event_type") == "error", F.col("ts"))), "yyyy-MM-dd").alias("last_missed"))


@query("select user_id, cast(sum(coalesce(try_cast(json_extract_string(props, '$.cost') as decimal(12,2)), try_cast(json_extract_string(props, '$.k') as decimal(12,2)), 0)) as double) as cost from events group by 1")
def e21_job_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda p: F.get_json_object("props", p).try_cast("decimal(12,2)")
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.coalesce(path("$.cost"), path("$.k"), F.lit(0).cast("decimal(12,2)"))).cast("double").alias("cost"))


@query("select event_type as mode, count(*) as jobs, cast(sum(cast(value as decimal(18,6))) as double) as cost, count(*) filter (where value is null) as errors from events group by 1")
def e22_strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("jobs"), F.sum(money("value", "decimal(18,6)")).cast("double").alias("cost"), F.count_if(F.col("value").isNull()).alias("errors"))


@query("select l_suppkey as scraper, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as total, min(l_extendedprice) as least, max(l_extendedprice) as most, floor(cast(sum(cast(l_extendedprice as decimal(12,2))) as double) / count(*) * 100 + 0.5) / 100 as average from lineitem group by 1")
def e42_cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(money("l_extendedprice")).cast("double")
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scraper")).agg(total.alias("total"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), half_up(total / F.count("*")).alias("average"))


@query("""with s as (select l_orderkey as job, count(*) as total, count(*) filter (where l_returnflag = 'N') as passed, count(*) filter (where l_returnflag = 'A') as partial, count(*) filter (where l_returnflag = 'R') as failed from lineitem group by 1)
select *, case when failed = total then 'failed' when passed = total then 'passed' else 'partial' end as status from s""")
def e54_test_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("l_returnflag") == k)
    s = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("total"), kind("N").alias("passed"), kind("A").alias("partial"), kind("R").alias("failed"))
    return s.withColumn("status", F.when(F.col("failed") == F.col("total"), "failed").when(F.col("passed") == F.col("total"), "passed").otherwise("partial"))


@query("""select * from (select * from (select 'order' as feed, o_orderkey as id, o_totalprice as amount from orders order by o_totalprice desc, o_orderkey limit 12) union all select * from (select 'line', l_orderkey * 10 + l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, 2 limit 12) union all select * from (select 'event', event_id, value from events order by value desc, event_id limit 12)) order by amount desc, feed, id limit 12""")
def g08_recent_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three feeds, each cut to its top before they meet."""
    feed = lambda name, n, k, v: t(spark, sf_dir, n).select(F.lit(name).alias("feed"), k.alias("id"), F.col(v).alias("amount")).orderBy(F.desc("amount"), "id").limit(12)
    u = feed("order", "orders", F.col("o_orderkey"), "o_totalprice").unionByName(feed("line", "lineitem", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_extendedprice")).unionByName(feed("event", "events", F.col("event_id"), "value"))
    return u.orderBy(F.desc("amount"), "feed", "id").limit(12)


@query("select p_partkey, case when contains(lower(p_name), 'red') or contains(lower(p_name), 'blue') then 'colour' when contains(lower(p_name), 'small') or contains(lower(p_name), 'large') then 'size' else 'none' end as signal from part")
def i36_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lower("p_name")
    return t(spark, sf_dir, "part").select("p_partkey", F.when(n.rlike("red|blue"), "colour").when(n.rlike("small|large"), "size").otherwise("none").alias("signal"))


@query("""with p as (select unnest(['click','view','error']) as model, unnest([0.5, 0.25, 2.0]) as price) select event_id, floor(coalesce(price, 0) * value * 10000 + 0.5) / 10000 as cost from events left join p on event_type = model""")
def i39_cost_from_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed price list of three models; models that it lacks cost nothing."""
    price = F.create_map(*map(F.lit, ("click", 0.5, "view", 0.25, "error", 2.0)))
    return t(spark, sf_dir, "events").select("event_id", half_up(F.coalesce(F.try_element_at(price, F.col("event_type")), F.lit(0.0)) * F.col("value"), 4).alias("cost"))


@query("select event_id, case when event_type = 'error' then least(300.0, 2.0 * power(2, coalesce(cast(json_extract_string(props, '$.k') as int), 0) % 10)) when event_type = 'click' then 5.0 else 0.0 end::double as delay from events")
def i40_retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)) % 10
    return t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", F.least(F.lit(300.0), 2.0 * F.pow(F.lit(2), k))).when(F.col("event_type") == "click", 5.0).otherwise(0.0).alias("delay"))


@query("select p_partkey, [p_name, p_brand || ' ' || p_name, p_name || ' -site:example.com', 'site:example.org ' || p_name] as variants from part")
def i41_query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.array(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name"), F.concat("p_name", F.lit(" -site:example.com")), F.concat(F.lit("site:example.org "), F.col("p_name")))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_distinct(v).alias("variants"))


@query("""with v as (select p_partkey, row_number() over (partition by lower(p_brand) order by p_partkey) as r, p_brand from part) select lower(p_brand) as option from v where r = 1""")
def i20_option_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_by(t(spark, sf_dir, "part"), ["p_brand"], "p_partkey").select(F.lower("p_brand").alias("option")).distinct()


@query("""select p_partkey, coalesce(case when p_brand = 'Brand#11' and p_size > 25 then 'A' when p_brand = 'Brand#11' then 'B' end, case when p_size > 40 then 'C' end, 'other') as category from part""")
def i22_category_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rules before wildcard ones."""
    exact = F.when((F.col("p_brand") == "Brand#11") & (F.col("p_size") > 25), "A").when(F.col("p_brand") == "Brand#11", "B")
    return t(spark, sf_dir, "part").select("p_partkey", F.coalesce(exact, F.when(F.col("p_size") > 40, "C"), F.lit("other")).alias("category"))


@query("select event_id, coalesce(nullif(regexp_extract(event_type || ' UPC ' || lpad(cast(event_id as varchar), 12, '0') || ' end', '(?:UPC|GTIN)[^0-9]*([0-9]{12,14})', 1), ''), 'none') as upc from events")
def i26_upc_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat("event_type", F.lit(" UPC "), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(" end"))
    return t(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif(F.regexp_extract(noisy, "(?:UPC|GTIN)[^0-9]*([0-9]{12,14})", 1), F.lit("")), F.lit("none")).alias("upc"))


@query("select doc_id, case when lower(text) like '%password%' or lower(text) like '%token%' then 'secret' when regexp_matches(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') then 'network' when text is null or text = '' then 'empty' else 'unknown' end as failure from documents")
def i32_failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.lower("text")
    k = F.when(v.contains("password") | v.contains("token"), "secret").when(F.col("text").rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), "network").when(F.col("text").isNull() | (F.col("text") == ""), "empty").otherwise("unknown")
    return t(spark, sf_dir, "documents").select("doc_id", k.alias("failure"))


@query("""with g as (select string_split(p_type, ' ')[1] as grp, p_size % 3 as k, min(string_split(p_type, ' ')) as a, max(string_split(p_type, ' ')) as b from part group by 1, 2)
select grp, k, array_to_string(a[1:coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])), 0)], ' ') as prefix from g""")
def i29_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that all names of a group begin with: those of its least and greatest name, so no group is collected."""
    w = F.split("p_type", " ")
    g = t(spark, sf_dir, "part").groupBy(w[0].alias("grp"), (F.col("p_size") % 3).alias("k")).agg(F.min(w).alias("a"), F.max(w).alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    return g.select("grp", "k", F.array_join(F.slice("a", F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), " ").alias("prefix"))


@query("""select conv_id, list(role order by turn) as roles, count(*) as turns from conversations group by 1""")
def g09_ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"), F.count("*").alias("turns"))
    return c.select("conv_id", F.transform("x", lambda v: v["role"]).alias("roles"), "turns")


@query("select c_custkey as key, c_custkey % 10 = 3 or c_acctbal < 0 as refresh from customer")
def o11_refresh_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to fetch again: stale ones and a fixed tenth of the rest, drawn by key instead of at random."""
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), ((F.col("c_custkey") % 10 == 3) | (F.col("c_acctbal") < 0)).alias("refresh"))


@query("""with d as (select p_brand, p_size, count(*) as n, max(count(*)) over (partition by p_brand) as most from part group by 1, 2), w as (select p_brand, case when count(*) = 1 then min(p_size) end as size from d where n = most group by 1)
select p.p_partkey, w.size as dominant from part p join w on p.p_brand = w.p_brand where w.size is not null and p.p_size <> w.size""")
def p06_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ from their group's dominant value."""
    from .sales import dominant

    p = t(spark, sf_dir, "part")
    return p.join(dominant(p, "p_brand", "p_size"), "p_brand").where(F.col("dominant").isNotNull() & (F.col("p_size") != F.col("dominant"))).select("p_partkey", "dominant")


@query("select s_suppkey, regexp_replace(lower(regexp_replace('unitPrice' || cast(s_suppkey as varchar) || ' Max-Value', '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[ -]+', '_', 'g') as field from supplier")
def i23_snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "supplier").select("s_suppkey", x.snake(F.concat(F.lit("unitPrice"), F.col("s_suppkey").cast("string"), F.lit(" Max-Value"))).alias("field"))
