"""Validation, acceptance and export rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x
from .registry import half_up, query, t


@query("select p_partkey, coalesce(nullif(p_brand, 'Brand#11'), 'unbranded') as brand, coalesce(case when p_size > 10 then p_size end, 0) as quantity from part")
def b20_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("brand"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("quantity"))
    return p.na.fill({"brand": "unbranded", "quantity": 0})


@query("""with s as (select p_partkey as sku, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') as base, p_name from part), r as (select *, row_number() over (partition by base order by p_name, sku) as k from s)
select sku, case when k = 1 then base else base || '-' || cast(sku as varchar) end as stem from r""")
def b22_file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stem for each row: the name's slug for its first row, with the sku for later ones, which are unique by the sku."""
    s = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), x.slug("p_name").alias("base"), "p_name")
    k = F.row_number().over(Window.partitionBy("base").orderBy("p_name", "sku"))
    return s.select("sku", F.when(k == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("sku").cast("string"))).alias("stem"))


@query("""select o_orderkey from orders where o_orderstatus in ('O', 'F') and o_orderdate >= timestamp '1995-06-01' and o_orderdate < timestamp '1996-06-01' and o_totalprice between 50000 and 250000 and (cast(o_custkey as varchar) like '%7%' or lower(o_orderpriority) like '%urgent%')""")
def c03_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    o = o.where(F.col("o_orderstatus").isin("O", "F") & (F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp")) & F.col("o_totalprice").between(50000, 250000))
    return o.where(F.contains(F.col("o_custkey").cast("string"), F.lit("7")) | F.contains(F.lower("o_orderpriority"), F.lit("urgent"))).select("o_orderkey")


@query("select p_partkey from part where list_contains(string_split(p_name, ' '), string_split(lower(p_type), ' ')[1]) or list_contains(string_split(p_name, ' '), 'small')")
def c06_array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return t(spark, sf_dir, "part").where(F.array_contains(words, F.split(F.lower("p_type"), " ")[0]) | F.array_contains(words, "small")).select("p_partkey")


@query("select o_orderkey, floor(case o_orderpriority when '1-URGENT' then least(o_totalprice * 0.2, 5000) when '2-HIGH' then least(1000, o_totalprice) when '3-MEDIUM' then 0 else o_totalprice * 0.05 end * 100 + 0.5) / 100 as discount, o_orderpriority = '3-MEDIUM' as free_shipping from orders")
def c15_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, kind = F.col("o_totalprice"), F.col("o_orderpriority")
    d = F.when(kind == "1-URGENT", F.least(p * 0.2, F.lit(5000.0))).when(kind == "2-HIGH", F.least(F.lit(1000.0), p)).when(kind == "3-MEDIUM", 0.0).otherwise(p * 0.05)
    return t(spark, sf_dir, "orders").select("o_orderkey", half_up(d).alias("discount"), (kind == "3-MEDIUM").alias("free_shipping"))


@query("""select event_id, list_filter([case when json_extract(props, '$.k') is null then 'k is missing' end, case when event_type not in ('click', 'view', 'signup', 'purchase') then 'type is unknown' end, case when value < 0 then 'value is negative' end], lambda v: v is not null) as errors, json_extract(props, '$.k') is not null and event_type in ('click', 'view', 'signup', 'purchase') and not coalesce(value < 0, false) as valid from events""")
def c17_config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (
        (F.get_json_object("props", "$.k").isNull(), "k is missing"), (~F.col("event_type").isin("click", "view", "signup", "purchase"), "type is unknown"), (F.col("value") < 0, "value is negative"),
    )
    e = t(spark, sf_dir, "events").select("event_id", F.array_compact(F.array(*(F.when(bad, said) for bad, said in rules))).alias("errors"))
    return e.withColumn("valid", F.size("errors") == 0)


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k, json_extract(props, '$.k') is not null as accepted from events")
def c18_payload_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads by a wire schema; those that do not fit keep their row and are marked."""
    parsed = F.from_json("props", "k int", {"mode": "PERMISSIVE"})
    return t(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["k"].isNotNull().alias("accepted"))


@query("""select p_partkey, case when p_size = 1 then 'failed' when p_name not like '% %' then 'name' when p_retailprice < 950 then 'confidence' when not contains(lower(p_type), lower(string_split(p_type, ' ')[1])) then 'brand' else 'accepted' end as reason from part""")
def c20_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a row fails, in order."""
    first = F.lower(F.split("p_type", " ")[0])
    reason = F.when(F.col("p_size") == 1, "failed").when(~F.contains("p_name", F.lit(" ")), "name").when(F.col("p_retailprice") < 950, "confidence").when(~F.contains(F.lower("p_type"), first), "brand").otherwise("accepted")
    return t(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"))


@query("select 'orphan' as problem, cast(p_partkey as varchar) as what from part where p_partkey not in (select l_partkey from lineitem) union all select 'unresolved', n_name from nation where n_nationkey not in (select c_nationkey from customer)")
def c22_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lone = t(spark, sf_dir, "part").join(t(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.lit("orphan").alias("problem"), F.col("p_partkey").cast("string").alias("what"))
    empty = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select(F.lit("unresolved").alias("problem"), F.col("n_name").alias("what"))
    return lone.unionByName(empty)


@query("""select o_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') as arrival from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'O' and l_shipdate >= timestamp '1998-06-01'""")
def c23_future_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp"))
    return t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(l, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("arrival"))


@query("""with q as (select o_custkey as job_id, o_orderkey as chunk_id, o_orderdate as created_at, o_orderstatus as s, o_orderpriority as p from orders) select chunk_id from q where s = 'O' and p <> '5-LOW' order by created_at, chunk_id limit 1""")
def o06_job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest eligible job; the claim itself is the scheduler's work."""
    return t(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority <> '5-LOW'").orderBy("o_orderdate", "o_orderkey").limit(1).select(F.col("o_orderkey").alias("chunk_id"))


@query("""select user_id % 13 as site, floor((0.7 * count(*) filter (where event_type <> 'error') / count(*) + 0.3 * least(1, count(*) / 50.0)) * 10000 + 0.5) / 10000 as health from events group by 1""")
def o15_site_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = 0.7 * F.count_if(F.col("event_type") != "error") / F.count("*") + 0.3 * F.least(F.lit(1.0), F.count("*") / 50)
    return t(spark, sf_dir, "events").groupBy((F.col("user_id") % 13).alias("site")).agg(half_up(h, 4).alias("health"))


@query("""select event_type as status, event_id from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 7""")
def o17_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.events import recent

    return recent(t(spark, sf_dir, "events"), "event_type", 7).select(F.col("event_type").alias("status"), "event_id")


@query("""with p as (select user_id, cast(user_id % 2 as int) as arm, max(value) as v from events group by 1), s as (select arm, count(*) n, count(*) filter (where v % 1 > 0.5) k from p group by 1), w as (select max(n) filter (where arm = 0) n0, max(k) filter (where arm = 0) k0, max(n) filter (where arm = 1) n1, max(k) filter (where arm = 1) k1 from s)
select floor((k1 * 1.0 / n1 - k0 * 1.0 / n0) / sqrt((k0 + k1) * 1.0 / (n0 + n1) * (1 - (k0 + k1) * 1.0 / (n0 + n1)) * (1.0 / n0 + 1.0 / n1)) * 10000 + 0.5) / 10000 as z from w""")
def r20_two_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("v")).withColumn("arm", F.col("user_id") % 2)
    n = lambda a: F.count_if(F.col("arm") == a)
    k = lambda a: F.count_if((F.col("arm") == a) & (F.col("v") % 1 > 0.5))
    w = p.agg(n(0).alias("n0"), n(1).alias("n1"), k(0).alias("k0"), k(1).alias("k1"))
    both = F.try_divide(F.col("k0") + F.col("k1"), F.col("n0") + F.col("n1"))
    rate = lambda a: F.try_divide(F.col(f"k{a}"), F.col(f"n{a}"))
    spread = F.sqrt(both * (1 - both) * (F.try_divide(F.lit(1), F.col("n0")) + F.try_divide(F.lit(1), F.col("n1"))))
    return w.select(half_up(F.try_divide(rate(1) - rate(0), spread), 4).alias("z"))
