"""Stores, feeds and rules that stand beside the tables: append-only datasets, key-value tables, queues, fixtures, nested feeds, rule sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import tables as op
from ..session import fresh_dir
from .registry import half_up, query, t


@query("select event_id, event_type from events order by event_id limit 50 offset 20")
def a19_append_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items appended in two writes, and a page of them in the order of their keys."""
    path, e = fresh_dir(spark, "dataset"), t(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (e.where("event_type = 'view'"), e.where("event_type <> 'view'")):
        part.write.mode("append").json(path)
    return spark.read.schema("event_id long, event_type string").json(path).orderBy("event_id").offset(20).limit(50)


@query("select 'user-' || cast(user_id as varchar) as key, event_type as value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def a20_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key holds what was set last; setting is an upsert by key."""
    e = t(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("at"))
    last = lambda d: d.groupBy("key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    middle = F.lit("2024-01-15").cast("timestamp")
    return op.upsert(last(e.where(F.col("at.ts") < middle)), last(e.where(F.col("at.ts") >= middle)), ["key"]).select("key", "value")


@query("select event_id as request, row_number() over (order by case when event_type = 'click' then 1 else 0 end, ts, event_id) as place from events where event_type <> 'error'")
def a21_request_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue as of a moment: handled requests are gone, reclaimed ones stand at the tail, the rest in the order of arrival."""
    q = t(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", "ts", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("reclaimed"))
    return op.ranked_globally(q, "reclaimed", "ts", "event_id").select(F.col("event_id").alias("request"), (F.col("__rank") + 1).alias("place"))


@query("select p_partkey, left(sha256(lower(p_name)), 12) as fixture from part")
def a23_search_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results found by the hash of the normalised query: two spellings of a query meet."""
    key = lambda c: F.sha2(F.lower(x.collapsed(c)), 256)
    p = t(spark, sf_dir, "part")
    stored = p.select(key("p_name").alias("hash")).distinct()
    asked = p.select("p_partkey", key(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).alias("hash"))
    return asked.join(stored, "hash").select("p_partkey", F.left("hash", F.lit(12)).alias("fixture"))


@query("select cast(p_partkey as varchar) as sku, p_name as name, p_brand as brand, p_retailprice as price, p_retailprice as cost, 0 as quantity from part")
def a08_nested_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed JSON feed with nested attributes: price and cost are the first price break, quantity is not known."""
    path = fresh_dir(spark, "feed")
    breaks = F.array(F.struct(F.lit(1).alias("quantity"), F.col("p_retailprice").alias("price")), F.struct(F.lit(10).alias("quantity"), (F.col("p_retailprice") * 0.9).alias("price")))
    item = (F.col("p_partkey").cast("string").alias("ID"), F.col("p_name").alias("Name"), F.struct(F.struct(F.col("p_brand").alias("Brand")).alias("xp")).alias("Product"), breaks.alias("PriceBreaks"))
    t(spark, sf_dir, "part").select(*item).write.json(path)
    feed = spark.read.schema("ID string, Name string, Product struct<xp: struct<Brand: string>>, PriceBreaks array<struct<quantity: int, price: double>>").json(path)
    price = F.get("PriceBreaks", F.lit(0))["price"]
    return feed.select(F.col("ID").alias("sku"), F.col("Name").alias("name"), F.col("Product.xp.Brand").alias("brand"), price.alias("price"), price.alias("cost"), F.lit(0).alias("quantity"))


@query("select l_partkey as sku, count(distinct l_suppkey) as scrapers, count(*) as results, max(l_shipdate) as last_seen from lineitem group by 1")
def b15_session_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(F.count_distinct("l_suppkey").alias("scrapers"), F.count("*").alias("results"), F.max("l_shipdate").alias("last_seen"))


@query("select p_partkey, case when p_size % 2 = 0 then left(lpad(cast(p_partkey * 7919 as varchar), 12, '0'), 6) else lower(p_brand) || ' ' || array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: not regexp_matches(w, '[0-9]'))[1:4], ' ') end as cohort from part")
def m21_cohort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code's prefix, or without a code the brand and the first four words of the name that hold no number, in their order."""
    code = F.when(F.col("p_size") % 2 == 0, F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0"))
    words = F.slice(F.filter(F.split(F.lower("p_name"), " "), lambda w: ~w.rlike("[0-9]")), 1, 4)
    return t(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.left(code, F.lit(6)), F.concat_ws(" ", F.lower("p_brand"), F.array_join(words, " "))).alias("cohort"))


@query("""with s as (select p_partkey, p_type as a, p_name as b from part), c as (select p_partkey, unnest([a, b]) as snippet, unnest([1, 2]) as i from s), w as (select p_partkey, snippet, i, list_distinct(string_split(lower(snippet), ' ')) as w from c)
select p_partkey, snippet, len(list_intersect(w, ['steel', 'large', 'green'])) * 10 + least(len(w), 8) as score from w qualify row_number() over (partition by p_partkey order by len(list_intersect(w, ['steel', 'large', 'green'])) * 10 + least(len(w), 8) desc, i) = 1""")
def m23_best_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first best of a row's snippets by shared words and length."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    wanted = F.array(F.lit("steel"), F.lit("large"), F.lit("green"))
    one = lambda c, i: F.struct((F.size(F.array_intersect(words(c), wanted)) * 10 + F.least(F.size(words(c)), F.lit(8))).alias("score"), F.lit(-i).alias("k"), F.col(c).alias("snippet"))
    return t(spark, sf_dir, "part").select("p_partkey", F.greatest(one("p_type", 1), one("p_name", 2)).alias("b")).select("p_partkey", "b.snippet", "b.score")


#: Consistency rules: a name, and a condition that a row breaks.
RULES = {"size_range": "p_size < 3 or p_size > 48", "price_range": "p_retailprice > 1800", "brand_form": "not p_brand like 'Brand#%'"}


@query("""select p_partkey, 'size_range' as rule from part where p_size < 3 or p_size > 48 union all select p_partkey, 'price_range' from part where p_retailprice > 1800 union all select p_partkey, 'brand_form' from part where not p_brand like 'Brand#%'""")
def p05_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations of a table of rules, in one pass over the rows."""
    broken = F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(name)) for name, cond in RULES.items())))
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(broken).alias("rule"))


@query("select o_orderpriority as priority, count(*) as orders, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as revenue from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01' group by 1")
def p04_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics between two days as a SQL table function over the orders."""
    t(spark, sf_dir, "orders").createOrReplaceTempView("shelf_orders")
    spark.sql("""create or replace temporary function shelf_order_metrics(since timestamp, until timestamp) returns table (priority string, orders bigint, revenue double)
        return select o_orderpriority, count(*), cast(sum(cast(o_totalprice as decimal(12,2))) as double) from shelf_orders where o_orderdate >= shelf_order_metrics.since and o_orderdate < shelf_order_metrics.until group by o_orderpriority""")
    return spark.sql("select * from shelf_order_metrics(timestamp '1995-01-01', timestamp '1997-01-01')")


@query("select field, floor(avg(ok::int) * 10000 + 0.5) / 10000 as accuracy from (select unnest(['brand', 'size', 'price']) as field, unnest([p_brand = 'Brand#11', p_size > 25, p_retailprice > 1000]) as ok from part) group by 1")
def r05_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's share of right values; how a field is compared depends on the field (R03)."""
    checks = {"brand": F.col("p_brand") == "Brand#11", "size": F.col("p_size") > 25, "price": F.col("p_retailprice") > 1000}
    f = t(spark, sf_dir, "part").select(F.inline(F.array(*(F.struct(F.lit(k).alias("field"), v.cast("int").alias("ok")) for k, v in checks.items()))))
    return f.groupBy("field").agg(half_up(F.avg("ok"), 4).alias("accuracy"))


@query("with a as (select o_custkey, max(cast(o_totalprice as decimal(12,2))) as a, min(cast(o_totalprice as decimal(12,2))) as b from orders group by 1) select count(*) as pairs, floor(cast(sum(a - b) as double) / count(*) * 100 + 0.5) / 100 as mean_difference, case when sum(a - b) > 0 then 'improved' when sum(a - b) < 0 then 'worse' else 'equal' end as claim from a")
def r10_paired_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean difference of a metric over pairs with equal keys, and what it claims."""
    from .search import paired

    o, price = t(spark, sf_dir, "orders").groupBy("o_custkey"), F.col("o_totalprice").cast("decimal(12,2)")
    total = F.sum(F.col("a") - F.col("b"))
    claim = F.when(total > 0, "improved").when(total < 0, "worse").otherwise("equal")
    return paired(o.agg(F.max(price).alias("a")), o.agg(F.min(price).alias("b")), ["o_custkey"]).agg(F.count("*").alias("pairs"), half_up(total.cast("double") / F.count("*")).alias("mean_difference"), claim.alias("claim"))
