"""Joins, deduplication, windows, top-k and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tables as op
from ..operators.scans import scanned
from .registry import half_up, money, query, t


@query("""select p_partkey as sku, case when p_size > 40 then p_retailprice + 1 else p_retailprice end as price, p_size > 40 as changed from part""")
def b01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    old = p.where("p_size <= 45").select(F.col("p_partkey").alias("sku"), F.col("p_retailprice").alias("price"), F.lit(False).alias("changed"))
    new = p.where("p_size > 40").select(F.col("p_partkey").alias("sku"), (F.col("p_retailprice") + 1).alias("price"), F.lit(True).alias("changed"))
    return op.upsert(old, new, ["sku"])


@query("select p_partkey as sku, p_size > 45 as added from part")
def b02_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    return op.insert_absent(p.where("p_size <= 45").select(F.col("p_partkey").alias("sku"), F.lit(False).alias("added")), p.where("p_size > 40").select(F.col("p_partkey").alias("sku"), F.lit(True).alias("added")), ["sku"])


@query("""select user_id % 20 as config_id, strftime(ts, '%Y-%m-%d') as metric_date, case when ts >= timestamp '2024-01-10' then count(*) else 0 end as total_runs from events group by 1, 2, ts >= timestamp '2024-01-10'""")
def b03_rollup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("config_id"), F.date_format("ts", "yyyy-MM-dd").alias("metric_date"))
    old = e.distinct().withColumn("total_runs", F.lit(0).cast("long"))
    return op.upsert(old, e.where("metric_date >= '2024-01-10'").groupBy("config_id", "metric_date").agg(F.count("*").alias("total_runs")), ["config_id", "metric_date"])


@query("""select user_id as sku, list_sort(list(distinct event_type)) as names, cast(max(event_id) as bigint) as newest from events group by 1""")
def b04_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    maps = lambda d: d.groupBy(F.col("user_id").alias("sku"), "event_type").agg(F.max("event_id").alias("v")).groupBy("sku").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("sources"))
    cut = F.lit("2024-01-15").cast("timestamp")
    m = op.merged_sources(maps(e.where(F.col("ts") < cut)), maps(e.where(F.col("ts") >= cut)), "sku")
    return m.select("sku", F.sort_array(F.map_keys("sources")).alias("names"), F.array_max(F.map_values("sources")).alias("newest"))


@query("""with v as (select user_id as sku, event_type as source, json_extract_string(props, '$.k') as field, max_by(event_id, (ts >= timestamp '2024-01-15', event_id)) as value from events group by all), s as (select sku, source, string_agg(field || '=' || value, ',' order by field) as entry from v group by all)
select sku, string_agg(source || ':' || entry, ';' order by source) as sources from s group by 1""")
def l03_merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source said before and after a day, merged field by field: a source's older fields stay where the newer entry lacks them."""
    e, cut = t(spark, sf_dir, "events").withColumn("field", F.get_json_object("props", "$.k")), F.lit("2024-01-15").cast("timestamp")

    def maps(d: DataFrame) -> DataFrame:
        fields = d.groupBy(F.col("user_id").alias("sku"), "event_type", "field").agg(F.max("event_id").alias("v"))
        entry = fields.groupBy("sku", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("entry"))
        return entry.groupBy("sku").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "entry"))).alias("sources"))

    m = op.merged_sources(maps(e.where(F.col("ts") < cut)), maps(e.where(F.col("ts") >= cut)), "sku")
    said = lambda entry: F.array_join(F.transform(F.array_sort(F.map_entries(entry)), lambda f: F.concat_ws("=", f["key"], f["value"].cast("string"))), ",")
    # maps have no order of their own: entries are told by their names
    names = F.array_sort(F.map_keys("sources"))
    return m.select("sku", F.array_join(F.transform(names, lambda n: F.concat_ws(":", n, said(F.element_at("sources", n)))), ";").alias("sources"))


@query("select o_orderkey as sku, true as known from orders join customer on c_custkey = o_custkey where c_acctbal >= 0")
def b06_partial_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sku"), F.col("o_custkey").alias("c"))
    kept, _ = op.partial_persist(o, t(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("c")), "c")
    return kept.select("sku", F.lit(True).alias("known"))


@query("""with c as (select p_partkey, first_value(p_partkey) over (partition by p_brand, p_type order by p_retailprice, p_partkey) as canonical_id from part)
select l_orderkey, l_linenumber, canonical_id as l_partkey from lineitem join c on l_partkey = p_partkey""")
def b07_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = op.canonical_ids(t(spark, sf_dir, "part"), F.concat_ws("|", "p_brand", "p_type"), "p_partkey", "p_retailprice", "p_partkey")
    return op.repointed(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ids, "l_partkey")


@query("select p_partkey, p_brand, p_type from part qualify row_number() over (partition by p_brand, p_type order by p_retailprice desc, p_partkey) = 1")
def b08_delete_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_by(t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice"), ["p_brand", "p_type"], F.desc("p_retailprice"), "p_partkey").drop("p_retailprice")


@query("select distinct l_partkey, l_suppkey from lineitem")
def b09_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"])


@query("""select l_orderkey as owner, l_partkey as related from lineitem where l_orderkey in (select l_orderkey from lineitem where l_quantity > 45) and l_quantity > 45
union all select l_orderkey, l_partkey from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)""")
def b10_replace_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("related"), "l_quantity")
    return op.replace_relations(rel.drop("l_quantity"), rel.where("l_quantity > 45").drop("l_quantity"), "owner")


@query("select p_partkey as sku, p_retailprice as old_price, p_retailprice + 1 as new_price from part where p_size > 40")
def b16_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_retailprice").alias("price"), "p_size")
    return op.price_history(p, p.withColumn("price", F.when(F.col("p_size") > 40, F.col("price") + 1).otherwise(F.col("price"))), "sku", "price")


@query("select o_custkey as code, count(*) as used from orders where o_orderstatus <> 'P' group by 1")
def b17_usage_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("code")).agg(F.count("*").alias("used"))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as is_default from orders")
def b18_one_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) == 1).alias("is_default"))


@query("select o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') as first_order from orders group by 1")
def b19_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_order"))


@query("select o_orderkey, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then 'returned' when o_orderstatus = 'P' then 'pending' else 'done' end as status from orders")
def b21_status_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("back", F.lit(True))
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(back, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("back"), "returned").when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))


@query("""with b as (select regexp_replace(lower(p_brand), '[^a-z]', '', 'g') as k, p_brand, count(*) as n from part group by 1, 2), r as (select *, first_value(p_brand) over (partition by k order by n desc, p_brand) as canonical from b)
select p_partkey, canonical as p_brand from part join r using (p_brand)""")
def b23_brand_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    used = p.groupBy("p_brand").count()
    ids = op.canonical_ids(used, F.regexp_replace(F.lower("p_brand"), "[^a-z]", ""), "p_brand", -F.col("count"), "p_brand")
    return op.repointed(p, ids, "p_brand").select("p_partkey", "p_brand")


@query("""select o_orderkey, p_name, s_name, n_name from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey where o_custkey = 7""")
def d01_four_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders").where("o_custkey = 7"), F.col("l_orderkey") == F.col("o_orderkey"))
    l = l.join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return l.join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("o_orderkey", "p_name", "s_name", "n_name")


@query("""select distinct on (l_partkey) l_partkey, o_orderkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey order by l_partkey, o_orderdate desc, o_orderkey""")
def d02_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct().join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return op.first_by(l, ["l_partkey"], F.desc("o_orderdate"), "o_orderkey").select("l_partkey", "o_orderkey", "o_custkey")


@query("select r_name, n_name, count(s_suppkey) as suppliers from region left join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by 1, 2")
def d04_left_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    j = t(spark, sf_dir, "region").join(t(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("suppliers"))


@query("select event_id, p_name from events left join part on p_partkey = try_cast(json_extract_string(props, '$.k') as bigint)")
def d05_json_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name"), "k", "left").select("event_id", "p_name")


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'O') as open_orders from customer")
def d06_lateral_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("open_orders"))


@query("select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def d07_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def d08_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("select distinct l_orderkey from lineitem where (l_returnflag = 'R' and l_linestatus = 'F') or (l_returnflag = 'A' and l_quantity > 40)")
def d09_facet_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").where("(l_returnflag = 'R' and l_linestatus = 'F') or (l_returnflag = 'A' and l_quantity > 40)").select("l_orderkey").distinct()


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def d10_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select distinct w as token from (select unnest(string_split(lower(p_type), ' ')) as w from part) where w <> '' and w not in (select lower(r_name) from region) and w not in (select unnest(string_split(lower(p_name), ' ')) from part)")
def d11_new_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    words = lambda c: p.select(F.explode(F.split(F.lower(c), " ")).alias("token"))
    known = words("p_name").union(t(spark, sf_dir, "region").select(F.lower("r_name")))
    return words("p_type").where("token <> ''").distinct().join(known.distinct(), "token", "left_anti")


@query("select count(*) filter (where p_size <= 40 and p_size > 10) as kept, count(*) filter (where p_size > 40 and p_size > 10) as added, count(*) filter (where p_size <= 40 and p_size <= 10) as removed from part")
def d12_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    old, new = p.where("p_size <= 40").select("p_partkey", F.lit(1).alias("o")), p.where("p_size > 10").select("p_partkey", F.lit(1).alias("n"))
    return old.join(new, "p_partkey", "full_outer").agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("kept"), F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"))


@query("""select p_partkey as sku, case when p_size = 3 then 'missing' when p_size > 40 or p_size = 1 then 'update' else 'unchanged' end as status,
case when p_size = 3 then 0 else (case when p_size > 40 then 1 else 0 end) + (case when p_size = 1 then 1 else 0 end) end as n_diffs from part""")
def d13_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("quantity"))
    new = p.select("sku", F.when(F.col("quantity") > 40, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.when(F.col("quantity") == 1, None).otherwise(F.col("quantity")).alias("quantity"))
    return op.changes(p.where("quantity <> 3"), new, "sku", ["price", "quantity"]).select("sku", "status", F.size("diffs").alias("n_diffs"))


@query("select o_orderkey, c_mktsegment from orders left join customer on lower(trim(c_name)) = lower(trim('Customer#' || lpad(cast(o_custkey as varchar), 9, '0')))")
def d14_folded_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.trim(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))).alias("k"))
    return o.join(t(spark, sf_dir, "customer").select(F.lower(F.trim("c_name")).alias("k"), "c_mktsegment"), "k", "left").select("o_orderkey", "c_mktsegment")


@query("select s_suppkey, coalesce(case when n >= 600 then 'high' when n >= 1 then 'medium' end, 'untested') as tier from supplier left join (select l_suppkey, count(*) n from lineitem where l_returnflag = 'R' group by 1) on l_suppkey = s_suppkey")
def d15_left_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t(spark, sf_dir, "supplier").select("s_suppkey").join(n, "s_suppkey", "left").select("s_suppkey", F.when(F.col("n") >= 600, "high").when(F.col("n") >= 1, "medium").otherwise("untested").alias("tier"))


@query("with s as (select distinct s_nationkey % 5 as slice from supplier), g as (select r_regionkey from region) select cast(slice as int) as slice, r_regionkey as site_group from s cross join g")
def d16_slices_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices x site groups: both sides are small lists by definition, five each here."""
    return t(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("slice")).distinct().crossJoin(t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("site_group")))


@query("""select n_name, list_sort(list(s_name)) as suppliers from nation join supplier on s_nationkey = n_nationkey group by n_nationkey, n_name""")
def d22_nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("s_name")).alias("suppliers")).join(t(spark, sf_dir, "nation"), "n_nationkey").select("n_name", "suppliers")


@query("""select a.p_partkey as product, b.p_partkey as related from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey <> b.p_partkey
qualify row_number() over (partition by a.p_partkey order by b.p_retailprice desc, b.p_partkey) <= 3""")
def d23_related_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("product"), "p_brand", "p_type")
    b = op.first_by(p, ["p_brand", "p_type"], F.desc("p_retailprice"), "p_partkey", n=4)  # three without the product itself
    j = a.join(b.select(F.col("p_partkey").alias("related"), "p_brand", "p_type", "p_retailprice"), ["p_brand", "p_type"]).where("product <> related")
    return op.first_by(j, ["product"], F.desc("p_retailprice"), "related", n=3).select("product", "related")


@query("select o_orderkey, 'review' as queue from orders where o_orderstatus = 'F' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') union all select o_orderkey, 'export' from orders where o_orderstatus = 'F' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def d24_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("back", F.lit(True))
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(back, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("back"), "export").otherwise("review").alias("queue"))


@query("""with x as (select o_orderkey, o_custkey, (o_custkey * 7 + i) % 1700 as target, i from orders, range(4) r(i)), y as (select *, row_number() over (partition by o_orderkey, target order by i) as rn from x)
select count(*) filter (where rn > 1) as duplicates, count(*) filter (where rn = 1 and target = o_custkey) as self_links, count(*) filter (where rn = 1 and target <> o_custkey and c_custkey is null) as missing, count(*) filter (where rn = 1 and target <> o_custkey and c_custkey is not null) as linked from y left join customer on c_custkey = target""")
def d25_cross_sell_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("o_custkey") * 7 + i) % 1700)).alias("i", "target"))
    y = o.withColumn("rn", F.row_number().over(Window.partitionBy("o_orderkey", "target").orderBy("i"))).join(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.lit(True).alias("there")), "target", "left")
    own = F.col("rn") == 1
    return y.agg(F.count_if(~own).alias("duplicates"), F.count_if(own & (F.col("target") == F.col("o_custkey"))).alias("self_links"), F.count_if(own & (F.col("target") != F.col("o_custkey")) & F.col("there").isNull()).alias("missing"), F.count_if(own & (F.col("target") != F.col("o_custkey")) & F.col("there").isNotNull()).alias("linked"))


@query("select p_partkey, first_value(p_partkey) over (partition by lower(p_type) order by length(p_name), p_name, p_partkey) as canonical_id from part")
def f01_canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.canonical_ids(t(spark, sf_dir, "part"), F.lower("p_type"), "p_partkey", F.length("p_name"), "p_name", "p_partkey")


@query("select p_partkey, row_number() over (partition by p_brand order by case when p_size > 25 then 0 else 1 end, p_partkey) as dup_rank from part")
def f02_duplicate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, 0).otherwise(1).alias("k"))
    return op.ranked_within(p, "p_brand", "k", "p_partkey").select("p_partkey", (F.col("__rank") + 1).alias("dup_rank"))


@query("select event_id, json_extract_string(props, '$.k') as key from events qualify row_number() over (partition by json_extract_string(props, '$.k') order by ts, event_id) = 1")
def f03_earliest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("event_id", "ts", F.get_json_object("props", "$.k").alias("key"))
    return op.first_by(e, ["key"], "ts", "event_id").select("event_id", "key")


@query("select p_partkey, cast(i - 1 as int) as sort_order, string_split(p_name, ' ')[i] as word from part, range(1, 20) r(i) where i <= len(string_split(p_name, ' '))")
def f04_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("sort_order", "word"))


@query("""with h as (select user_id, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_id) - 1 as r, count(*) over (partition by user_id) as n from events),
s as (select user_id, max(n) n, avg(case when r < n // 2 then ok::int end) as a, avg(case when r >= n // 2 then ok::int end) as b from h group by 1)
select user_id, case when n < 4 then 'stable' when b - a > 0.1 then 'improving' when b - a < -0.1 then 'declining' else 'stable' end as trend from s""")
def f06_half_split_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success in the later half of a user's events against the earlier half."""
    e = op.ranked_within(t(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").cast("int").alias("ok")), "user_id", "ts", "event_id")
    half = F.floor(F.col("n") / 2)
    e = e.join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    s = e.groupBy("user_id").agg(F.max("n").alias("n"), (F.avg(F.when(F.col("__rank") >= half, F.col("ok"))) - F.avg(F.when(F.col("__rank") < half, F.col("ok")))).alias("d"))
    return s.select("user_id", F.when(F.col("n") < 4, "stable").when(F.col("d") > 0.1, "improving").when(F.col("d") < -0.1, "declining").otherwise("stable").alias("trend"))


@query("select event_id, floor(cast(sum(cast(value as decimal(18,6))) over w as double) / count(*) over w * 10000 + 0.5) / 10000 as running_avg from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def f07_running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event and those before it of its user, however many they are."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", money("value", "decimal(18,6)").alias("value"))
    own = scanned(e, "user_id", ["ts", "event_id"], {"total": F.col("value"), "n": F.lit(1)})
    return own.select("event_id", half_up(F.col("total").cast("double") / F.col("n"), 4).alias("running_avg"))


@query("select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type from events group by 1")
def f08_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    return last.select("user_id", "x.event_id", "x.event_type")


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 8")
def f09_top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_by(t(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey", n=8).select("o_custkey", "o_orderkey")


@query("select o_orderkey, ntile(cast(ceil((select count(*) from orders) / 700.0) as int)) over (order by o_orderkey) - 1 as slice_index from orders")
def f10_balanced_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.balanced_slices(t(spark, sf_dir, "orders").select("o_orderkey"), 700, "o_orderkey")


@query("select p_partkey, p_brand || '::' || cast((row_number() over (partition by p_brand order by p_partkey) + 9) // 10 as varchar) as chunk from part")
def f11_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = op.ranked_within(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")
    return r.select("p_partkey", F.concat("p_brand", F.lit("::"), F.floor(F.col("__rank") / 10 + 1).cast("string")).alias("chunk"))


@query("""with x as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r, lead(value) over (partition by user_id order by ts desc, event_id desc) as before from events)
select user_id, count(*) filter (where value < before) as drops, count(*) = 4 and count(*) filter (where value < before) = 4 as alert from x where r <= 4 and before is not null group by 1""")
def f12_consecutive_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = op.first_by(t(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id"), n=5)
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = last.withColumn("before", before).where("before is not null")
    down = F.count_if(F.col("value") < F.col("before"))
    return x.groupBy("user_id").agg(down.alias("drops"), ((F.count("*") == 4) & (down == 4)).alias("alert"))


@query("select o_orderkey, o_totalprice, (select count(*) from orders) as total from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def g01_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of an ordered table, with the number of all its rows."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).crossJoin(o.agg(F.count("*").alias("total")))  # one row


@query("""select * from (select * from (select 'order' as type, o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as moment from orders order by o_orderdate desc, o_orderkey limit 10) union all select * from (select 'event', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') from events order by ts desc, event_id limit 10)) order by moment desc, type, id limit 10""")
def g02_recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("moment")
    o = t(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select(F.lit("order").alias("type"), F.col("o_orderkey").alias("id"), stamp("o_orderdate"))
    e = t(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(10).select(F.lit("event").alias("type"), F.col("event_id").alias("id"), stamp("ts"))
    return o.unionByName(e).orderBy(F.desc("moment"), "type", "id").limit(10)


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'P' order by o_orderpriority, o_orderdate, o_orderkey limit 25")
def g03_due_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority")


@query("select l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey order by case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end, l_quantity desc, l_linenumber) <= 2")
def g05_evidence_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return op.first_by(t(spark, sf_dir, "lineitem"), ["l_orderkey"], trust, F.desc("l_quantity"), "l_linenumber", n=2).select("l_orderkey", "l_linenumber")


@query("select word, count(*) as count from (select unnest(string_split(p_name, ' ')) as word from part) group by 1 order by 2 desc, 1 limit 15")
def g07_frequency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(15)


@query("select user_id, count(*) as attempts, count(*) filter (where event_type <> 'error') * 1.0 / count(*) < 0.75 as unhealthy from events group by 1 having count(*) >= 5 and count(*) filter (where event_type <> 'error') * 1.0 / count(*) < 0.75")
def g11_unhealthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("attempts"), (F.count_if(F.col("event_type") != "error") / F.count("*")).alias("rate"))
    return s.where("attempts >= 5 and rate < 0.75").select("user_id", "attempts", F.lit(True).alias("unhealthy"))


@query("""with v as (select user_id, cast(json_extract_string(props, '$.k') as bigint) as product, max(ts) as moment from events where event_type = 'view' group by 1, 2)
select user_id, product from v where product <> 3 qualify row_number() over (partition by user_id order by moment desc, product) <= 4""")
def g12_recently_viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("product")).agg(F.max("ts").alias("moment"))
    return op.first_by(v.where("product <> 3"), ["user_id"], F.desc("moment"), "product", n=4).select("user_id", "product")


@query("select 'part' as type, p_partkey as id, p_name as name from part union all select 'supplier', s_suppkey, s_name from supplier union all select 'region', r_regionkey, r_name from region")
def h02_entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda n, k, c: t(spark, sf_dir, n).select(F.lit(n).alias("type"), F.col(k).cast("long").alias("id"), F.col(c).alias("name"))
    return kind("part", "p_partkey", "p_name").unionByName(kind("supplier", "s_suppkey", "s_name")).unionByName(kind("region", "r_regionkey", "r_name"))


@query("select p_partkey, cast(len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), list_distinct(string_split(lower(p_type), ' ')))) as int) as common, cast(len(list_distinct(list_concat(string_split(lower(p_name), ' '), string_split(lower(p_type), ' ')))) as int) as either from part")
def h03_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return t(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("either"))
