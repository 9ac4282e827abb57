"""Workflows, source merges, cohorts, rankings and page data over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions import workflow
from ..operators import tables as op
from .registry import half_up, money, query, t


@query("""select p_partkey, upper(trim(replace(p_name, ' ', '-'))) as code, 'sku-' || lower(p_brand) as brand, coalesce(nullif(regexp_extract(p_type, '([A-Z]+) ', 1), ''), 'NONE') as first_word from part""")
def i01_transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [
        {"action": "transform_value", "params": {"field": "p_name", "target": "code", "transformations": [{"type": "replace", "pattern": " ", "replacement": "-"}, {"type": "strip"}, {"type": "upper"}]}},
        {"action": "transform_value", "params": {"field": "p_brand", "target": "brand", "transformations": [{"type": "lower"}, {"type": "prefix", "value": "{pre}-"}]}},
        {"action": "transform_value", "params": {"field": "p_type", "target": "first_word", "transformations": [{"type": "regex_extract", "pattern": "([A-Z]+) "}, {"type": "default", "value": "NONE"}]}},
    ]
    return workflow.run(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), steps, {"pre": "sku"}).select("p_partkey", "code", "brand", "first_word")


@query("select p_partkey, trim(p_brand || ' ' || p_name) || ' (' || cast(p_size as varchar) || ')' as label, floor(p_size * 28.3495 / 453.592 * 10000 + 0.5) / 10000 as pounds from part")
def i07_combine_and_weigh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").withColumn("w", F.concat(F.col("p_size").cast("string"), F.lit(" oz")))
    steps = [{"action": "combine_fields", "params": {"format": "{p_brand} {p_name} ({p_size})", "target": "label"}}, {"action": "parse_weight", "params": {"field": "w", "target": "pounds"}}]
    return workflow.run(p, steps).select("p_partkey", "label", half_up(F.col("pounds"), 4).alias("pounds"))


@query("select event_id, case when event_type = 'error' then 'failed' else json_extract_string(props, '$.k') end as outcome from events")
def p03_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [{"action": "conditional", "params": {"field": "event_type", "condition": "value_match", "value": "error", "then": [{"action": "transform_value", "params": {"field": "event_type", "target": "outcome", "transformations": [{"type": "replace", "pattern": "error", "replacement": "failed"}]}}], "else": [{"action": "extract_from_json", "params": {"field": "props", "path": "k", "target": "outcome"}}]}}]
    return workflow.run(t(spark, sf_dir, "events").select("event_id", "event_type", "props"), steps).select("event_id", "outcome")


@query("select p_partkey, case when p_size % 2 = 0 then '5x' || cast(p_size + 5 as varchar) else cast(p_size as varchar) || 'ct' end as variant from part")
def m03_variant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    name = F.when(n % 2 == 0, F.concat((n + 5).cast("string"), F.lit(" in x 5 inches"))).otherwise(F.concat(n.cast("string"), F.lit(" pack")))
    return t(spark, sf_dir, "part").select("p_partkey", F.element_at(x.variant_tokens(name), 1).alias("variant"))


@query("select p_partkey, (p_size // 10) = ((p_size + 3) // 10) as overlap, (p_size // 10) <> ((p_size + 3) // 10) or p_size > 25 as conflict from part")
def m04_variant_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    a = x.variant_tokens(F.concat(F.floor(n / 10).cast("string"), F.lit(" lbs, 3 pack")))
    b = x.variant_tokens(F.concat(F.floor((n + 3) / 10).cast("string"), F.lit(" pounds, 2x4"), F.when(n > 25, " 4 count").otherwise("")))
    own = t(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    return own.select("p_partkey", F.arrays_overlap("a", "b").alias("overlap"), x.variants_conflict(F.col("a"), F.col("b")).alias("conflict"))


@query("select p_partkey, p_size > 10 or p_type = 'PROMO' as matched from part")
def m05_brand_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is matched by a candidate's brand that holds it or is held by it, or by the address's host."""
    found = F.when(F.col("p_size") > 10, F.concat(F.upper("p_brand"), F.lit("® Inc"))).otherwise("")
    host = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("www."), x.token_text("p_brand"), F.lit("-shop.com"))).otherwise("www.shop.com")
    return t(spark, sf_dir, "part").select("p_partkey", x.brand_matches(F.col("p_brand"), found, host).alias("matched"))


@query("""with d as (select user_id as cohort, event_type as domain, count(*) as n from events group by 1, 2)
select cohort, domain, n from d where n >= 6 qualify row_number() over (partition by cohort order by n desc, domain) = 1""")
def m18_dominant_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cohort's most frequent domain, if it came at least six times; ties to the smaller name."""
    d = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cohort"), F.col("event_type").alias("domain")).agg(F.count("*").alias("n"))
    return op.first_by(d.where("n >= 6"), ["cohort"], F.desc("n"), "domain")


@query("""with c as (select p_partkey, left(lpad(cast(p_partkey * 7919 as varchar), 12, '0'), 6) as prefix from part), n as (select *, count(*) over (partition by prefix) as size, row_number() over (partition by prefix order by p_partkey) as r from c)
select p_partkey, case when size < 2 then null else prefix || '::' || cast((r + 4) // 5 as varchar) end as cohort from n""")
def m22_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by code prefix: single rows stay out, large groups are cut to five."""
    w = Window.partitionBy("prefix")
    c = t(spark, sf_dir, "part").select("p_partkey", F.left(x.upc(F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0")), F.lit(6)).alias("prefix"))
    r = F.row_number().over(w.orderBy("p_partkey"))
    return c.select("p_partkey", F.when(F.count("*").over(w) >= 2, F.concat("prefix", F.lit("::"), F.ceil(r / 5).cast("string"))).alias("cohort"))


@query("""with v as (select p_brand as cohort, p_partkey as sku, unnest(['type', 'size']) as field, unnest([p_type, cast(p_size as varchar)]) as value from part)
select cohort, field, count(distinct value) as n_values, count(distinct sku) as n_skus, count(distinct value) > 20 as inconsistent from v group by 1, 2""")
def e30_field_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "part").select(F.col("p_brand").alias("cohort"), F.col("p_partkey").alias("sku"), F.inline(F.array(F.struct(F.lit("type").alias("field"), F.col("p_type").alias("value")), F.struct(F.lit("size").alias("field"), F.col("p_size").cast("string").alias("value")))))
    return v.groupBy("cohort", "field").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("sku").alias("n_skus"), (F.count_distinct("value") > 20).alias("inconsistent"))


@query("""with c as (select p_brand as cohort, count(distinct p_type) as kinds, count(*) filter (where p_size = 1) * 1.0 / count(*) as failed from part group by 1) select cohort, floor(greatest(0, least(1, 1 - 0.001 * kinds - failed * 0.5)) * 10000 + 0.5) / 10000 as score from c""")
def e31_consistency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cohort")).agg(F.count_distinct("p_type").alias("kinds"), (F.count_if(F.col("p_size") == 1) / F.count("*")).alias("failed"))
    return c.select("cohort", half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.001 * F.col("kinds") - 0.5 * F.col("failed"))), 4).alias("score"))


@query("select l_orderkey as job, cast(sum(l_linenumber) as bigint) as processed, count(distinct l_partkey) as skus, case when bool_or(l_returnflag = 'R') then 'failed' when bool_and(l_linestatus = 'F') then 'completed' else 'running' end as status from lineitem group by 1")
def e28_chunk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.bool_or(F.col("l_returnflag") == "R"), "failed").when(F.bool_and(F.col("l_linestatus") == "F"), "completed").otherwise("running")
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.sum("l_linenumber").cast("long").alias("processed"), F.count_distinct("l_partkey").alias("skus"), status.alias("status"))


@query("select strftime(ts, '%Y-%m-%d') as date, count(*) as jobs, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'view') as views, floor(count(*) filter (where event_type = 'error') * 1000.0 / count(*) + 0.5) / 10 as error_rate from events group by 1")
def e23_daily_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return t(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("jobs"), kind("click").alias("clicks"), kind("view").alias("views"), half_up(kind("error") * 100 / F.count("*"), 1).alias("error_rate"))


@query("select event_type as type, count(*) * case event_type when 'error' then 3 when 'purchase' then 2 else 1 end + case when max(value) > 100 then 10 else 0 end as priority from events group by 1")
def e37_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return t(spark, sf_dir, "events").groupBy("event_type", weight.alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("event_type").alias("type"), (F.col("n") * F.col("w") + F.when(F.col("most") > 100, 10).otherwise(0)).alias("priority"))


@query("""with l as (select user_id, max(ts) as last from events group by 1), s as (select case when last is null then 'missing' when timestamp '2024-01-31' - last > interval 20 day then 'expired' when timestamp '2024-01-31' - last > interval 5 day then 'stale' else 'valid' end as state from customer left join l on user_id = c_custkey)
select count(*) as total, count(*) filter (where state = 'valid') as valid, count(*) filter (where state = 'stale') as stale, count(*) filter (where state = 'expired') as expired, count(*) filter (where state = 'missing') as missing from s""")
def e44_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .events import o10_cache_states

    is_ = lambda s: F.count_if(F.col("state") == s).alias(s)
    return o10_cache_states(spark, sf_dir).agg(F.count("*").alias("total"), is_("valid"), is_("stale"), is_("expired"), is_("missing"))


@query("select l_partkey as sku, count(distinct l_suppkey) as sites from lineitem group by 1 having count(distinct l_suppkey) >= 3")
def e45_multi_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(F.count_distinct("l_suppkey").alias("sites")).where("sites >= 3")


@query("select l_orderkey, case when count(distinct l_returnflag) = 1 then min(l_returnflag) else '' end as common from lineitem group by 1")
def e46_common_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.min("l_returnflag") == F.max("l_returnflag"), F.min("l_returnflag")).otherwise("")
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(v.alias("common"))


@query("select distinct unnest(json_keys(props)) as key from events")
def e51_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query("select o_custkey from orders group by 1 having count(*) = 1")
def e52_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").groupBy("o_custkey").count().where("count = 1").select("o_custkey")


@query("""with w as (select p_partkey, i, string_split(p_type || ' ' || p_type, ' ')[i] as w from part, range(1, 12) r(i) where i <= len(string_split(p_type || ' ' || p_type, ' '))), f as (select p_partkey, w, min(i) as i from w group by 1, 2) select p_partkey, string_agg(w, '|' order by i) as words from f group by 1""")
def f05_dedup_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat("p_type", F.lit(" "), "p_type"), " ")), "|").alias("words"))


@query("select event_id, ts_rank from (select event_id, row_number() over (order by ts desc, event_id desc) as ts_rank from events) where ts_rank <= 30")
def g10_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = t(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(30)  # thirty rows to number
    return last.select("event_id", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))).cast("long").alias("ts_rank"))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'O' and o_orderpriority <> '1-URGENT' order by o_orderdate desc, o_orderkey limit 500")
def g13_order_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority <> '1-URGENT'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderkey", "o_orderstatus")


@query("select s_suppkey, case when acc >= 0.5 then 'high' when acc >= 0.2 then 'medium' when acc > 0 then 'low' else 'untested' end as tier, row_number() over (order by case when acc >= 0.5 then 0 when acc >= 0.2 then 1 when acc > 0 then 2 else 3 end, acc desc, s_suppkey) as place from (select s_suppkey, s_acctbal / 10000 as acc from supplier) order by place limit 40")
def g06_tiered_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = F.col("s_acctbal") / 10000
    s = t(spark, sf_dir, "supplier").select("s_suppkey", acc.alias("acc"), F.when(acc >= 0.5, 0).when(acc >= 0.2, 1).when(acc > 0, 2).otherwise(3).alias("k"))
    top = s.orderBy("k", F.desc("acc"), "s_suppkey").limit(40)
    return top.select("s_suppkey", F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "untested"))), F.col("k") + 1).alias("tier"), F.row_number().over(Window.orderBy("k", F.desc("acc"), "s_suppkey")).cast("long").alias("place"))


@query("select p_partkey, case when regexp_matches(code, '^[0-9]{12,14}$') then 'gtin' when regexp_matches(code, '^[0-9]+$') then 'numeric' when regexp_matches(code, '^[A-Za-z]+[-_]?[0-9]+$') then 'prefixed' else 'other' end as class from (select p_partkey, case p_partkey % 4 when 0 then lpad(cast(p_partkey as varchar), 12, '0') when 1 then cast(p_partkey as varchar) when 2 then 'AB-' || cast(p_partkey as varchar) else 'x y' end as code from part)")
def i30_sku_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    code = F.when(k == 0, F.lpad(n, 12, "0")).when(k == 1, n).when(k == 2, F.concat(F.lit("AB-"), n)).otherwise("x y")
    return t(spark, sf_dir, "part").select("p_partkey", x.sku_class(code).alias("class"))


@query("select event_id, case when hour(ts) < 6 then 'night' when hour(ts) < 12 then 'morning' when hour(ts) < 18 then 'afternoon' else 'evening' end as bucket from events")
def i30_hour_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.hour("ts")
    return t(spark, sf_dir, "events").select("event_id", F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening").alias("bucket"))


@query("""select doc_id, case when regexp_matches(text, '(^|\\n)[-*•] ') then 'bullet' else 'prose' end as structure, cast(len(regexp_extract_all(text, '[.!?]+')) as int) as sentences, cast(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) as int) as words from documents""")
def i33_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("text").rlike(r"(^|\n)[-*•] "), "bullet").otherwise("prose").alias("structure"), F.size(F.regexp_extract_all("text", F.lit("[.!?]+"), F.lit(0))).alias("sentences"), F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")).alias("words"))


@query("select p_partkey, case when p_size between 1 and 30 then p_size * 1.0 end as rating from part")
def i27_bounded_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", x.number_after(F.concat(F.lit("rated "), F.col("p_size").cast("string"), F.lit(" of 30")), 1, 30).alias("rating"))


@query("""with p as (select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) as base, regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') as path,
list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: q <> '' and not starts_with(lower(q), 'utm_') and lower(string_split(q, '=')[1]) not in ('gclid','fbclid','msclkid','ref','ref_','srsltid'))) as q from pages)
select page_id, base || case when path = '' then '/' else path end || case when len(q) = 0 then '' else '?' || array_to_string(q, '&') end as url from p""")
def i43_canonical_url_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", x.canonical_url("url", sort=True).alias("url"))


@query("select doc_id, case when length(text) <= 80 then text else rtrim(regexp_replace(substring(text, 1, 80), '[ \\t\\n\\r]+[^ \\t\\n\\r]*$', '')) || '...' end as short from documents")
def i47_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", x.truncated("text", 80).alias("short"))


@query("select p_partkey, string_split(lower(p_name), ' ')[1] as value, regexp_replace(string_split(lower(p_name), ' ')[1], '[^a-z0-9]+', '-', 'g') as slug from part")
def i21_facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.element_at(x.pipe_values(F.regexp_replace(F.lower("p_name"), " ", " | ")), 1)
    return t(spark, sf_dir, "part").select("p_partkey", v.alias("value"), x.slug(v).alias("slug"))


@query("""with m as (select user_id as sku, event_type as field, value, event_id from events) select sku, field, min_by(value, event_id) as value, list_sort(list(distinct value)) as every from m where value is not null group by 1, 2""")
def l02_merge_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field the first value in source order, and the union of all."""
    m = t(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("sku"), F.col("event_type").alias("field"), "value", "event_id")
    return m.groupBy("sku", "field").agg(F.min_by("value", "event_id").alias("value"), F.sort_array(F.collect_set("value")).alias("every"))


@query("select event_id, json_extract_string(props, '$.k') as k, to_json({'id': event_id, 'type': event_type}) as packed from events")
def l09_json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("packed"))


@query("""with k as (select n_nationkey as id, n_name as name, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') as slug from nation), s as (select s_suppkey, case s_suppkey % 3 when 0 then cast(s_nationkey as varchar) when 1 then (select slug from k where id = s_nationkey) else (select name from k where id = s_nationkey) end as pick from supplier)
select s_suppkey, coalesce(a.id, b.id, c.id) as resolved from s left join k a on pick = cast(a.id as varchar) left join k b on pick = b.slug left join k c on pick = c.name""")
def l15_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections by id, slug or name: one lookup of all spellings with a priority, the best hit of each selection."""
    k = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name", x.slug("n_name").alias("slug"))
    lookup = k.select("id", F.inline(F.array(*(F.struct(F.lit(i).alias("rank"), v.alias("pick")) for i, v in enumerate((F.col("id").cast("string"), F.col("slug"), F.col("n_name"))))))).groupBy("pick").agg(F.min_by("id", "rank").alias("resolved"))
    s = t(spark, sf_dir, "supplier").join(k, F.col("s_nationkey") == F.col("id"))
    pick = F.when(F.col("s_suppkey") % 3 == 0, F.col("id").cast("string")).when(F.col("s_suppkey") % 3 == 1, F.col("slug")).otherwise(F.col("n_name"))
    return s.select("s_suppkey", pick.alias("pick")).join(lookup, "pick", "left").select("s_suppkey", "resolved")


@query("""with j as (select page_id, unnest(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1)) as h from pages) select page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as heading from j""")
def n03_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1))).alias("h"))
    return h.select("page_id", x.collapsed(F.regexp_replace("h", "<[^>]+>", " ")).alias("heading"))


@query("""with r as (select p_brand, p_partkey, first_value(p_retailprice) over (partition by p_brand order by p_partkey) as lead_price, p_size from part) select p_partkey, case when p_size > 40 then lead_price else null end as inherited from r""")
def d21_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of a cohort's first member, for members without one of their own."""
    p = t(spark, sf_dir, "part")
    lead = p.groupBy("p_brand").agg(F.min_by("p_retailprice", "p_partkey").alias("lead_price"))
    return p.join(lead, "p_brand").select("p_partkey", F.when(F.col("p_size") > 40, F.col("lead_price")).alias("inherited"))


@query("select p_partkey, coalesce(nullif(trim(p_name), ''), nullif(p_type, ''), 'unknown') as name, floor(greatest(0, coalesce(try_cast(p_retailprice as double), 0)) * 100 + 0.5) / 100 as price, cast(greatest(0, p_size - 10) as int) as quantity, p_size > 10 as available from part")
def b14_export_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t(spark, sf_dir, "part").select("p_partkey", F.coalesce(filled("p_name"), filled("p_type"), F.lit("unknown")).alias("name"), half_up(F.greatest(F.lit(0.0), F.coalesce("p_retailprice", F.lit(0.0)))).alias("price"), F.greatest(F.lit(0), F.col("p_size") - 10).alias("quantity"), (F.col("p_size") > 10).alias("available"))


@query("select event_type as name, cast(row_number() over (order by event_type) as bigint) as place from (select distinct event_type from events)")
def b11_dimension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values with places: a list as short as the dimension."""
    return t(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().withColumn("place", F.row_number().over(Window.orderBy("name")).cast("long"))


@query("select l_orderkey, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as total from lineitem where l_returnflag in ('A', 'R') group by 1 having sum(l_quantity) > 100")
def c05_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).cast("double").alias("total"), F.sum("l_quantity").alias("q"))
    return s.where("q > 100").select("l_orderkey", "total")
