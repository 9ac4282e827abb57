"""Product text, catalog filters, quality rules, matching and pages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from .registry import half_up, query, t


@query("select p_partkey, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) as slug from part")
def i15_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", x.slug("p_name").alias("slug"))


@query("""with s as (select p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') as base from part), r as (select *, row_number() over (partition by base order by p_partkey) as k from s)
select p_partkey, case when k = 1 then base else base || '-' || cast(k - 1 as varchar) end as slug from r""")
def i16_unique_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a slug has it bare, later ones a running number."""
    from pyspark.sql import Window

    p = t(spark, sf_dir, "part").select("p_partkey", x.slug("p_type").alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return p.select("p_partkey", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), (k - 1).cast("string"))).alias("slug"))


@query("""select p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title from part""")
def i09_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", x.title_keep_caps(F.lower("p_type")).alias("title"))


@query("""select s_suppkey, regexp_replace(replace(regexp_replace(lower(s_name || ' & Co. Inc'), '\\b(co\\.?|inc\\.?|llc\\.?|corp\\.?|corporation|company|seeds?|pet products?|products?)\\b', '', 'g'), '&', 'and'), '[^a-z0-9]', '', 'g') as brand_key from supplier""")
def i18_brand_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "supplier").select("s_suppkey", x.brand_key(F.concat("s_name", F.lit(" & Co. Inc"))).alias("brand_key"))


@query("""select p_partkey, printf('%.2f', floor(case p_size % 4 when 0 then p_size / 16.0 when 1 then p_size when 2 then 1 + p_size / 16.0 end * 100 + 0.5) / 100) as weight from part""")
def i06_pounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("p_size").cast("string"), F.col("p_size") % 4
    w = F.when(s == 0, F.concat(n, F.lit(" oz"))).when(s == 1, F.concat(n, F.lit("lb"))).when(s == 2, F.concat(F.lit("1 lb "), n, F.lit(" oz"))).otherwise("N/A")
    return t(spark, sf_dir, "part").select("p_partkey", x.pounds(w).alias("weight"))


@query("""with u as (select p_partkey, lpad(cast(p_partkey * 7919 as varchar), 11, '0') as d from part), s as (select p_partkey, d, list_sum(list_transform(range(1, 12), lambda i: cast(d[12 - i] as int) * (case when i % 2 = 1 then 3 else 1 end))) as total from u)
select p_partkey, d || cast((10 - total % 10) % 10 as varchar) as upc, true as valid from s""")
def i25_upc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lpad((F.col("p_partkey") * 7919).cast("string"), 11, "0")
    u = F.concat(d, x.check_digit(d).cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", u.alias("upc"), x.valid_upc(F.concat(F.substring(u, 1, 6), F.lit("-"), F.substr(u, F.lit(7)))).alias("valid"))


@query("select p_partkey, left(regexp_replace(lpad(cast(p_partkey * 7919 as varchar), 12, '0'), '[- ]', '', 'g'), 6) as prefix from part")
def i28_sku_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.left(x.upc(F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0")), F.lit(6)).alias("prefix"))


@query("""with p as (select page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) as s, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) as h, regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') as path,
list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: q <> '' and not starts_with(lower(q), 'utm_') and lower(string_split(q, '=')[1]) not in ('fbclid','gclid','ref','srsltid')) as q from pages)
select page_id, lower(s) || '://' || lower(h) || case when path = '' then '/' else path end || case when len(q) = 0 then '' else '?' || array_to_string(q, '&') end as url from p""")
def i42_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", x.canonical_url("url").alias("url"))


@query("select event_id, left(sha256(event_type || '|' || coalesce(props, '')), 16) as idempotency_key from events")
def i45_idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", F.left(F.sha2(F.concat("event_type", F.lit("|"), F.coalesce("props", F.lit(""))), 256), F.lit(16)).alias("idempotency_key"))


@query("select o_orderkey, greatest(cast(o_totalprice as decimal(12,2)) - cast(20000 as decimal(12,2)), 0)::double as subtotal from orders")
def i46_subtotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", F.greatest(F.col("o_totalprice").cast("decimal(12,2)") - F.lit(20000).cast("decimal(12,2)"), F.lit(0)).cast("double").alias("subtotal"))


@query("select p_partkey, list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' size 12 inch for the pack'), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ('the','and','for','with','from','that','this','your','size','pack','inch','inches','oz','lb','lbs')))) as words from part")
def m02_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.sort_array(x.keywords(F.concat("p_name", F.lit(" size 12 inch for the pack")))).alias("words"))


@query("select p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as token_text from part")
def m01_token_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", x.token_text("p_brand").alias("token_text"))


@query("""with w as (select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as a, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') as b, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 3)) as wa, list_distinct(list_filter(string_split(lower(p_type), ' '), lambda w: length(w) >= 3)) as wb from part)
select p_partkey, contains(a, b) or contains(b, a) or len(list_intersect(wa, wb)) * 1.0 / greatest(1, len(wa)) >= 0.35 as matched from w""")
def m06_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does one name hold the other, or do they share 35 % of the first one's words?"""
    a, b = x.token_text("p_name"), x.token_text("p_type")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) >= 3))
    share = F.size(F.array_intersect(words("p_name"), words("p_type"))) / F.greatest(F.lit(1), F.size(words("p_name")))
    return t(spark, sf_dir, "part").select("p_partkey", (F.contains(a, b) | F.contains(b, a) | (share >= 0.35)).alias("matched"))


@query("""with d as (select page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.') as p from pages), s as (select page_id, array_to_string(p[i:], '.') as suffix from d, range(1, 10) r(i) where i <= len(p))
select page_id, count(*) filter (where suffix in ('example.com', 'example.org', 'com')) as matches from s group by 1""")
def d19_domain_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts joined to listed domains by exploded suffixes: an equi-join, not a comparison of all pairs."""
    parts = F.split(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), r"\.")
    s = t(spark, sf_dir, "pages").select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    listed = spark.range(1).select(F.explode(F.array(F.lit("example.com"), F.lit("example.org"), F.lit("com"))).alias("suffix"), F.lit(1).alias("hit"))
    return s.join(F.broadcast(listed), "suffix", "left").groupBy("page_id").agg(F.count("hit").alias("matches"))


@query("""select url, page_id from (select page_id, regexp_extract(url, '^([^?#]*)', 1) as url from pages) qualify row_number() over (partition by url order by page_id) = 1""")
def m17_dedup_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^([^?#]*)", 1).alias("url"), "page_id")
    return p.groupBy("url").agg(F.min("page_id").alias("page_id"))


def filtered(parts: DataFrame, brand: str | None = None, kind: str | None = None, least: float | None = None, most: float | None = None, search: str | None = None, sizes: list[int] | None = None) -> DataFrame:
    """Parts under every condition that is given; each reaches the scan."""
    for given, cond in (
        (brand, lambda v: F.col("p_brand") == v), (kind, lambda v: F.col("p_type") == v), (least, lambda v: F.col("p_retailprice") >= v), (most, lambda v: F.col("p_retailprice") <= v),
        (sizes, lambda v: F.col("p_size").isin(*v)), (search, lambda v: F.contains(F.lower("p_name"), F.lit(v.lower()))),
    ):
        if given is not None:
            parts = parts.where(cond(given))
    return parts


@query("select p_partkey, p_retailprice from part where p_retailprice >= 950 and p_retailprice <= 1600 and p_size in (5, 6, 7, 8, 9, 10, 20, 30) and contains(lower(p_name), 'a') order by p_retailprice desc, p_partkey limit 24")
def c02_filtered_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(t(spark, sf_dir, "part"), least=950, most=1600, search="A", sizes=[5, 6, 7, 8, 9, 10, 20, 30]).select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(24)


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as k, coalesce(json_extract_string(props, '$.missing'), 'none') as label, lower(event_type) || '-' || cast(event_id as varchar) as slug from events")
def c01_json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("label"), F.concat(F.lower("event_type"), F.lit("-"), F.col("event_id").cast("string")).alias("slug"))


@query("select p_partkey from part where contains(lower(p_name), 'al')")
def c04_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("al"))).select("p_partkey")


@query("select event_id, json_extract(props, '$.k') is not null as has_k from events")
def c07_json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"))


@query("select a.p_partkey from part a join part b on a.p_partkey = b.p_partkey + 1 where a.p_size is distinct from b.p_size")
def c09_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select("p_partkey", "p_size")
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_size").alias("b"))
    return p.join(before, "p_partkey").where(~F.col("p_size").eqNullSafe(F.col("b"))).select("p_partkey")


@query("select p_partkey, case when p_size = 0 then 'out_of_stock' when p_size <= 5 then 'low_stock' else 'in_stock' end as stock from part")
def c11_stock_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") == 0, "out_of_stock").when(F.col("p_size") <= 5, "low_stock").otherwise("in_stock").alias("stock"))


@query("""select doc_id, list_filter([case when text is null or trim(text) = '' then 'text' end, case when n_chars < 200 then 'short' end, case when lang <> 'en' then 'language' end, case when source is null then 'source' end], lambda v: v is not null) as issues from documents""")
def c12_quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(F.when(F.col("text").isNull() | (F.trim("text") == ""), "text"), F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "language"), F.when(F.col("source").isNull(), "source"))
    return t(spark, sf_dir, "documents").select("doc_id", F.array_compact(rules).alias("issues"))


@query("select doc_id, cast(floor(((text is not null)::int + (n_chars >= 200)::int + (lang = 'en')::int + (source is not null)::int + (n_chars < 10000)::int) * 100.0 / 5 + 0.5) as bigint) as score from documents")
def c13_completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = lambda cond: cond.cast("int")
    s = ok(F.col("text").isNotNull()) + ok(F.col("n_chars") >= 200) + ok(F.col("lang") == "en") + ok(F.col("source").isNotNull()) + ok(F.col("n_chars") < 10000)
    return t(spark, sf_dir, "documents").select("doc_id", F.floor(s * 100 / 5 + 0.5).alias("score"))


@query("select o_orderkey, case when o_orderstatus = 'P' then 'inactive' when o_totalprice < 50000 then 'minimum' when o_orderpriority = '5-LOW' then 'priority' else 'ok' end as reason, floor(case when o_totalprice < 50000 then 0 else least(o_totalprice * 0.1, 20000) end * 100 + 0.5) / 100 as discount from orders")
def c14_promo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    reason = F.when(F.col("o_orderstatus") == "P", "inactive").when(p < 50000, "minimum").when(F.col("o_orderpriority") == "5-LOW", "priority").otherwise("ok")
    return t(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"), half_up(F.when(p < 50000, 0).otherwise(F.least(p * 0.1, F.lit(20000.0)))).alias("discount"))


@query("select c_custkey, case when c_nationkey % 3 = 0 then 0.0 when c_acctbal < 0 then 25.0 when c_acctbal < 5000 then 15.0 else 5.0 end::double as fee from customer")
def c16_delivery_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, 0.0).when(b < 0, 25.0).when(b < 5000, 15.0).otherwise(5.0).alias("fee"))


@query("select n_nationkey as id, 2 as depth, r_name || ' > ' || n_name as breadcrumb, true as is_leaf from nation join region on n_regionkey = r_regionkey union all select r_regionkey + 100, 1, r_name, not exists (select 1 from nation where n_regionkey = r_regionkey) from region")
def l12_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.taxonomy import tree

    r = t(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"))
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 100).alias("parent_id"))
    return tree(r.unionByName(n)).select("id", "depth", F.array_join("names", " > ").alias("breadcrumb"), "is_leaf")


@query("select n_nationkey as id from nation where n_regionkey = 2 union all select 102")
def l13_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.taxonomy import descendants

    r = t(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"))
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 100).alias("parent_id"))
    return descendants(r.unionByName(n), 102)


@query("select n_name from nation where n_nationkey not in (select s_nationkey from supplier)")
def l14_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "nation").join(t(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("n_name")


@query("select user_id as sku, event_type as field, count(distinct value) > 1 as conflict from events group by 1, 2")
def l16_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sku"), F.col("event_type").alias("field"))
    return e.agg((F.min("value") != F.max("value")).alias("conflict"))


@query("""with r as (select user_id as sku, event_type as field, value, event_id % 4 as source, ts, event_id from events), f as (select sku, field, min_by(value, (source, ts, event_id)) as v, min_by(source, (source, ts, event_id)) as s from r where value >= 10 group by 1, 2), o as (select sku, field, max_by(value, (ts, event_id)) as o from r where value < 1 group by 1, 2)
select coalesce(f.sku, o.sku) as sku, coalesce(f.field, o.field) as field, coalesce(o, v) as value, case when o is null then s end as source from f full join o on f.sku = o.sku and f.field = o.field""")
def l17_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's override if it has one (the last amount below 1), else its value from the first source that has one (amounts below 10 count as blank), with where it came from."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("sku"), F.col("event_type").alias("field"), "value", (F.col("event_id") % 4).alias("source"), "ts", "event_id")
    first = F.min(F.when(F.col("value") >= 10, F.struct("source", "ts", "event_id", "value")))
    own = F.max(F.when(F.col("value") < 1, F.struct("ts", "event_id", "value")))
    best = e.groupBy("sku", "field").agg(first.alias("b"), own.alias("o")).where("b is not null or o is not null")
    return best.select("sku", "field", F.coalesce("o.value", "b.value").alias("value"), F.when(F.col("o").isNull(), F.col("b.source")).alias("source"))
