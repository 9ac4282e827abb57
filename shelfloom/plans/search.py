"""Search results, name and payload work, cohorts, metrics: further operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x
from .registry import half_up, query, t

#: Shops by tier: fixed values.
TIERS = {
    "major_retailer": ("amazon.com", "walmart.com", "target.com", "chewy.com", "petco.com", "petsmart.com", "tractorsupply.com", "homedepot.com", "lowes.com", "acehardware.com", "costco.com", "summitracing.com"),
    "secondary_retailer": ("berings.com", "farmstore.com", "hugglepets.co.uk", "mickeyspetsupplies.com", "rachelspetsupply.com", "animalproductsshop.com", "petedge.com", "animalsupply.com", "phillipspet.com", "frontiercoop.com", "petsuppliesplus.com", "bradleycaldwell.com", "petswarehouse.com"),
    "marketplace": ("ebay.com",),
}
#: Parts of addresses of listings, and path segments that name one: fixed values.
CATEGORY_PARTS = ("/collections/", "/category/", "/categories/", "/search", "/products?", "/collections?", "/product-line/", "/product-lines/", "/product-range/", "/our-products/", "/all-products/", "/store-locator", "/where-to-buy", "/find-a-store", "/find-a-retailer")
LISTING_SEGMENTS = ("all", "all-products", "bestseller", "bestsellers", "browse", "categories", "category", "collections", "new-products", "our-products", "products", "search", "shop-all", "where-to-buy")
RANGE_ROOTS = ("our-products", "product-range", "product-lines", "product-line")
#: Words and phrases of poor results, each as a pattern between word borders: fixed values.
LOW_QUALITY = (
    "review", "best", "top 10", "comparison", "vs", "reddit", "pinterest", "youtube", "facebook", "instagram", "tiktok", "affiliate", "coupon", "deal(?:s)?", "blog", "forum", "gift guide", "buying guide", "top picks", "best toys", "best dog toys",
    "upc database", "barcode search", "gtin search", "product lookup", "where to buy", "find a store", "store locator", "find a retailer", "find a dealer", r"\d+ best", r"picks for \d{4}",
)
POOR_WORDS = rf"\b(?:{'|'.join(LOW_QUALITY)})\b"
#: The same for Spark, whose \b takes é or ß for a part of a word: borders are those of ASCII words, as in SQL.
_POOR = rf"(?<!\w)(?:{'|'.join(LOW_QUALITY)})(?!\w)"
#: Words of which one rules out the others: fixed values.
LEXICAL_GROUPS = ({"bulk": "bulk", "packet": "packet", "packets": "packet"}, {"dog": "dog", "cat": "cat"})
#: Misspelt product types: fixed values.
CORRECTIONS = {"apparrel": "Apparel", "beeding & litter": "Bedding & Litter", "vitsamins & supplements": "Vitamins & Supplements"}

# Results of searches, made of pages: hosts of all tiers in turn, and addresses of all shapes
_HOSTS = ("www.chewy.com", "shop.petedge.com", "ebay.com", "acme.com", "notebay.com", "store.acme.com")
_PATHS = ("/products/cat-litter/pea-husk", "/collections/dog", "/p/dog-bulk", "/our-products/flea", "/search", "/best-cat-packets", "/a/b/c/d", "/", "/brands/acme/line", "/shop-all")
_list = lambda v: "[" + ", ".join(f"'{i}'" for i in v) + "]"
RESULTS_SQL = f"results as (select page_id, ({_list(_HOSTS)})[page_id % {len(_HOSTS)} + 1] as host, ({_list(_PATHS)})[page_id % {len(_PATHS)} + 1] as path from pages)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (F.col("page_id") % len(v) + 1).cast("int"))
    return t(spark, sf_dir, "pages").select("page_id", pick(_HOSTS).alias("host"), pick(_PATHS).alias("path"))


def within(host: Column, domains: tuple[str, ...]) -> Column:
    """Is the host one of the domains or below one? The host's own suffixes are looked up, at most four."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.arrays_overlap(suffixes, F.array(*map(F.lit, domains)))


def tier(host: Column, brand: Column) -> Column:
    """Tier of a host: the brand's own, a known shop's, or unknown."""
    official = F.contains(F.regexp_replace(F.lower(host), "[^a-z0-9.]", ""), F.concat(x.token_text(brand), F.lit(".")))
    out = F.when(official, "official")
    for name, domains in TIERS.items():
        out = out.when(within(host, domains), name)
    return out.otherwise("unknown")


_TIER_SQL = "case when contains(host, 'acme.') then 'official' " + " ".join(f"when {' or '.join(f'''host = '{d}' or host like '%.{d}' ''' for d in v)} then '{k}'" for k, v in TIERS.items()) + " else 'unknown' end"


@query(f"with {RESULTS_SQL} select page_id, {_TIER_SQL} as tier from results")
def m09_domain_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("page_id", tier(F.col("host"), F.lit("Acme")).alias("tier"))


#: What an address's path says of its page. A row holds if all its patterns match: "written" ones the path as it is, others its segments, /a/b/c without empty ones.
PATH_SHAPES = (
    ("listing", "written", "|".join(p.replace("?", r"\?") for p in CATEGORY_PARTS)),
    ("listing", "segments", rf"/({'|'.join(LISTING_SEGMENTS)})$"),
    ("listing", "segments", rf"^/(products|collections)/({'|'.join(LISTING_SEGMENTS)})(/|$)"),
    ("listing", "segments", "^/(s|search)$"),
    ("listing", "segments", "^/pages(/[^/]+)?$"),
    ("listing", "segments", "/c(/|$)", "^(/[^/]+){4}"),
    ("line", "segments", "^/(products|brands)(/[^/]+){2}"),
    ("line", "segments", rf"^/({'|'.join(RANGE_ROOTS)})/"),
    ("root", "segments", "^$"),
)


def path_kinds(path: Column, host: Column) -> Column:
    """The kinds of page that an address's path has the shape of; known shops have no product lines."""
    written = F.lower(F.coalesce(path, F.lit("")))
    forms = {"written": written, "segments": F.rtrim(F.regexp_replace(written, "/+", "/"), F.lit("/"))}
    shop = within(host, TIERS["major_retailer"] + TIERS["secondary_retailer"])
    kinds = []
    for kind, form, *patterns in PATH_SHAPES:
        holds = ~shop if kind == "line" else F.lit(True)
        for p in patterns:
            holds = holds & forms[form].rlike(p)
        kinds.append(F.when(holds, kind))
    return F.array_distinct(F.array_compact(F.array(*kinds)))


_TRUSTED_SQL = " or ".join(f"host = '{d}' or host like '%.{d}'" for d in TIERS["major_retailer"] + TIERS["secondary_retailer"])
#: SQL: the same shapes, by segments.
_SEG = "list_filter(string_split(lower(path), '/'), lambda s: s <> '')"
_CATEGORY_SQL = f"coalesce({' or '.join(f'''contains(lower(path), '{p}')''' for p in CATEGORY_PARTS)} or (list_contains(s, 'c') and len(s) >= 4) or (s[1] = 'pages' and len(s) <= 2) or list_contains({_list(LISTING_SEGMENTS)}, s[len(s)]) or (s[1] in ('products', 'collections') and list_contains({_list(LISTING_SEGMENTS)}, s[2])) or (len(s) = 1 and s[1] in ('s', 'search')), false)"
_LINE_SQL = f"coalesce((s[1] in ('products', 'brands') and len(s) >= 3) or (list_contains({_list(RANGE_ROOTS)}, s[1]) and len(s) >= 2), false) and not ({_TRUSTED_SQL})"


@query(f"with {RESULTS_SQL}, r as (select *, {_SEG} as s from results) select page_id, {_CATEGORY_SQL} as category_like, {_LINE_SQL} as product_line from r")
def m10_url_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = path_kinds(F.col("path"), F.col("host"))
    return results(spark, sf_dir).select("page_id", F.array_contains(kinds, "listing").alias("category_like"), F.array_contains(kinds, "line").alias("product_line"))


def poor_words(text: Column, listing: Column, line: Column) -> Column:
    """Is a result poor? Listings are, product lines are not, others by the words of their text, hyphens as blanks."""
    return F.when(listing, True).when(line, False).otherwise(F.regexp_replace(text, "-", " ").rlike(_POOR))


@query(f"with {RESULTS_SQL}, r as (select *, {_SEG} as s from results) select page_id, case when {_CATEGORY_SQL} then true when {_LINE_SQL} then false else regexp_matches(replace(path, '-', ' '), '{POOR_WORDS}') end as low_quality from r")
def m16_low_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings are poor results, product lines are not, others are if their words say so."""
    path, host = F.col("path"), F.col("host")
    kinds = path_kinds(path, host)
    poor = poor_words(path, F.array_contains(kinds, "listing"), F.array_contains(kinds, "line"))
    return results(spark, sf_dir).select("page_id", poor.alias("low_quality"))


def lexical_adjustment(expected: Column, actual: Column) -> Column:
    """One point for each group of words in which both agree, three off where the actual words are others of the group."""
    total = F.lit(0.0)
    for group in LEXICAL_GROUPS:
        same = F.create_map(*(F.lit(v) for pair in group.items() for v in pair))
        kinds = lambda w, same=same: F.array_distinct(F.array_compact(F.transform(w, lambda v: F.try_element_at(same, v))))
        e, a = kinds(expected), kinds(actual)
        total = total + F.when(F.size(e) == 0, 0.0).when(F.arrays_overlap(e, a), 1.0).when(F.size(a) > 0, -3.0).otherwise(0.0)
    return total


@query(f"with {RESULTS_SQL}, w as (select page_id, regexp_extract_all(path, '[a-z0-9]+') as w from results) select page_id, case when list_contains(w, 'dog') then 1.0 when list_contains(w, 'cat') then -3.0 else 0.0 end + case when list_has_any(w, ['bulk']) then 1.0 when list_has_any(w, ['packet', 'packets']) then -3.0 else 0.0 end as adjustment from w")
def m15_lexical_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = F.regexp_extract_all(F.col("path"), F.lit("[a-z0-9]+"), F.lit(0))
    return results(spark, sf_dir).select("page_id", lexical_adjustment(F.array(F.lit("dog"), F.lit("bulk")), actual).alias("adjustment"))


@query("""with w as (select user_id, count(*) as n, count(*) filter (where event_type <> 'error') as wins from events group by 1) select user_id, case when n < 3 then 0.5 else wins * 1.0 / n end > 0.8 as trusted, case when n < 3 then 0.0 when wins * 1.0 / n > 0.8 then 3.0 when wins * 1.0 / n < 0.3 then -3.0 else 0.0 end as bonus from w""")
def m14_success_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rates as of a snapshot: one half below three attempts; three points up above 0.8, down below 0.3."""
    w = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("wins"))
    rate = F.when(F.col("n") < 3, 0.5).otherwise(F.col("wins") / F.col("n"))
    return w.select("user_id", (rate > 0.8).alias("trusted"), F.when(rate > 0.8, 3.0).when(rate < 0.3, -3.0).otherwise(0.0).alias("bonus"))


def weight_in_pounds(v: Column) -> Column:
    """The first number of a text with its unit, in pounds with two decimals (pounds without a unit); a text without a number stays."""
    p = r"(?i)(\d+(?:\.\d+)?)\s*(lbs|lb|oz|kg|g)?"
    n, unit = F.regexp_extract(v, p, 1).try_cast("double"), F.lower(F.regexp_extract(v, p, 2))
    return F.when(n.isNull(), v).otherwise(F.format_string("%.2f", F.when(unit == "oz", n / 16.0).when(unit == "kg", n * 2.20462).when(unit == "g", n * 0.00220462).otherwise(n)))


@query("select p_partkey, case p_size % 4 when 0 then printf('%.2f', p_size / 16.0) when 1 then printf('%.2f', p_size * 2.20462) when 2 then printf('%.2f', p_size::double) else 'unknown' end as weight from part")
def i04_extract_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    v = F.when(k == 0, F.concat(F.lit("Weight: "), n, F.lit(" OZ"))).when(k == 1, F.concat(n, F.lit("kg"))).when(k == 2, F.concat(n, F.lit(" lbs"))).otherwise("unknown")
    return t(spark, sf_dir, "part").select("p_partkey", weight_in_pounds(v).alias("weight"))


@query("""select p_partkey, upper(p_type[1]) || lower(p_type[2:5]) || ' ' || cast(p_size as varchar) || ' lb. ' || case when p_size % 2 = 0 then '2 X 4 ft.' else '5.57 oz.' end as name from part""")
def i12_product_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in canonical form: case, sizes, units and decimals (I09 to I12 together)."""
    tail = F.when(F.col("p_size") % 2 == 0, "2x4 feet").otherwise("5.567 Ounces")
    raw = F.concat(F.lower(F.substring("p_type", 1, 5)), F.lit("  "), F.col("p_size").cast("string"), F.lit("lbs "), tail)
    return t(spark, sf_dir, "part").select("p_partkey", x.product_name(raw).alias("name"))


@query("select p_partkey, 'Small ' || p_brand || ' Black Chicken' as name from part")
def i08_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", x.expanded(F.concat(F.lit("sm "), "p_brand", F.lit(" blk chkn"))).alias("name"))


@query("select p_partkey, string_split(p_type, ' ')[1] || ', ' || p_brand as words from part")
def i13_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords between commas, semicolons, pipes and line ends; the first spelling of each stays."""
    first = F.element_at(F.split("p_type", " "), 1)
    return t(spark, sf_dir, "part").select("p_partkey", x.keyword_list(F.concat(first, F.lit("; "), "p_brand", F.lit(" |"), F.lower(first), F.lit("\n,"), F.upper("p_brand"))).alias("words"))


@query("select p_partkey, p_brand || '|' || string_split(p_type, ' ')[1] as facet from part")
def i17_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.element_at(F.split("p_type", " "), 1)
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(x.pipe_values(F.concat(F.lit(" "), "p_brand", F.lit("||"), first, F.lit(" | "), F.lower("p_brand"))), "|").alias("facet"))


@query("select p_partkey, case p_size % 3 when 0 then 'Apparel' when 1 then 'Bedding & Litter' else p_type end as product_type from part")
def i19_typo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(*(F.lit(v) for pair in CORRECTIONS.items() for v in pair))
    v = F.when(F.col("p_size") % 3 == 0, " Apparrel").when(F.col("p_size") % 3 == 1, "BEEDING &  Litter").otherwise(F.col("p_type"))
    return t(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(known, F.lower(x.collapsed(v))), x.collapsed(v)).alias("product_type"))


@query("with u as (select user_id, count(*) as attempts, count(*) filter (where event_type = 'view') * 1.0 / count(*) as rate from events group by 1) select user_id, case when attempts >= 5 and rate >= 0.6 then 'high' when attempts >= 3 and rate >= 0.4 then 'medium' else 'low' end as confidence from u")
def i38_confidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rate = F.count("*"), F.count_if(F.col("event_type") == "view") / F.count("*")
    tiers = F.when((n >= 5) & (rate >= 0.6), "high").when((n >= 3) & (rate >= 0.4), "medium").otherwise("low")
    return t(spark, sf_dir, "events").groupBy("user_id").agg(tiers.alias("confidence"))


@query("select event_id, case when event_type = 'error' then 'extraction_timeout' when props is null then 'missing_fields' when value < 50 then 'wrong_product' when value < 80 then 'brand_mismatch' else 'low_confidence' end as failure from events")
def i31_failure_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cause that applies: a timeout, fields missing, a low product score, a low brand score, else low confidence."""
    message = F.lower(F.when(F.col("event_type") == "error", "Request TIMED OUT").otherwise(""))
    cause = F.when(message.rlike("timeout|timed out"), "extraction_timeout").when(F.col("props").isNull(), "missing_fields").when(F.col("value") / 100 < 0.5, "wrong_product").when(F.col("value") / 100 < 0.8, "brand_mismatch")
    return t(spark, sf_dir, "events").select("event_id", cause.otherwise("low_confidence").alias("failure"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def i14_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that stands alone, in a fenced block, or between the outermost braces of a text."""
    kind, fence = F.col("event_id") % 3, "`" * 3
    raw = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit(f"Here:\n{fence}json\n"), "props", F.lit(f"\n{fence}"))).otherwise(F.concat(F.lit("The answer is "), "props", F.lit(" as asked.")))
    tries = (raw, F.regexp_extract(raw, rf"(?s){fence}(?:json)?\s*(.*?){fence}", 1), F.regexp_extract(raw, r"(?s)(\{.*\})", 1))
    return t(spark, sf_dir, "events").select("event_id", F.coalesce(*(F.variant_get(F.try_parse_json(F.nullif(v, F.lit(""))), "$.k", "long") for v in tries)).alias("k"))


@query("select p_partkey, p_brand || ' > ' || p_type as first, case when p_size % 2 = 0 then 1 else 2 end::int as n from part")
def l11_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadcrumbs between pipes with one blank around each sign; equal ones once, empty ones not."""
    v = F.concat(F.lit(" "), "p_brand", F.lit(">  "), "p_type", F.lit(" | |"), "p_brand", F.when(F.col("p_size") % 2 == 0, " > ").otherwise(" > x "), "p_type")
    crumbs = F.array_distinct(F.filter(F.transform(F.split(v, r"\|"), lambda e: x.collapsed(F.regexp_replace(e, r"\s*>\s*", " > "))), lambda e: e != ""))
    return t(spark, sf_dir, "part").select("p_partkey", F.get(crumbs, F.lit(0)).alias("first"), F.size(crumbs).alias("n"))


@query("select event_id, case when json_extract_string(props, '$.k') is null then 0 else 1 end::int as fields, coalesce(json_extract_string(props, '$.k'), '') <> '' as meaningful from events")
def l04_meaningful_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload without diagnostic keys (L05), and whether any value that is left says something (L04)."""
    payload = F.map_concat(F.create_map(F.lit("Confidence_Notes"), F.lit("x"), F.lit("blank"), F.lit("  ")), F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")))
    kept = F.map_filter(payload, lambda k, v: ~F.lower(k).isin("confidence_notes", "scraped_at") & (F.trim(F.coalesce(v, F.lit(""))) != ""))
    return t(spark, sf_dir, "events").select("event_id", F.size(kept).alias("fields"), (F.size(kept) > 0).alias("meaningful"))


@query("select event_id, case when user_id % 2 = 0 then event_type = 'error' else event_type = 'purchase' end as passing from events")
def c21_is_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real code passes by success, a fake one by finding nothing."""
    kind = F.when(F.col("user_id") % 2 == 0, "fake").otherwise("test")
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "no_results").otherwise("not_found")
    return t(spark, sf_dir, "events").select("event_id", F.when(kind == "fake", outcome == "no_results").otherwise(outcome == "success").alias("passing"))


@query("select event_id as retry_id, cast(value as double) as retries from events where event_type = 'error' and ts <= timestamp '2024-01-20' and event_id % 5 < 3 order by ts, event_id % 5, event_id limit 10")
def g04_due_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten retries that are due first and have attempts left, as of a moment."""
    tries = F.col("event_id") % 5
    due = t(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp")) & (tries < 3))
    return due.orderBy("ts", tries, "event_id").limit(10).select(F.col("event_id").alias("retry_id"), F.col("value").cast("double").alias("retries"))


@query("""with n as (select o_custkey as job, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as r, count(*) over (partition by o_custkey) as n from orders), s as (select job, o_orderkey, case when r < (n % ((n + 2) // 3)) * (n // ((n + 2) // 3) + 1) then r // (n // ((n + 2) // 3) + 1) else (n % ((n + 2) // 3)) + (r - (n % ((n + 2) // 3)) * (n // ((n + 2) // 3) + 1)) // (n // ((n + 2) // 3)) end as slice from n)
select job, slice, site_group, count(*) as units from s cross join (values ('fast'), ('slow')) g(site_group) group by 1, 2, 3""")
def o08_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's codes in balanced slices of three at most, each slice for each group of sites, with its units of work."""
    w = Window.partitionBy("job")
    n = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), "o_orderkey").withColumn("r", F.row_number().over(w.orderBy("o_orderkey")) - 1).withColumn("n", F.count("*").over(w))
    slices = F.floor((F.col("n") + 2) / 3)
    least, longer = F.floor(F.col("n") / slices), F.col("n") % slices
    own = F.when(F.col("r") < longer * (least + 1), F.floor(F.col("r") / (least + 1))).otherwise(longer + F.floor((F.col("r") - longer * (least + 1)) / least))
    return n.withColumn("slice", own.cast("long")).groupBy("job", "slice").agg(F.count("*").alias("units")).select("job", "slice", F.explode(F.array(F.lit("fast"), F.lit("slow"))).alias("site_group"), "units")


@query("""with w as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda v: length(v) > 0)) as w from benchmark union all select item_id + 100000, list_distinct(regexp_extract_all(lower(text), '[a-z]+'))[1:20] from benchmark)
select a.item_id, count(b.item_id) as holders from w a left join w b on b.item_id <> a.item_id and len(list_intersect(a.w, b.w)) * 10 > 8 * len(a.w) where len(a.w) > 0 group by 1""")
def r26_duplicate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other texts hold over 80 % of a text's words? Cut texts stand beside the whole ones.

    A text that another holds to that share lacks at most a fifth of its words there, so one of its rarest floor(n / 5) + 1
    words is shared: only those are joined, and each pair found is counted exactly.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    b = t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), words.alias("w"))
    texts = b.union(b.select(F.col("item_id") + 100000, F.slice("w", 1, 20))).where(F.size("w") > 0)
    each = texts.select("item_id", F.size("w").alias("n"), F.explode("w").alias("v"))
    ranked = each.join(each.groupBy("v").agg(F.count("*").alias("held")), "v").withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("held", "v")))
    near = ranked.where(F.col("r") <= F.floor(F.col("n") / 5) + 1).select("item_id", "v").join(each.select(F.col("item_id").alias("other"), "v"), "v").where("item_id <> other").select("item_id", "other").distinct()
    both = near.join(texts, "item_id").join(texts.select(F.col("item_id").alias("other"), F.col("w").alias("o")), "other")
    hit = both.where(F.size(F.array_intersect("w", "o")) * 10 > F.size("w") * 8).groupBy("item_id").agg(F.count("*").alias("holders"))
    return texts.select("item_id").join(hit, "item_id", "left").select("item_id", F.coalesce("holders", F.lit(0)).alias("holders"))


@query("""with d as (select doc_id, lang, case when regexp_matches(text, '(^|\\n)[-*] ') then case when regexp_matches(text, '[.!?]') then 'mixed' else 'bullet' end else 'prose' end as structure, len(regexp_extract_all(text, '[A-Za-z]+')) as words from documents where text is not null), m as (select lang, structure, count(*) as n from d group by 1, 2), k as (select lang, structure as mode from m qualify row_number() over (partition by lang order by n desc, structure) = 1), q as (select lang, median(words) as mid from d group by 1)
select doc_id, d.structure <> k.mode as other_structure, abs(words - mid) > 0.5 * mid as off_median from d join k on d.lang is not distinct from k.lang join q on d.lang is not distinct from q.lang""")
def p07_format_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose structure is not their group's most frequent one, or whose length is over half the group's median away from it."""
    s = F.when(F.col("text").rlike(r"(^|\n)[-*] "), F.when(F.col("text").rlike("[.!?]"), "mixed").otherwise("bullet")).otherwise("prose")
    d = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", s.alias("structure"), F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("words"))
    mode = d.groupBy("lang", "structure").count().groupBy("lang").agg(F.min_by("structure", F.struct(-F.col("count"), "structure")).alias("mode"))
    # the median of distinct lengths with their numbers: the state of a group is its lengths, not its rows
    mid = d.groupBy("lang", "words").count().groupBy("lang").agg(F.expr("percentile(words, 0.5, count)").alias("mid"))
    g = mode.join(mid, mode["lang"].eqNullSafe(mid["lang"])).select(mode["lang"].alias("g"), "mode", "mid")
    return d.join(g, F.col("lang").eqNullSafe(F.col("g"))).select("doc_id", (F.col("structure") != F.col("mode")).alias("other_structure"), (F.abs(F.col("words") - F.col("mid")) > 0.5 * F.col("mid")).alias("off_median"))


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a and b joined by keys. Repeated keys, or keys that one side lacks, are an error that says how many."""
    both = a.groupBy(*keys).agg(F.count("*").alias("__a")).join(b.groupBy(*keys).agg(F.count("*").alias("__b")), keys, "full_outer")
    lone, twice = both.agg(F.count_if(F.col("__a").isNull() | F.col("__b").isNull()), F.count_if((F.col("__a") > 1) | (F.col("__b") > 1))).first()
    if lone or twice:
        raise ValueError(f"{lone} keys are on one side only, {twice} are repeated")
    return a.join(b, keys)


@query("with a as (select o_custkey, max(o_totalprice) as a, avg(o_totalprice) as b from orders group by 1) select o_custkey, case when b * 2 > a then 'win' when b * 2 < a then 'loss' else 'tie' end as outcome from a")
def d17_paired_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").groupBy("o_custkey")
    j = paired(o.agg(F.max("o_totalprice").alias("a")), o.agg(F.avg("o_totalprice").alias("b")), ["o_custkey"])
    return j.select("o_custkey", F.when(F.col("b") * 2 > F.col("a"), "win").when(F.col("b") * 2 < F.col("a"), "loss").otherwise("tie").alias("outcome"))


@query("select user_id as scraper, count(*) as extractions, count(*) filter (where event_type <> 'error') as successes, cast(sum(cast(value as decimal(12,2))) as double) as cost, max(ts) as last_run from events group by 1")
def e41_extraction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scraper"))
    return e.agg(F.count("*").alias("extractions"), F.count_if(F.col("event_type") != "error").alias("successes"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("cost"), F.max("ts").alias("last_run"))


@query("""select 'site' as dimension, cast(user_id % 7 as varchar) as key, count(*) as n, count(*) filter (where event_type = 'error') as failed from events group by 2 union all select 'mode', event_type, count(*), count(*) filter (where event_type = 'error') from events group by 2""")
def e43_extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions by site and by mode in one pass: rows are unpivoted and counted once."""
    long = t(spark, sf_dir, "events").select("event_type", F.inline(F.array(F.struct(F.lit("site").alias("dimension"), (F.col("user_id") % 7).cast("string").alias("key")), F.struct(F.lit("mode").alias("dimension"), F.col("event_type").alias("key")))))
    return long.groupBy("dimension", "key").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("""with v as (select p_brand as cohort, 'size' as field, cast(p_size as varchar) as value, p_partkey from part) select cohort, field, value, count(*) as n, list_sort(list(p_partkey)) as skus from v group by 1, 2, 3""")
def e29_cohort_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes behind each value of a cohort's field."""
    v = t(spark, sf_dir, "part").select(F.col("p_brand").alias("cohort"), F.lit("size").alias("field"), F.col("p_size").cast("string").alias("value"), "p_partkey")
    return v.groupBy("cohort", "field", "value").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("skus"))


@query("""with f as (select p_partkey as sku, unnest(['brand', 'size']) as field, unnest([p_brand = 'Brand#11', p_size > 25]) as ok from part) select sku, count(*) as fields, floor(count(*) filter (where ok) * 1.0 / count(*) * 1000 + 0.5) / 1000 as accuracy, bool_and(ok) as complete from f group by 1""")
def r04_sku_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code's share of fields that are right, and whether all are (R03 decides by field, R05 averages)."""
    f = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.inline(F.array(F.struct(F.lit("brand").alias("field"), (F.col("p_brand") == "Brand#11").alias("ok")), F.struct(F.lit("size").alias("field"), (F.col("p_size") > 25).alias("ok")))))
    return f.groupBy("sku").agg(F.count("*").alias("fields"), half_up(F.count_if("ok") / F.count("*"), 3).alias("accuracy"), F.bool_and("ok").alias("complete"))


@query("select p_brand as category, case when p_size <= 15 then 'easy' when p_size <= 35 then 'medium' else 'hard' end as difficulty, count(*) as n, floor(count(*) filter (where p_retailprice > 1200) * 1.0 / count(*) * 10000 + 0.5) / 10000 as accuracy from part group by 1, 2")
def r07_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = F.when(F.col("p_size") <= 15, "easy").when(F.col("p_size") <= 35, "medium").otherwise("hard")
    return t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category"), hard.alias("difficulty")).agg(F.count("*").alias("n"), half_up(F.count_if(F.col("p_retailprice") > 1200) / F.count("*"), 4).alias("accuracy"))


@query("select o_orderpriority as experiment, case when count(*) filter (where o_totalprice > 200000) * 1.0 / count(*) < 0.01 then 'stop' else 'continue' end as decision from orders group by 1")
def r23_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.count_if(F.col("o_totalprice") > 200000) / F.count("*")
    return t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("experiment")).agg(F.when(p < 0.01, "stop").otherwise("continue").alias("decision"))
