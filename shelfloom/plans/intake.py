"""What comes in and goes out: adapters of feeds, checks of datasets, exports; and further reading of pages and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..session import fresh_dir
from ..sources import feeds
from .registry import query, t

#: Spellings of a sku column, the first that is there counts: fixed values.
SKU_NAMES = ("SKU", "SKU_NO", "sku", "sku_no", "Sku", "SKU NO", "sku no")
#: Fields that an entry of a dataset needs, and its difficulties: fixed values.
ENTRY_FIELDS = ("query", "expected_source_url", "category", "difficulty", "rationale")
DIFFICULTIES = ("easy", "medium", "hard")


def csv_products(spark: SparkSession, path: str) -> DataFrame:
    """A supplier's CSV feed in the common shape; numbers are read leniently, 0 where none stands."""
    number = lambda c: F.coalesce(feeds.leading_number(F.col(c)), F.lit(0.0))
    df = feeds.csv(spark, path)
    return feeds.to_products(df, "csv", {"distributor_sku": F.col("`Item #`"), "upc": F.col("UPC"), "name": F.col("Description"), "brand": F.col("Brand"), "price": number("Retail Price"), "cost": number("Net Cost"), "quantity": number("Qty Avail").cast("int")})


def line_products(spark: SparkSession, path: str) -> DataFrame:
    df = feeds.fixed_width(spark, path, prefix="HD1")
    return feeds.to_products(df, "lines", {c: F.col(c) for c in ("distributor_sku", "upc", "name", "price", "cost", "quantity")})


def json_products(spark: SparkSession, path: str) -> DataFrame:
    df = feeds.json_pages(spark, path, "items", "sku: string, name: string, brand: string, price: double", lines=True)
    return feeds.to_products(df, "json", {"distributor_sku": F.col("sku"), "name": F.col("name"), "brand": F.col("brand"), "price": F.col("price")})


#: Readers of feeds by kind.
ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"csv": csv_products, "lines": line_products, "json": json_products}


def feed(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A landed feed in the common shape; an unknown kind is an error."""
    if kind not in ADAPTERS:
        raise ValueError(f"no adapter reads feeds of kind {kind}")
    return ADAPTERS[kind](spark, path)


def _landed_csv(spark: SparkSession, sf_dir: str) -> str:
    path, p = fresh_dir(spark, "csv"), t(spark, sf_dir, "part")
    p.select(F.col("p_partkey").cast("string").alias("Item #"), F.lit("").alias("UPC"), F.concat("p_name", F.lit(', "big"')).alias("Description"), F.col("p_brand").alias("Brand"), F.concat(F.col("p_retailprice").cast("string"), F.lit(" USD")).alias("Retail Price"), F.lit("n/a").alias("Net Cost"), F.col("p_size").cast("string").alias("Qty Avail")).write.csv(path, header=True, quote='"', escape='"')
    return path


@query("""select cast(p_partkey as varchar) as distributor_sku, p_name || ', "big"' as name, p_brand as brand, p_retailprice as price, 0.0::double as cost, p_size as quantity from part""")
def a10_csv_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, "csv", _landed_csv(spark, sf_dir)).select("distributor_sku", "name", "brand", "price", "cost", "quantity")


@query("""select 'csv' as source, cast(p_partkey as varchar) as distributor_sku, p_name || ', "big"' as name, p_retailprice as price from part union all select 'lines', lpad(cast(s_suppkey as varchar), 12, '0'), trim(s_name), 12.5 from supplier union all select 'json', cast(c_custkey as varchar), c_name, c_acctbal from customer""")
def a11_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of three kinds, each by its adapter, in one shape."""
    lines, pages = fresh_dir(spark, "lines"), fresh_dir(spark, "pages")
    cells = (F.lit("HD1"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0"), F.lit(" " * 12), F.rpad("s_name", 33, " "), F.lit("00001250"), F.lit("00000000"), F.lit("000000"))
    t(spark, sf_dir, "supplier").select(F.concat(*cells).alias("value")).write.text(lines)
    items = F.array(F.struct(F.col("c_custkey").cast("string").alias("sku"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("price")))
    t(spark, sf_dir, "customer").select(items.alias("items")).write.json(pages)
    every = [feed(spark, kind, path) for kind, path in (("csv", _landed_csv(spark, sf_dir)), ("lines", lines), ("json", pages))]
    return every[0].unionByName(every[1]).unionByName(every[2]).select("source", "distributor_sku", "name", "price")


def sku_rows(df: DataFrame) -> DataFrame:
    """Rows with a sku, under the first of its spellings, and all other columns as trimmed text, empty where null; no such column is an error."""
    name = next((n for n in SKU_NAMES if n in df.columns), None)
    if name is None:
        raise ValueError(f"none of {', '.join(df.columns)} is a sku column")
    text = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    return df.where(text(name) != "").select(text(name).alias("SKU"), *(text(c).alias(c) for c in df.columns if c != name and c != "SKU"))


@query("select cast(p_partkey as varchar) as \"SKU\", p_name as name, case when p_size > 10 then p_brand else '' end as brand from part where p_size <> 20")
def a14_sku_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "skus")
    p = t(spark, sf_dir, "part")
    p.select(F.when(F.col("p_size") != 20, F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" "))).alias("SKU NO"), F.concat(F.lit(" "), "p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand")).write.csv(path, header=True)
    return sku_rows(feeds.csv(spark, path))


def entry_errors(entries: DataFrame, place: str) -> DataFrame:
    """place, field, message of every fault of a dataset's entries: missing fields, addresses, difficulties, and queries that an earlier entry holds."""
    tests = [F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"), F.lit("missing").alias("message"))) for f in ENTRY_FIELDS]
    address = F.col("expected_source_url")
    tests.append(F.when((address != "") & ~address.rlike("(?i)^https?://.+$"), F.struct(F.lit("expected_source_url").alias("field"), F.lit("not an address").alias("message"))))
    tests.append(F.when((F.col("difficulty") != "") & ~F.col("difficulty").isin(*DIFFICULTIES), F.struct(F.lit("difficulty").alias("field"), F.lit("unknown").alias("message"))))
    own = entries.select(place, F.inline(F.array_compact(F.array(*tests))))
    named = entries.where("query <> ''")
    first = named.groupBy("query").agg(F.min(place).alias("first"))
    again = named.select(place, "query").join(first, "query").where(F.col(place) > F.col("first")).select(place, F.lit("query").alias("field"), F.lit("repeated").alias("message"))
    return own.unionByName(again)


@query("""with f as (select p_name, min(p_partkey) as k from part group by 1) select p_partkey, 'difficulty' as field, 'unknown' as message from part where p_type = 'PROMO' union all select p_partkey, 'expected_source_url', 'not an address' from part where p_size < 10 union all select p_partkey, 'rationale', 'missing' from part where p_size > 40 union all select p_partkey, 'query', 'repeated' from part join f using (p_name) where p_partkey > k""")
def a18_dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = t(spark, sf_dir, "part"), F.col("p_size")
    entries = p.select("p_partkey", F.col("p_name").alias("query"), F.when(size < 10, "ftp://a.com").otherwise("HTTPS://a.com/x").alias("expected_source_url"), F.col("p_brand").alias("category"), F.when(F.col("p_type") == "PROMO", "odd").otherwise("easy").alias("difficulty"), F.when(size <= 40, "why").alias("rationale"))
    return entry_errors(entries, "p_partkey")


@query("""select p_partkey as sku, p_name || ' "x", y' as name, p_retailprice as price from part""")
def b13_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows exported by all tasks as CSV files and read back: a workbook would be one stream."""
    path = fresh_dir(spark, "export")
    t(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.concat("p_name", F.lit(' "x", y')).alias("name"), F.col("p_retailprice").alias("price")).write.csv(path, header=True, quote='"', escape='"')
    return spark.read.schema("sku bigint, name string, price double").csv(path, header=True, quote='"', escape='"')


@query("select p_partkey, cast(p_size as varchar) || ' lb. and ' || cast(p_size as varchar) || '.5 oz. of 3 L' as units, '2 X 4 X ' || cast(p_size as varchar) || ' in' as sizes from part")
def i10_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in one spelling, decimals of two places at most; signs between sizes as words."""
    n = F.col("p_size").cast("string")
    return t(spark, sf_dir, "part").select("p_partkey", x.written(F.concat(n, F.lit(" Pounds and "), n, F.lit(".50 ounces of 3 liters"))).alias("units"), x.sized(F.concat(F.lit("2in x4 × "), n, F.lit(" in"))).alias("sizes"))


@query(r"select page_id, lower(trim(regexp_replace(regexp_replace(url || ' ' || left(html, 400), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_')) as key from pages")
def i24_snake_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in snake case: humps and signs are borders, none stay at the ends. The beginnings of pages have signs of all kinds."""
    raw = F.concat("url", F.lit(" "), F.left("html", F.lit(400)))
    words = F.regexp_replace(F.regexp_replace(raw, "(?<=[a-z0-9])(?=[A-Z])", "_"), "[^A-Za-z0-9]+", "_")
    return t(spark, sf_dir, "pages").select("page_id", F.lower(F.btrim(words, F.lit("_"))).alias("key"))
