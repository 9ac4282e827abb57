"""Feeds landed as files and read back: the readers' results are the rows that were written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir
from ..sources import feeds
from .registry import query, t


@query("select cast(p_partkey as varchar) as sku, p_name as name, p_brand || ', \"' || p_type || '\"' as brand, cast(p_size as varchar) as quantity from part")
def a01_csv_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "csv")
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')).alias("brand"), F.col("p_size").cast("string").alias("quantity"))
    rows.write.csv(path, header=True, quote='"', escape='"')
    return feeds.csv(spark, path)


@query("select 'HD1' as record_type, lpad(cast(p_partkey as varchar), 12, '0') as distributor_sku, lpad(cast(p_partkey * 7919 as varchar), 12, '0') as upc, rtrim(left(p_name, 33)) as name, cast(floor(p_retailprice * 100 + 0.5) as bigint) / 100 as price, p_size / 100 as cost, p_size as quantity from part")
def a04_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "lines")
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("string")
    cells = (F.lit("HD1"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0"), F.rpad("p_name", 33, " "), F.lpad(cents, 8, "0"), F.lpad(F.col("p_size").cast("string"), 8, "0"), F.lpad(F.col("p_size").cast("string"), 6, "0"))
    t(spark, sf_dir, "part").select(F.concat(*cells).alias("value")).write.text(path)
    return feeds.fixed_width(spark, path, prefix="HD1")


@query("select p_partkey as id, p_name as name, p_retailprice as price from part")
def a07_json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "pages")
    page = t(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))).alias("items"))
    page.write.json(path)
    return feeds.json_pages(spark, path, "items", "id: bigint, name: string, price: double", lines=True)


@query("""with r as (select l_partkey as sku, p_name as name, l_extendedprice as price, cast(l_quantity as int) as quantity, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as k from lineitem join part on l_partkey = p_partkey)
select cast(sku as varchar) as sku, name, price, quantity from r where k = 1""")
def a13_register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    rows = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_partkey").cast("string").alias("SKU_NO"), F.col("p_name").alias("DESCRIPTION1"), F.lit("").alias("DESCRIPTION2"), F.concat(F.lit("$"), F.col("l_extendedprice").cast("string")).alias("LIST_PRICE"), F.col("l_quantity").cast("int").cast("string").alias("QOH"))
    return feeds.register_rows(rows, "ordinal")


@query("select p_partkey as sku, p_name || ' & <' || p_brand || '>' as name, p_retailprice as price from part")
def b12_xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "xml")
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.concat("p_name", F.lit(" & <"), "p_brand", F.lit(">")).alias("name"), F.col("p_retailprice").alias("price"))
    rows.write.format("xml").option("rootTag", "Products").option("rowTag", "Product").save(path)
    return feeds.xml_records(spark, path, "Product", "sku bigint, name string, price double")


@query("""select 'part' as source, cast(p_partkey as varchar) as distributor_sku, p_name as name, p_brand as brand, p_retailprice as price, p_size as quantity from part where trim(p_name) <> ''""")
def a02_common_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    own = feeds.to_products(p, "part", {"distributor_sku": F.col("p_partkey"), "name": F.col("p_name"), "brand": F.col("p_brand"), "price": F.col("p_retailprice"), "quantity": F.col("p_size")})
    return own.select("source", "distributor_sku", "name", "brand", "price", "quantity")
