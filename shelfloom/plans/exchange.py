"""Documents and workbooks exchanged with shops and registers, written by all tasks and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir
from ..sources import exchange as xc
from ..sources import feeds
from ..sources import workbook as wb
from .registry import query, t


@query("""select p_partkey as sku, p_name || ' & <' || p_brand || '> "x"' as name, p_retailprice as price, case when p_partkey % 4 = 0 then null else '<p>' || p_type || ' ]]> &amp; more</p>' end as description, p_brand as brand, p_type || '|' || p_name || ' & co' as pages from part""")
def b12_shop_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as one document of products, read back by its records; the brand stands in one of two fields."""
    path, p = fresh_dir(spark, "products"), t(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("<p>"), "p_type", F.lit(" ]]> &amp; more</p>")))
    own = F.col("p_size") % 2 == 0
    record = xc.group(
        "Product", xc.element("Name", F.concat("p_name", F.lit(" & <"), "p_brand", F.lit('> "x"'))), xc.element("Price", F.col("p_retailprice")), xc.element("SKU", F.col("p_partkey")), xc.verbatim("ProductDescription", text),
        xc.element("ProductField16", F.when(own, F.col("p_brand"))), xc.element("Brand", F.when(~own, F.col("p_brand"))), xc.listed("ProductOnPages", "Page", F.array("p_type", F.concat("p_name", F.lit(" & co")))),
    )
    xc.write_document(p, path, "ShopSiteProducts", record, "p_partkey")
    r = F.col("record")
    return xc.read_records(spark, path, "Product").select(
        xc.content(r, "SKU").cast("long").alias("sku"), xc.content(r, "Name").alias("name"), xc.content(r, "Price").cast("double").alias("price"), xc.content(r, "ProductDescription").alias("description"),
        xc.content(r, "ProductField16", "Brand").alias("brand"), F.array_join(xc.contents(r, "ProductOnPages", "Page"), "|").alias("pages"),
    )


@query("""select o_orderkey as order_id, c_name as customer, l_linenumber as line, p_name as product, l_quantity as quantity, l_extendedprice as price, o_orderstatus as status
from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey""")
def a15_shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a document of nested records, a row for each product of each order when read back."""
    path = fresh_dir(spark, "orders")
    lines = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    line = F.struct("l_linenumber", xc.group("Product", xc.element("Line", F.col("l_linenumber")), xc.element("Name", F.col("p_name")), xc.element("Quantity", F.col("l_quantity")), xc.element("ItemPrice", F.col("l_extendedprice"))).alias("xml"))
    each = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["xml"]), "").alias("lines"))
    who = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    own = t(spark, sf_dir, "orders").join(who, "o_custkey").join(each, "o_orderkey")  # the long lines are not dealt by customer
    record = xc.group("Order", xc.element("OrderNumber", F.col("o_orderkey")), xc.group("Billing", xc.element("FullName", F.col("c_name"))), xc.element("Status", F.col("o_orderstatus")), xc.group("Shipping", xc.group("Products", F.col("lines"))))
    xc.write_document(own, path, "ShopSiteOrders", record, "o_orderkey")
    r = F.col("record")
    orders = xc.read_records(spark, path, "Order").select(xc.content(r, "OrderNumber").cast("long").alias("order_id"), xc.content(r, "FullName").alias("customer"), xc.content(r, "Status").alias("status"), xc.records_within(r, "Product").alias("products"))
    p = F.col("product")
    lines = orders.select("order_id", "customer", "status", F.explode("products").alias("product"))  # an order's own fields are read once, not for each line
    return lines.select("order_id", "customer", xc.content(p, "Line").cast("int").alias("line"), xc.content(p, "Name").alias("product"), xc.content(p, "Quantity").cast("double").alias("quantity"), xc.content(p, "ItemPrice").cast("double").alias("price"), "status")


@query("""select cast(p_partkey as varchar) as sku, p_name || ' & ' || p_brand as name, p_retailprice as price, p_size as quantity from part where p_size % 7 <> 0""")
def a12_workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows from workbooks: parts in several files, twice each, rows without a name among them."""
    path, p = fresh_dir(spark, "books"), t(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("SKU_NO"), F.when(F.col("p_size") % 7 != 0, F.concat("p_name", F.lit(" &"))).alias("DESCRIPTION1"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("DESCRIPTION2"), F.col("p_retailprice").alias("LIST_PRICE"), F.col("p_size").alias("QOH"))
    wb.write_workbooks(rows.union(rows).repartition(5), path, most=500)
    read = wb.read_workbooks(spark, path, ["SKU_NO", "SKU", "DESCRIPTION1", "DESCRIPTION2", "LIST_PRICE", "QOH"])
    return feeds.register_rows(read, "__row")
