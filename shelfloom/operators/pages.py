"""Structured data of web pages: linked-data blocks as variants, products and breadcrumbs from them, meta tags, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, token_text
from .tables import first_by

_BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
#: Breadcrumb names that say nothing: fixed values.
GENERIC = ("home", "shop", "products", "all products", "catalog", "store")


def listed(v: Column, path: str) -> Column:
    """A variant's list at path, or null."""
    return F.try_variant_get(v, path, "array<variant>")


def linked_data(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ordinal, node (variant) of every linked-data node, lists and graphs flattened; blocks that do not parse give none."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1))).alias("block", "raw")).select(key, "block", F.try_parse_json(F.trim("raw")).alias("v"))
    tops = blocks.select(key, "block", F.posexplode(F.coalesce(listed(F.col("v"), "$"), F.array("v"))).alias("top", "v"))
    nodes = tops.select(key, "block", "top", F.posexplode(F.coalesce(listed(F.col("v"), '$["@graph"]'), F.array("v"))).alias("n", "node"))
    return nodes.where("node is not null").select(key, F.struct("block", "top", "n").alias("ordinal"), "node")


def text_at(path: str, node: str = "node") -> Column:
    return F.nullif(collapsed(F.try_variant_get(F.col(node), path, "string")), F.lit(""))


def of_type(kind: str) -> Column:
    kinds = F.coalesce(F.try_variant_get("node", '$["@type"]', "array<string>"), F.array(F.try_variant_get("node", '$["@type"]', "string")))
    return F.coalesce(F.array_contains(kinds, kind), F.lit(False))


def images_of(node: Column) -> Column:
    """Absolute image addresses of a node, each once, in order."""
    many = F.coalesce(F.try_variant_get(node, "$.image", "array<string>"), F.array_compact(F.array(F.coalesce(F.try_variant_get(node, "$.image.url", "string"), F.try_variant_get(node, "$.image", "string")))))
    return F.array_distinct(F.filter(F.transform(many, lambda u: F.regexp_replace(u, "^//", "https://")), lambda u: u.rlike("^https?://")))


def products(pages: DataFrame, wanted: DataFrame, key: str = "page_id") -> DataFrame:
    """The best product of each page: name, brand, sku, description, images, score, confidence.

    wanted: key, sku, brand, name expected of the page. A node scores 4 for the sku, 3 for the brand, 3 for the name; nodes
    without a usable image are passed over; equal scores go to the first node.
    """
    n = linked_data(pages, key).where(of_type("Product"))
    brand = F.coalesce(text_at("$.brand.name"), text_at("$.brand"))
    p = n.select(key, "ordinal", text_at("$.name").alias("name"), brand.alias("brand"), F.coalesce(text_at("$.sku"), text_at("$.gtin13"), text_at("$.gtin12")).alias("sku"), text_at("$.description").alias("description"), images_of(F.col("node")).alias("images"), text_at("$.category").alias("category"))
    w = wanted.select(key, F.col("sku").alias("__sku"), F.col("brand").alias("__brand"), F.col("name").alias("__name"))
    like = lambda a, b: F.coalesce((token_text(b) != "") & (F.contains(token_text(a), token_text(b)) | (F.contains(token_text(b), token_text(a)) & (token_text(a) != ""))), F.lit(False)).cast("int")
    score = 4 * F.coalesce(token_text("sku") == token_text("__sku"), F.lit(False)).cast("int") + 3 * like("brand", "__brand") + 3 * like("name", "__name") + F.col("category").isNotNull().cast("int")
    scored = p.where(F.size("images") > 0).join(w, key).withColumn("score", score)
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("name", "brand", "sku", "description", "category")), (F.size("images") > 0).cast("int"))
    best = first_by(scored, [key], F.desc("score"), "ordinal")
    return best.withColumn("confidence", F.greatest(F.lit(0.55), F.least(F.lit(0.98), filled / 6 + F.col("score") / 12))).drop("__sku", "__brand", "__name", "ordinal")


def breadcrumbs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and the names of its breadcrumb list in order, without generic and repeated ones."""
    items = linked_data(pages, key).where(of_type("BreadcrumbList")).select(key, "ordinal", F.posexplode(listed(F.col("node"), "$.itemListElement")).alias("i", "node"))
    name = F.coalesce(text_at("$.name"), text_at("$.item.name"))
    rows = items.select(key, F.struct("ordinal", "i", name.alias("name")).alias("x")).where(F.col("x.name").isNotNull() & ~F.lower("x.name").isin(*GENERIC))
    return rows.groupBy(key).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list("x")), lambda v: v["name"])).alias("categories"))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by property or name, in either order of attributes."""
    q = name.replace(".", r"\.")
    a = F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:property|name)=["']{q}["'][^>]*content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]*(?:property|name)=["']{q}["']""", 1)
    return F.coalesce(F.nullif(F.trim(a), F.lit("")), F.nullif(F.trim(b), F.lit("")))
