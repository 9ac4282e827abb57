"""Supplier feeds brought to one product shape: CSV, fixed width, JSON pages, XML, register rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The common product shape.
PRODUCT = "source string, distributor_sku string, upc string, name string, description string, brand string, category string, price double, cost double, msrp double, quantity int, weight double, images array<string>"
#: Layout of the fixed-width inventory record: field, first and last (exclusive) character, kind, implied decimals.
RECORD = (
    ("record_type", 0, 3, "string", 0), ("distributor_sku", 3, 15, "string", 0), ("upc", 15, 27, "string", 0), ("name", 27, 60, "string", 0),
    ("price", 60, 68, "decimal", 2), ("cost", 68, 76, "decimal", 2), ("quantity", 76, 82, "number", 0),
)
#: Header spellings of register files, first wins.
REGISTER = {"sku": ("SKU_NO", "SKU"), "price": ("LIST_PRICE", "PRICE"), "quantity": ("QUANTITY_ON_HAND", "QUANTITY", "QOH")}


def leading_number(x: Column) -> Column:
    """The number a text begins with, as a lenient parser reads it; null without one."""
    return F.regexp_extract(F.trim(x), r"^[+-]?\d*\.?\d+", 0).try_cast("double")


def csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """Rows of text columns: quoted fields with doubled quotes, values trimmed, missing cells empty. Without a header: col1, col2, ..."""
    df = spark.read.csv(path, sep=delimiter, header=header, quote=quote, escape=quote, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", inferSchema=False)
    if not header:
        df = df.toDF(*(f"col{i}" for i in range(1, len(df.columns) + 1)))
    return df.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns))


def fixed_width(spark: SparkSession, path: str, layout: tuple = RECORD, prefix: str | None = None) -> DataFrame:
    """Fields of lines: text trimmed, numbers 0 where they do not parse, implied decimals divided out. Short lines give empty fields."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if prefix:
        lines = lines.where(F.startswith("value", F.lit(prefix)))
    out = []
    for name, a, b, kind, places in layout:
        cell = F.trim(F.substring("value", a + 1, b - a))
        number = F.coalesce(cell.try_cast("long"), F.lit(0))
        out.append((cell if kind == "string" else number.cast("int") if kind == "number" else (number / 10**places).cast("double")).alias(name))
    return lines.select(*out)


def json_pages(spark: SparkSession, path: str, items: str, schema: str, lines: bool = False) -> DataFrame:
    """Items of landed pages, a JSON object a file (or, with lines, a line) with a list under `items`."""
    pages = spark.read.schema(f"`{items}` array<struct<{schema}>>").json(path, multiLine=not lines)
    return pages.select(F.inline(items))


def xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).format("xml").option("rowTag", tag).load(path)


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that are there and not empty."""
    there = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def register_rows(df: DataFrame, order: str) -> DataFrame:
    """sku, name, price, quantity of register rows: header spellings merged, rows without sku or name dropped, the first row of a sku (by `order`) kept."""
    name = F.nullif(F.trim(F.concat_ws(" ", first_of(df, ("DESCRIPTION1", "NAME")), first_of(df, ("DESCRIPTION2",)))), F.lit(""))
    rows = df.select(F.col(order).alias("__order"), first_of(df, REGISTER["sku"]).alias("sku"), name.alias("name"), leading_number(F.regexp_replace(first_of(df, REGISTER["price"]), "[$,]", "")).alias("price"), leading_number(first_of(df, REGISTER["quantity"])).cast("int").alias("quantity"))
    rank = F.row_number().over(Window.partitionBy("sku").orderBy("__order"))
    return rows.where(F.col("sku").isNotNull() & F.col("name").isNotNull()).withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__order")


def to_products(df: DataFrame, source: str, mapping: dict[str, Column]) -> DataFrame:
    """df in the common shape; fields without a mapping are null, rows without sku or name go."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(PRODUCT).fields
    own = {"source": F.lit(source)} | mapping
    rows = df.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    return rows.where((F.coalesce("distributor_sku", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
