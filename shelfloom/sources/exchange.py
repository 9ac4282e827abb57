"""Exchange of XML documents with a shop: a partitioned writer of one document's layout, and a reader that splits large files by record.

A document lies in a folder as head, records and foot, each a folder of its own: read in the order of their names they are one
well-formed document, and no task writes more than its range of the records. A file of any size is read by many tasks, as
Spark's text source cuts it at the records' closing tag.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signs and how XML writes them, the first to be replaced first: fixed values.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
#: Characters that XML has no way to write.
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def escaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.regexp_replace(text.cast("string"), FORBIDDEN, ""))


def unescaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ENTITIES), text)


def element(tag: str, value: Column) -> Column:
    """<tag>value</tag>, escaped; <tag/> for a null or empty value."""
    text = escaped(value)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(f"<{tag}/>")).otherwise(F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>")))


def verbatim(tag: str, value: Column) -> Column:
    """The value as a CDATA section: markup within it stays as it is."""
    text = F.replace(F.regexp_replace(value.cast("string"), FORBIDDEN, ""), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(f"<{tag}/>")).otherwise(F.concat(F.lit(f"<{tag}><![CDATA["), text, F.lit(f"]]></{tag}>")))


def listed(tag: str, entry: str, values: Column) -> Column:
    """<tag> with an <entry> for each value of an array."""
    return F.concat(F.lit(f"<{tag}>"), F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: element(entry, v)), ""), F.lit(f"</{tag}>"))


def group(tag: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag}>"))


def write_document(records: DataFrame, path: str, root: str, record: Column, *order: Column | str, doctype: str | None = None) -> None:
    """Writes a document of all records: their text by `record`, in a total order. Without records it has head and foot alone."""
    spark = records.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>' + (f"\n<!DOCTYPE {root} {doctype}>" if doctype else "") + f"\n<{root}>"
    body = records.repartitionByRange(*order).sortWithinPartitions(*order).select(record.alias("value"))
    for name, part in (("1-head", spark.createDataFrame([(head,)], "value string")), ("2-records", body), ("3-foot", spark.createDataFrame([(f"</{root}>",)], "value string"))):
        part.write.text(f"{path}/{name}")


def read_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """record: what stands within each <tag> of the files of a path, in whatever way they are cut. Records of one tag don't hold each other."""
    pieces = spark.read.option("lineSep", f"</{tag}>").option("recursiveFileLookup", "true").text(path)
    return pieces.select(F.regexp_extract("value", rf"(?s)^.*?<{tag}(?:\s[^>]*)?>(.*)$", 1).alias("record")).where(F.col("value").rlike(rf"<{tag}[\s>]"))


def content(record: Column, *tags: str) -> Column:
    """The text of the first element of each of the tags; of these, the first that is not empty (fields by alias), else null."""
    found = []
    for tag in tags:
        raw = F.regexp_extract(record, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        plain = F.when(raw.contains("<![CDATA["), F.regexp_replace(F.replace(raw, F.lit("]]]]><![CDATA[>"), F.lit("]]>")), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")).otherwise(unescaped(raw))
        found.append(F.nullif(plain, F.lit("")))
    return F.coalesce(*found)


def contents(record: Column, block: str, entry: str) -> Column:
    """The texts of the entries within the first block; a CDATA section is taken as it is."""
    inner = F.regexp_extract(record, rf"(?s)<{block}(?:\s[^>]*)?>(.*?)</{block}>", 1)
    return F.transform(F.regexp_extract_all(inner, F.lit(rf"(?s)<{entry}(?:\s[^>]*)?>(.*?)</{entry}>"), F.lit(1)), unescaped)


def records_within(record: Column, tag: str) -> Column:
    """What stands within each <tag> of a record."""
    return F.regexp_extract_all(record, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
