"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence between allow and block.

A rule names a host, which stands for all its subdomains, and the beginning of a path. The trie descends from the last label of
the host to the first; at each host with rules a second trie descends by whole segments of the path, and the last piece of a
rule, which may be part of a segment, is looked up by its lengths. Of all rules that fit, the longest (characters of host and
path together) decides; between equally long ones the longer host, then block before allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, prepared, saved, table

#: Rules, and characters of all rules, up to which the trie is built and broadcast (some 100 MB); beyond, rules are joined.
MOST_RULES, MOST_CHARACTERS = 200_000, 16_000_000
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query: verdict, host, path.
RULES = [(ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to /, ? or #; A-Z lower-cased) and path (from there up to ? or #); both empty without ://."""
    rest = F.coalesce(F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, rest).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


class Trie:
    """Rules by reversed host labels, then by path segments."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root: dict = {"down": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node["down"].setdefault(label, {"down": {}, "paths": None})
            node["paths"] = at = node["paths"] or {"down": {}, "ends": {}, "lengths": []}
            *whole, last = path.split("/")
            for segment in whole:
                at = at["down"].setdefault(segment, {"down": {}, "ends": {}, "lengths": []})
            if at["ends"].get(last, ("",))[0] != BLOCK:
                at["ends"][last] = (verdict, host, path)
            if len(last) not in at["lengths"]:
                at["lengths"] = sorted([*at["lengths"], len(last)], reverse=True)

    def longest(self, host: str, path: str) -> tuple[str, str, str] | None:
        """The deciding rule of a url, if any fits."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node["down"].get(label)
            if node is None:
                break
            at, found = node["paths"], None
            for segment in segments:  # deeper rules of one host are longer
                if at is None:
                    break
                found = next((at["ends"][segment[:n]] for n in at["lengths"] if len(segment) >= n and segment[:n] in at["ends"]), found)
                at = at["down"].get(segment)
            if found and (best is None or len(found[1]) + len(found[2]) >= len(best[1]) + len(best[2])):
                best = found
        return best


def judged(urls: DataFrame, rules: DataFrame, otherwise: str = ALLOW, most_rules: int = MOST_RULES, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """urls (with a column url) and their host, path, rule and verdict.

    rules (verdict, host, path): verdict is allow or block, the host is lower case, the path begins with / and may be empty.
    Rows of rules with a null or an empty host fit nothing; of equal host and path, block decides. A url that no rule fits
    gets no rule and the verdict `otherwise`. A null url, or one without ://, has an empty host and path. Columns of urls of
    the four result names, in any case, give way to the results; repeated rows stay; urls and paths are whole, however long;
    no rows give no rows. Up to MOST_RULES rules and MOST_CHARACTERS characters go to every task as one trie; more are joined by
    hash, on the suffixes of the host and the beginnings of the path, so that neither rules nor hot hosts are held by one task.
    """
    given = urls.drop(*(c for c in urls.columns if c.lower() in ("host", "path", "rule", "verdict")))
    host, path = split_url(F.col("url").cast("string"))
    rows = given.withColumn("host", host).withColumn("path", path)
    known = rules.where("host <> '' and path is not null and verdict in ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    count, size = known.agg(F.count("*"), F.sum(F.length("host") + F.length("path"))).first()
    if count <= most_rules and (size or 0) <= most_characters:
        trie = urls.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in known.select("verdict", "host", "path").collect()]))
        schema = T.StructType([*rows.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = trie.value
            for batch in batches:
                found = [own.longest(h, p) for h, p in zip(column(batch, "host"), column(batch, "path"), strict=True)]
                rule, verdict = ([None if x is None else x[1] + x[2] for x in found], [otherwise if x is None else x[0] for x in found])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

        return rows.mapInArrow(look_up, schema)
    # every url meets each (suffix of its host, beginning of its path) that some rule could be: one rule at most for each
    lengths = [r[0] for r in known.select(F.length("path")).distinct().orderBy("length(path)").collect()]
    keyed = saved(rows.withColumn("__row", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fits = keyed.select("__row", F.explode(suffixes).alias("host"), "path").select("__row", "host", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))).alias("n"), "path")
    fits = fits.select("__row", "host", F.expr("substring(path, 1, n)").alias("path")).join(known, ["host", "path"])
    order = F.struct(F.length("host") + F.length("path"), F.length("host"))
    best = fits.withColumn("k", F.row_number().over(Window.partitionBy("__row").orderBy(order.desc()))).where("k = 1")
    out = keyed.join(best.select("__row", F.concat("host", "path").alias("rule"), "verdict"), "__row", "left").drop("__row")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    prepared(spark)
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op12_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""with rules(v, h, p) as (values {rules}),
rest as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
cut as (select page_id, r, regexp_extract(r, '^[^/?#]*') as given from rest),
parts as (select page_id, translate(given, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(r, length(given) + 1), '^[^?#]*') as path from cut),
fit as (select page_id, h || p as rule, v, length(h) + length(p) as n, length(h) as hn from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
best as (select page_id, rule, v from fit qualify row_number() over (partition by page_id order by n desc, hn desc, v desc) = 1)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from parts left join best using (page_id)"""
