"""Approximate matching by indexes: closest options, the cascade of likeness, and search over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fuzzy as fz
from .registry import half_up, query, t

#: Weights of the fields of a search: fixed values.
SEARCH_WEIGHTS = {"name": 2.0, "brand": 1.5, "description": 1.0}

_VALUES = "select distinct regexp_replace(p_name, '[aeiou]', '', 'g') || ' ' || p_size as value from part"
_OPTIONS = "select distinct p_name || ' ' || (p_partkey % 50) as option from part"


def spellings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of parts without vowels and with their size, and names with a number."""
    p = t(spark, sf_dir, "part")
    values = p.select(F.concat(F.regexp_replace("p_name", "[aeiou]", ""), F.lit(" "), F.col("p_size").cast("string")).alias("value"))
    return values, p.select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string")).alias("option"))


@query(f"""with v as ({_VALUES}), o as ({_OPTIONS}), s as (select value, option, levenshtein(value, option) as edits, greatest(length(value), length(option)) as n from v cross join o)
select value, option, cast(edits as int) as edits, floor((1 - edits * 1.0 / n) * 10000 + 0.5) / 10000 as similarity from s where edits * 1.0 / n <= 0.4 qualify row_number() over (partition by value order by edits * 1.0 / n, option) = 1""")
def m08_closest_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest option of each value by length-normalised edit distance."""
    return fz.closest(*spellings(spark, sf_dir)).select("value", "option", "edits", half_up(F.col("similarity"), 4).alias("similarity"))


@query("with v as (select distinct p_name as value from part), o as (select distinct p_name as option from part) select value, option, cast(levenshtein(value, option) as int) as edits from v cross join o where levenshtein(value, option) * 1.0 / greatest(length(value), length(option)) <= 0.3")
def m08_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of part names within three edits in ten characters."""
    names = t(spark, sf_dir, "part").select(F.col("p_name").alias("value"))
    return fz.edit_join(names, names.withColumnRenamed("value", "option"), 0.3)


_D18_VALUES = "select distinct case p_partkey % 5 when 0 then p_name when 1 then split_part(p_name, ' ', 2) when 2 then lower(p_type) || ' ' || split_part(p_name, ' ', 1) when 3 then regexp_replace(p_name, '[aeiou]', '') || p_size else p_name || ' ' || p_size end as value from part"


@query(rf"""with v as ({_D18_VALUES}), o as (select distinct p_name as option from part where p_size % 4 <> 0),
s as (select value, option, len(list_intersect(list_distinct(list_filter(string_split_regex(value, '\s+'), lambda w: length(w) > 2)), list_distinct(list_filter(string_split_regex(option, '\s+'), lambda w: length(w) > 2)))) as shared, levenshtein(value, option) * 1.0 / greatest(length(value), length(option)) as far from v cross join o),
g as (select *, case when value = option then 1 when contains(value, option) or contains(option, value) then 2 when shared > 0 then 3 when far <= 0.4 then 4 end as stage from s)
select value, option, stage from g where stage is not null qualify row_number() over (partition by value order by stage, case stage when 3 then -shared when 4 then far else 0 end, option) = 1""")
def d18_closest_by_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option of the first stage that finds one: equal, holding, most words in common, closest by edits."""
    p = t(spark, sf_dir, "part")
    words, key = F.split("p_name", " "), F.col("p_partkey") % 5
    value = F.when(key == 0, F.col("p_name")).when(key == 1, F.get(words, F.lit(1))).when(key == 2, F.concat_ws(" ", F.lower("p_type"), F.get(words, F.lit(0)))).when(key == 3, F.concat(_without_first_vowel(), F.col("p_size").cast("string"))).otherwise(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))
    return fz.cascade(p.select(value.alias("value")), p.where("p_size % 4 <> 0").select(F.col("p_name").alias("option")))


def _without_first_vowel():
    return F.concat(F.regexp_extract("p_name", "^([^aeiou]*)", 1), F.regexp_extract("p_name", "^[^aeiou]*[aeiou]?(.*)$", 1))


@query(r"""with q as (select item_id as query, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2)) as w from benchmark), t as (select query, unnest(w) as term from q),
f as (select p_partkey, unnest([{'s': 1.0, 'w': string_split_regex(lower(p_name), '[^a-z0-9]+')}, {'s': 2.0 / 1.5, 'w': string_split_regex(lower(p_brand), '[^a-z0-9]+')}, {'s': 2.0, 'w': string_split_regex(lower(p_type), '[^a-z0-9]+')}]) as f from part), d as (select distinct p_partkey, f.s as s, unnest(f.w) as word from f),
n as (select term, word, levenshtein(term, word) * 1.0::double / greatest(length(term), length(word)) as far from (select distinct term from t) cross join (select distinct word from d where word <> '') where levenshtein(term, word) * 1.0::double / greatest(length(term), length(word)) <= 0.4),
h as (select term, p_partkey, min(far * s) as far from n join d using (word) group by all), r as (select query, p_partkey as item, count(*) as terms, cast(sum(cast(far as decimal(18,9))) as double) as distance from t join h using (term) group by all)
select query, cast(row_number() over (partition by query order by terms desc, distance, item) as int) as rank, item, terms, distance from r qualify rank <= 10""")
def m20_fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best parts for each benchmark text; scores are this library's own, as an approximate search has no exact ones."""
    items = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("description"))
    return fz.fuzzy_search(items, t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), SEARCH_WEIGHTS)
