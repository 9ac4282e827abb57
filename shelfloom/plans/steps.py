"""Single steps of feeds, workflows and filters, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..functions import workflow as wf
from ..session import fresh_dir
from ..sources import feeds
from . import intake
from .registry import half_up, query, t

# Inventory records of parts; every line is cut somewhere, and every third has no name or no sku
_LINE = "case when p_partkey % 7 = 0 then 'HD2' else 'HD1' end || rpad(case when p_partkey % 5 = 0 then '' else cast(p_partkey as varchar) end, 12, ' ') || rpad(p_type, 12, ' ') || rpad(case when p_size % 3 = 0 then '' else p_name end, 33, ' ') || lpad(cast(cast(p_retailprice * 100 as bigint) as varchar), 8, '0') || lpad(p_size || 'x', 8, ' ') || lpad(cast(p_size as varchar), 6, '0')"


def record_lines(spark: SparkSession, sf_dir: str) -> Column:
    name = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    sku = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_partkey").cast("string"))
    kind, cents = F.when(F.col("p_partkey") % 7 == 0, "HD2").otherwise("HD1"), F.round(F.col("p_retailprice") * 100).cast("long").cast("string")
    size = F.col("p_size").cast("string")
    return F.concat(kind, F.rpad(sku, 12, " "), F.rpad("p_type", 12, " "), F.rpad(name, 33, " "), F.lpad(cents, 8, "0"), F.lpad(F.concat(size, F.lit("x")), 8, " "), F.lpad(size, 6, "0"))


_CUT = f"select substr({_LINE}, 1, cast(p_partkey % 90 as int)) as line from part"
_FIELD = lambda a, b: f"trim(substr(line, {a + 1}, {b - a}))"
_NUMBER = lambda a, b: f"coalesce(try_cast({_FIELD(a, b)} as bigint), 0)"


@query(f"""with l as ({_CUT}) select {_FIELD(0, 3)} as record_type, {_FIELD(3, 15)} as distributor_sku, {_FIELD(15, 27)} as upc, {_FIELD(27, 60)} as name, {_NUMBER(60, 68)} / 100.0::double as price, {_NUMBER(68, 76)} / 100.0::double as cost, cast({_NUMBER(76, 82)} as int) as quantity from l where trim(line) <> ''""")
def a05_decoded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of lines that are cut anywhere: text, numbers and implied decimals, empty or 0 where a line ends."""
    path = fresh_dir(spark, "lines")
    t(spark, sf_dir, "part").select(F.substring(record_lines(spark, sf_dir), F.lit(1), (F.col("p_partkey") % 90).cast("int")).alias("value")).write.text(path)
    return feeds.fixed_width(spark, path)


@query(f"""with l as (select {_LINE} as line from part) select {_FIELD(3, 15)} as distributor_sku, {_FIELD(15, 27)} as upc, {_FIELD(27, 60)} as name, {_NUMBER(60, 68)} / 100.0::double as price, cast({_NUMBER(76, 82)} as int) as quantity from l where line like 'HD1%' and {_FIELD(3, 15)} <> '' and {_FIELD(27, 60)} <> ''""")
def a09_line_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the feed's kind in the common shape; those without a sku or a name go."""
    path = fresh_dir(spark, "lines")
    t(spark, sf_dir, "part").select(record_lines(spark, sf_dir).alias("value")).write.text(path)
    return intake.line_products(spark, path).select("distributor_sku", "upc", "name", "price", "quantity")


@query("select user_id, count(*) filter (where ts > timestamp '2024-01-31' - interval 24 hour) as last_day, count(*) filter (where ts > timestamp '2024-01-31' - interval 7 day) as last_week from events where ts > timestamp '2024-01-31' - interval 30 day and ts <= timestamp '2024-01-31' group by 1")
def c08_recent_counts(spark: SparkSession, sf_dir: str, as_of: str = "2024-01-31") -> DataFrame:
    """Counts of the day, the week and users of the month before a given time, which is a parameter."""
    now = F.lit(as_of).cast("timestamp")
    since = lambda span: F.col("ts") > now - F.expr(f"interval {span}")
    e = t(spark, sf_dir, "events").where(since("30 days") & (F.col("ts") <= now))
    return e.groupBy("user_id").agg(F.count_if(since("24 hours")).alias("last_day"), F.count_if(since("7 days")).alias("last_week"))


#: Labels of statuses of orders.
STATUS_LABELS = {"O": "Open", "F": "Finished", "P": "In part"}


@query("select o_orderkey, case o_orderstatus when 'O' then 'Open' when 'F' then 'Finished' when 'P' then 'In part' else 'Unknown: ' || coalesce(o_orderstatus, '') end as label from orders")
def c10_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce(*(F.when(F.col("o_orderstatus") == k, v) for k, v in STATUS_LABELS.items()), F.concat(F.lit("Unknown: "), F.coalesce("o_orderstatus", F.lit(""))))
    return t(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))


@query("""with f as (select 'order' as kind, o_orderkey as id, cast(o_orderdate as timestamp) as moment, 'Order ' || o_orderkey as title from orders union all select 'event', event_id, ts, event_type from events union all select 'page', page_id, timestamp '2024-01-01' + page_id * interval 1 hour, url from pages)
select kind, count(*) as n, count(distinct title) as titles, min(id) as first_id, max_by(id, (moment, id)) as newest from f group by 1""")
def h01_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, events and pages in one shape, told by kind."""
    orders = t(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("moment"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"))
    events = t(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("moment"), F.col("event_type").alias("title"))
    pages = t(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.expr("timestamp '2024-01-01' + make_dt_interval(0, page_id, 0, 0)").alias("moment"), F.col("url").alias("title"))
    each = orders.unionByName(events).unionByName(pages)
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"), F.min("id").alias("first_id"), F.max_by("id", F.struct("moment", "id")).alias("newest"))


@query(r"select item_id, 'w:' || coalesce(nullif(trim(lower(nullif(regexp_extract(text, '([A-Z][a-z]{5,})', 1), ''))), ''), 'none') || '!' as value, replace(text, ' the ', ' THE ') as replaced from benchmark")
def i02_text_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of transformations with prefix, suffix and default."""
    chain = [{"type": "regex_extract", "pattern": "([A-Z][a-z]{5,})"}, {"type": "lower"}, {"type": "default", "value": "none"}, {"type": "prefix", "value": "w:"}, {"type": "suffix", "value": "!"}]
    return t(spark, sf_dir, "benchmark").select("item_id", wf.transformed(F.col("text"), chain).alias("value"), wf.transformed(F.col("text"), [{"type": "replace", "pattern": " the ", "replacement": " THE "}]).alias("replaced"))


@query("""select p_partkey, case when starts_with(p_name, 'small ') then substr(p_name, 7) else p_name end as bare, case when ends_with(p_brand, '5') then left(p_brand, length(p_brand) - 1) else p_brand end as brand, upper(trim(p_type)) as kind, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title from part""")
def i03_normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes and suffixes removed, case made."""
    steps = {"bare": ("p_name", {"type": "remove_prefix", "value": "small "}), "brand": ("p_brand", {"type": "remove_suffix", "value": "5"}), "kind": ("p_type", {"type": "upper"}), "title": ("p_name", {"type": "title"})}
    return t(spark, sf_dir, "part").select("p_partkey", *(wf.transformed(F.trim(c), [s]).alias(k) for k, (c, s) in steps.items()))


_WEIGHT = "p_size || '.5 ' || ['kg', 'oz', 'LBS', 'g', 'stones'][p_partkey % 5 + 1]"


@query(rf"""with v as (select p_partkey, lower({_WEIGHT}) as v from part), m as (select p_partkey, try_cast(nullif(regexp_extract(v, '(\d+(?:\.\d+)?)\s*(kg|g|oz|lb)s?\b', 1), '') as double) as n, regexp_extract(v, '(\d+(?:\.\d+)?)\s*(kg|g|oz|lb)s?\b', 2) as u from v)
select p_partkey, floor(n * case u when 'kg' then 1000.0::double when 'oz' then 28.3495::double when 'lb' then 453.592::double when 'g' then 1.0::double end / 453.592::double * 10000 + 0.5) / 10000 as pounds from m""")
def i05_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("kg", "oz", "LBS", "g", "stones"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    own = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".5 "), unit).alias("weight"))
    return wf.run(own, [{"action": "parse_weight", "params": {"field": "weight", "unit": "lb"}}]).select("p_partkey", half_up(F.col("weight"), 4).alias("pounds"))


@query("select event_id, json_extract_string(props, '$.k') as k, cast(null as varchar) as none, json_extract_string('{\"list\": [{\"v\": ' || json_extract_string(props, '$.k') || '}, 7]}', '$.list[0].v') as inner_value from events")
def l01_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at dotted paths with numbers for places in lists; null where a path ends."""
    own = t(spark, sf_dir, "events").select("event_id", "props", F.concat(F.lit('{"list": ['), F.regexp_replace("props", '"k"', '"v"'), F.lit(", 7]}")).alias("more"))
    steps = [{"action": "extract_from_json", "params": {"field": f, "path": p, "target": c}} for f, p, c in (("props", "k", "k"), ("props", "k.x.0", "none"), ("more", "list.0.v", "inner_value"))]
    return wf.run(own, steps).select("event_id", "k", "none", "inner_value")


@query("with w as (select item_id, list_filter(string_split(text, ' '), lambda s: length(s) > 9) as words from benchmark) select item_id, cast(n - 1 as int) as place, w.words[n] as word from w, unnest(range(1, len(w.words) + 1)) as u(n)")
def l08_json_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a JSON list with their places: a text's long words, written as JSON and read again."""
    listed = F.to_json(F.filter(F.split("text", " "), lambda w: F.length(w) > 9))
    return t(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.from_json(listed, "array<string>")).alias("place", "word"))


@query("select conv_id, turn, cast(n as int) as ordinal, string_split(text, '.')[n] as sentence from conversations, unnest(range(1, len(string_split(text, '.')) + 1)) as u(n)")
def l10_split_with_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of a text between full stops and its number."""
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\.", -1)).alias("p", "sentence")).select("conv_id", "turn", (F.col("p") + 1).alias("ordinal"), "sentence")


@query("select p_partkey, p_brand || ' {none} by ' || p_name as label from part")
def p10_substituted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow whose parameters name variables; unknown ones stay as they are."""
    steps = [{"action": "transform_value", "params": {"field": "{{field}}", "target": "label", "transformations": [{"type": "prefix", "value": "{none} {word} "}]}}, {"action": "combine_fields", "params": {"format": "{p_brand} {label}", "target": "{out}"}}]
    return wf.run(t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), steps, {"field": "p_name", "word": "by", "out": "label", "p_brand": "{p_brand}", "label": "{label}"}).select("p_partkey", "label")


@query("with d as (select l_returnflag as flag, l_extendedprice / 1000 - l_quantity as d from lineitem) select flag, count(*) as n, floor(avg(d) / stddev_samp(d) * 10000 + 0.5) / 10000 as effect from d group by 1")
def r13_effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's d of paired values: quantities and prices of lines in thousands, by return flag."""
    pairs = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    return st.paired_t(pairs, "a", "b", "flag").select("flag", "n", half_up(F.col("d"), 4).alias("effect"))
