"""Trials of extraction and selection: comparisons by field, rates of selection, paired tests; and batches that hold as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..functions import text as x
from ..operators import tables as op
from ..streaming import events as ev
from .evaluation import t_between_sql
from .registry import half_up, money, query, t

#: Fields that are compared whole, and as sets: fixed values.
EXACT_FIELDS = ("brand", "sku")
SET_FIELDS = ("images", "categories", "tags", "bullets", "features")


def text_score(a: Column, b: Column) -> Column:
    """Multiset overlap of words; two empty texts agree."""
    words = lambda v: F.filter(F.split(F.lower(x.collapsed(F.coalesce(v, F.lit("")))), " "), lambda w: w != "")
    times = lambda own, w: F.size(F.filter(own, lambda v: v == w))

    def dice(s: Column) -> Column:
        both = F.aggregate(F.array_distinct(s["a"]), F.lit(0), lambda n, w: n + F.least(times(s["a"], w), times(s["b"], w)))
        return F.when(F.size(s["a"]) + F.size(s["b"]) == 0, 1.0).otherwise(2.0 * both / (F.size(s["a"]) + F.size(s["b"])))

    return x.bound(F.struct(words(a).alias("a"), words(b).alias("b")), dice)


def field_score(field: Column, a: Column, b: Column) -> Column:
    """How far two values of a field agree, 0 to 1: whole values, sets between pipes, or words, by the field's name."""
    plain = lambda v: F.lower(x.collapsed(F.coalesce(v, F.lit(""))))
    own, other = (F.array_distinct(F.transform(x.pipe_values(v), F.lower)) for v in (a, b))
    union = F.size(F.array_union(own, other))
    name = F.lower(F.trim(field))
    return F.when(name.isin(*EXACT_FIELDS), (plain(a) == plain(b)).cast("double")).when(name.isin(*SET_FIELDS), F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(own, other)) / union)).otherwise(text_score(a, b))


@query("""select p_partkey, 'brand' as field, case when p_size > 25 then 1.0 else 0.0 end::double as score from part union all select p_partkey, 'categories', case when p_type = 'PROMO' then 1.0 else 0.3333 end from part union all select p_partkey, 'name', 0.8 from part""")
def r03_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field of a record compared by the rule of its name."""
    p = t(spark, sf_dir, "part")
    of = lambda name, a, b: F.struct(F.lit(name).alias("field"), a.alias("a"), b.alias("b"))
    fields = F.array(
        of("brand", F.concat(F.lit(" "), F.upper("p_brand")), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("other")),
        of("categories", F.concat("p_type", F.lit("|x")), F.lit("promo | X|y|y").substr(F.when(F.col("p_type") == "PROMO", 1).otherwise(8), F.when(F.col("p_type") == "PROMO", 9).otherwise(6))),
        of("name", F.col("p_name"), F.concat(F.lit(" New  "), F.upper("p_name"))),
    )
    long = p.select("p_partkey", F.explode(fields).alias("f")).select("p_partkey", "f.*")
    return long.select("p_partkey", "field", half_up(field_score(F.col("field"), F.col("a"), F.col("b")), 4).alias("score"))


def selection_rates(results: DataFrame) -> DataFrame:
    """One row of percentages: official sources picked among expected ones, variants resolved, results of their cohort's usual domain, and official picks of a wrong address.

    results: expected_tier, predicted_tier, expected_url, predicted_url, expected_variant, predicted_variant, cohort,
    expected_domain, predicted_domain. A cohort's usual domain is its most frequent expected one, ties to the smaller name.
    """
    r = results.withColumn("official", F.col("expected_tier") == "official").withColumn("picked", F.col("official") & (F.col("predicted_tier") == "official"))
    percent = lambda hits, n: F.when(n > 0, hits * 100 / n).otherwise(0.0)
    official = F.count_if("official")
    variants = F.count("expected_variant")
    own = r.agg(percent(F.count_if("picked"), official).alias("official_rate"), percent(F.count_if(F.col("expected_variant") == F.col("predicted_variant")), variants).alias("variant_rate"), percent(F.count_if(F.col("picked") & ~F.col("expected_url").eqNullSafe(F.col("predicted_url"))), official).alias("false_official_rate"))
    members = r.where("cohort is not null").groupBy("cohort", "expected_domain", "predicted_domain").agg(F.count("*").alias("n"))
    totals = members.where("expected_domain is not null").groupBy("cohort", "expected_domain").agg(F.sum("n").alias("n"))
    usual = totals.groupBy("cohort").agg(F.min_by("expected_domain", F.struct(-F.col("n"), F.col("expected_domain"))).alias("usual"))
    cohorts = members.join(usual, "cohort", "left").agg(percent(F.coalesce(F.sum(F.when(F.col("predicted_domain") == F.col("usual"), F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("cohort_rate"))
    return own.crossJoin(cohorts)  # one row each


@query("""with r as (select o_orderpriority in ('1-URGENT', '2-HIGH') as off, o_orderstatus <> 'O' as poff, o_totalprice > 300000 as wrong, case when o_totalprice < 200000 then o_orderpriority end as ev, case when o_totalprice < 50000 then 'none' else o_orderpriority end as pv, o_custkey as cohort, o_orderstatus as ed, case when o_totalprice > 250000 then 'X' else o_orderstatus end as pd from orders),
u as (select cohort, ed from (select cohort, ed, count(*) n from r group by 1, 2) qualify row_number() over (partition by cohort order by n desc, ed) = 1)
select floor(count(*) filter (where off and poff) * 100.0 / count(*) filter (where off) * 10000 + 0.5) / 10000 as official_rate, floor(count(*) filter (where ev = pv) * 100.0 / count(ev) * 10000 + 0.5) / 10000 as variant_rate, floor(count(*) filter (where off and poff and wrong) * 100.0 / count(*) filter (where off) * 10000 + 0.5) / 10000 as false_official_rate, floor(count(*) filter (where pd = u.ed) * 100.0 / count(*) * 10000 + 0.5) / 10000 as cohort_rate from r join u using (cohort)""")
def r09_selection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, tier = F.col("o_totalprice"), lambda c: F.when(c, "official").otherwise("other")
    r = t(spark, sf_dir, "orders").select(
        tier(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("expected_tier"), tier(F.col("o_orderstatus") != "O").alias("predicted_tier"), F.col("o_orderkey").alias("expected_url"), F.when(price <= 300000, F.col("o_orderkey")).alias("predicted_url"),
        F.when(price < 200000, F.col("o_orderpriority")).alias("expected_variant"), F.when(price < 50000, "none").otherwise(F.col("o_orderpriority")).alias("predicted_variant"), F.col("o_custkey").alias("cohort"), F.col("o_orderstatus").alias("expected_domain"), F.when(price > 250000, "X").otherwise(F.col("o_orderstatus")).alias("predicted_domain"),
    )
    return selection_rates(r).select(*(half_up(F.col(c), 4).alias(c) for c in ("official_rate", "variant_rate", "false_official_rate", "cohort_rate")))


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") - (900 + F.col("p_size") * 10)).alias("d"))


@query("""with d as (select p_brand, p_retailprice - (900 + p_size * 10) as d from part), r as (select p_brand, d, rank() over (partition by p_brand order by abs(d)) + (count(*) over (partition by p_brand, abs(d)) - 1) / 2.0 as r, count(*) over (partition by p_brand, abs(d)) as c from d where d <> 0),
s as (select p_brand, count(*) as n, least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end)) as w, sum(c * c - 1) as tied from r group by 1)
select p_brand, n, w, floor((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tied / 48.0) * 10000 + 0.5) / 10000 as z from s""")
def r12_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilcoxon's test of paired values in each group; two_sided_normal of z is its p-value."""
    s = st.signed_rank(_differences(spark, sf_dir), "d", "p_brand")
    return s.select("p_brand", "n", "w", half_up(F.col("z"), 4).alias("z"))


@query(f"""with recursive d as (select p_brand, p_retailprice - (900 + p_size * 10) as d from part), s as (select p_brand, count(*) as n, avg(d) as mean, stddev_samp(d) as sd from d group by 1),
h as (select n - 1.0::double as v, 0.0::double as low, 64.0::double as high, 0 as k from (select distinct n from s where n > 1)
union all select v, case when inside < 0.95 then mid else low end, case when inside < 0.95 then high else mid end, k + 1 from (select *, {t_between_sql('mid', 'v', 4000)} as inside from (select *, (low + high) / 2 as mid from h where k < 45))),
q as (select v, (low + high) / 2 as t from h where k = 45)
select p_brand, n, floor(mean * 1000000 + 0.5) / 1000000 as mean, floor((mean - coalesce(t * sd / sqrt(n), 0)) * 1000000 + 0.5) / 1000000 as low, floor((mean + coalesce(t * sd / sqrt(n), 0)) * 1000000 + 0.5) / 1000000 as high from s left join q on v = n - 1""")
def r14_t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of a mean difference by the quantile of Student's t."""
    s = _differences(spark, sf_dir).groupBy("p_brand").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    margin = F.coalesce(st.t_margin((F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return s.select("p_brand", "n", half_up(F.col("mean"), 6).alias("mean"), half_up(F.col("mean") - margin, 6).alias("low"), half_up(F.col("mean") + margin, 6).alias("high"))


@query("""with d as (select p_brand, p_retailprice - (900 + p_size * 10) as d from part), s as (select p_brand, count(*) filter (where d > 0) as wins, count(*) filter (where d < 0) as losses, avg(d) as mean from d group by 1),
p as (select *, least(1.0, list_sum(list_transform(range(0, least(wins, losses) + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses - 1) * ln(2))))) as p from s)
select p_brand, wins, losses, floor((p + 1e-9) * 1000000 + 0.5) / 1000000 as p_value, case when mean < 0 then 'REJECT' when p < 0.05 then 'MERGE' when mean > 0 then 'REVIEW' else 'MERGE' end as advice from p""")
def r15_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided sign test of paired values in each group, and what to do with the change. A billionth is added before rounding, as such chances often end just between two last places."""
    s = _differences(spark, sf_dir).groupBy("p_brand").agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.avg("d").alias("mean"))
    own = s.withColumn("p", st.sign_p_value("wins", "losses"))
    advice = F.when(F.col("mean") < 0, "REJECT").when(F.col("p") < 0.05, "MERGE").when(F.col("mean") > 0, "REVIEW").otherwise("MERGE")
    return own.select("p_brand", "wins", "losses", half_up(F.col("p") + 1e-9, 6).alias("p_value"), advice.alias("advice"))


#: Fields of a consolidated product that are compared, and those of sets with their separators; all but the last count for completeness: fixed values.
COMPARED = ("name", "brand", "weight", "description", "long_description", "search_keywords", "category", "product_on_pages", "confidence_score")
SETS = {"product_on_pages": r"\|", "search_keywords": ","}


def normalised(field: str, v: Column) -> Column:
    """A field's value as it is compared: texts without case and extra blanks, sets in order, numbers with three decimals; null where nothing is left."""
    if field == "confidence_score":
        return F.format_string("%.3f", v.try_cast("double"))
    text = lambda s: F.lower(x.collapsed(s))
    if field in SETS:
        return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(v, SETS[field]), text), lambda s: s != ""))), "|"), F.lit(""))
    return F.nullif(text(v), F.lit(""))


def compared_records(rows: DataFrame, key: str) -> DataFrame:
    """key, accuracy, completeness, taxonomy, mismatched fields of structs `expected` and `actual`."""
    both = {f: (normalised(f, F.col(f"expected.{f}")), normalised(f, F.col(f"actual.{f}"))) for f in COMPARED}
    wrong = F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(f)) for f, (a, b) in both.items())))
    filled = sum(both[f][1].isNotNull().cast("int") for f in COMPARED[:-1])
    pages = both["product_on_pages"]
    own = rows.select(key, wrong.alias("wrong"), (filled / (len(COMPARED) - 1)).alias("completeness"), F.coalesce(pages[0] == pages[1], F.lit(False)).cast("int").alias("taxonomy"))
    return own.select(key, (1 - F.size("wrong") / len(COMPARED)).alias("accuracy"), "completeness", "taxonomy", F.array_join("wrong", ",").alias("mismatched"))


@query("""select p_partkey, floor((case when p_size > 25 then 8 else 7 end) / 9.0 * 10000 + 0.5) / 10000 as accuracy, 0.875::double as completeness, case when p_size > 25 then 1 else 0 end as taxonomy, case when p_size > 25 then 'weight' else 'weight,product_on_pages' end as mismatched from part""")
def r18_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col
    expected = dict(name=p("p_name"), brand=p("p_brand"), weight=p("p_size").cast("string"), description=F.lit("Good  thing"), long_description=F.lit("long"), search_keywords=F.lit("b,a"), category=p("p_type"), product_on_pages=F.lit("Dogs|Cats"), confidence_score=F.lit("0.5"))
    actual = dict(name=F.concat(F.lit(" "), F.upper("p_name")), brand=F.lower("p_brand"), weight=F.lit(" "), description=F.lit("good thing"), long_description=F.lit("Long"), search_keywords=F.lit("A, b ,a"), category=F.lower("p_type"), product_on_pages=F.when(p("p_size") > 25, "cats | dogs").otherwise("cats"), confidence_score=F.lit("0.50001"))
    side = lambda name, of: F.struct(*(of[f].alias(f) for f in COMPARED)).alias(name)
    rows = t(spark, sf_dir, "part").select("p_partkey", side("expected", expected), side("actual", actual))
    c = compared_records(rows, "p_partkey")
    return c.select("p_partkey", half_up(F.col("accuracy"), 4).alias("accuracy"), "completeness", "taxonomy", "mismatched")


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey in (select c_custkey from customer)")
def b05_strict_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch is kept only if all its customers are known; an unknown one is an error."""
    known = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return op.strict_persist(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), known, "o_custkey")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'imported' else 'scraped' end as status, case when o_orderstatus <> 'F' then o_totalprice end as result from orders")
def o05_bulk_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of a batch, all or none; what came after the new status is emptied."""
    o = t(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.lit("scraped").alias("status"), F.col("o_totalprice").alias("result"))
    moves = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("imported").alias("to_status"))
    return ev.bulk_transition(rows, moves, "o_orderkey", reset=("result",)).select("o_orderkey", "status", "result")


def strategy_metrics(runs: DataFrame, strategy: str, cost: Column, error: Column) -> DataFrame:
    """strategy, runs, cost, errors by kind (name:count, in order of names) of each strategy."""
    kinds = runs.groupBy(strategy, error.alias("kind")).agg(F.count("*").alias("n"), F.sum(cost).alias("c"))
    names = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.concat("kind", F.lit(":"), F.col("n").cast("string")))))  # a row for each kind of error
    return kinds.groupBy(strategy).agg(F.sum("n").alias("runs"), F.sum("c").cast("double").alias("cost"), F.array_join(names, ",").alias("errors"))


@query("""with k as (select l_linestatus as strategy, case when l_returnflag <> 'N' then l_returnflag end as kind, count(*) n, sum(cast(l_extendedprice as decimal(12,2))) c from lineitem group by 1, 2)
select strategy, cast(sum(n) as bigint) as runs, cast(sum(c) as double) as cost, coalesce(string_agg(kind || ':' || n, ',' order by kind) filter (where kind is not null), '') as errors from k group by 1""")
def e55_strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem")
    m = strategy_metrics(l, "l_linestatus", money("l_extendedprice"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return m.withColumnRenamed("l_linestatus", "strategy")


def coerced_rules(config: DataFrame) -> DataFrame:
    """field, label, most values, penalty of rules kept as text: labels from the field's name, one value where none or less is named, no negative penalties."""
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.initcap(F.translate("field", "_", " ")))
    return config.select("field", label.alias("label"), F.greatest(F.lit(1), F.coalesce(F.col("most").try_cast("int"), F.lit(1))).alias("most"), F.greatest(F.lit(0.0), F.coalesce(F.col("penalty").try_cast("double"), F.lit(0.0))).alias("penalty"))


@query("""select 'part_' || p_partkey as field, case when p_type = 'PROMO' then p_name else 'Part ' || p_partkey end as label, greatest(1, p_size - 20) as most, case when p_size > 25 then 0.3 else 0.0 end::double as penalty from part""")
def p08_rule_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    n = F.col("p_size")
    return coerced_rules(p.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("field"), F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(" ").alias("label"), (n - 20).cast("string").alias("most"), F.when(n > 25, "0.3").when(n > 10, "-1").otherwise("none").alias("penalty")))
