"""Approximate string joins by a segment index, and what is built on them: closest options, and search for a table of queries.

Two strings within k edits share a piece: cut one into k + 1 segments, and one of them stands unchanged in the other, not far
from its place. So strings meet by equal segments in a hash join, and only those that meet are compared (Li et al. 2011).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .tables import first_by

#: Pairs with a string longer than this meet by their lengths alone: segments of long strings would be too many.
LONGEST = 64


def _floor(x: Column) -> Column:
    return F.floor(x + 1e-9).cast("int")


def _edits(longer: Column, most: float) -> Column:
    """Edits that a pair may have whose longer string has so many characters."""
    return _floor(longer * most)


def _segments(n: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of edits + 1 segments of n characters."""
    start = F.floor(i * n / (edits + 1)).cast("int")
    return start, F.floor((i + 1) * n / (edits + 1)).cast("int") - start


def _option_keys(s: Column, most: float) -> Column:
    """The segments of an option for each number of edits that a partner's length can allow."""
    n = F.length(s)
    widest = _floor(n / (1 - most))
    edits = F.array_distinct(F.transform(F.sequence(n, F.greatest(n, F.least(widest, F.lit(LONGEST)))), lambda longer: _edits(longer, most)))

    def keys(k: Column) -> Column:
        def one(i: Column) -> Column:
            start, size = _segments(n, k, i)
            return F.xxhash64(n, k, i, F.substring(s, start + 1, size))

        return F.transform(F.sequence(F.lit(0), k), one)

    none = F.array().cast("array<bigint>")
    short = F.when(n <= LONGEST, F.flatten(F.transform(edits, keys))).otherwise(none)
    return F.concat(short, F.when(widest > LONGEST, F.array(F.xxhash64(n))).otherwise(none))


def _value_keys(s: Column, most: float, lengths: list[int]) -> Column:
    """All pieces of a value that could be an option's segment, by the options' lengths."""
    m = F.length(s)

    def of_length(n: Column) -> Column:
        k = _edits(F.greatest(n, m), most)

        def of_segment(i: Column) -> Column:
            start, size = _segments(n, k, i)
            first = F.greatest(F.lit(0), start - F.floor((k - (m - n)) / 2)).cast("int")
            last = F.least(m - size, start + F.floor((k + (m - n)) / 2)).cast("int")
            places = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda q: F.xxhash64(n, k, i, F.substring(s, q + 1, size)))

        return F.when(F.greatest(n, m) > LONGEST, F.array(F.xxhash64(n))).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), k), of_segment)))

    near = F.filter(F.array(*map(F.lit, lengths)), lambda n: (n >= F.ceil(m * (1 - most) - 1e-9)) & (n <= _floor(m / (1 - most))))
    return F.array_distinct(F.flatten(F.transform(near, of_length)))


def edit_join(values: DataFrame, options: DataFrame, most: float = 0.4) -> DataFrame:
    """value, option, edits: all pairs with edits / length of the longer one <= most.

    values (value) and options (option) are strings, each taken once; compare lower-cased ones for a search without case. most
    is below 0.5. Null and empty strings pair with nothing; no rows give none. A pair is compared only if it shares a segment;
    pairs with a string over 64 characters, if their lengths fit.
    """
    if not 0 <= most < 0.5:
        raise ValueError("most is a share below 0.5")
    v, o = values.select("value").where("value <> ''").distinct(), options.select("option").where("option <> ''").distinct()
    lengths = [r[0] for r in o.select(F.length("option")).distinct().collect()]  # as many as there are different lengths
    if not lengths:
        return v.select("value", F.lit("").alias("option"), F.lit(0).alias("edits")).limit(0)
    left = v.select("value", F.explode(_value_keys(F.col("value"), most, sorted(lengths))).alias("key"))
    right = o.select("option", F.explode(_option_keys(F.col("option"), most)).alias("key"))
    longer = F.greatest(F.length("value"), F.length("option"))
    met = left.join(right, "key").select("value", "option", F.levenshtein("value", "option").alias("edits"), longer.alias("longer"))
    return met.where(F.col("edits") / F.col("longer") <= most).select("value", "option", "edits").distinct()


def closest(values: DataFrame, options: DataFrame, most: float = 0.4, first: float = 0.15) -> DataFrame:
    """value, option, edits, similarity of the closest option of each value that has one within `most`; ties to the first option by name.

    Values with an option within `first` are settled by a narrow join, with few segments; only the others need the wide one.
    """
    share = F.col("edits") / F.greatest(F.length("value"), F.length("option"))
    best = lambda pairs: first_by(pairs.withColumn("similarity", 1 - share), ["value"], F.desc("similarity"), "option")
    near = saved(best(edit_join(values, options, min(first, most))), "near")
    rest = values.select("value").distinct().join(near, "value", "left_anti")
    return near.union(best(edit_join(rest, options, most))) if most > first else near


def holding_join(values: DataFrame, options: DataFrame) -> DataFrame:
    """value, option: all pairs in which one string holds the other. Strings meet by the pieces of the one that have a length of the other."""
    v, o = values.select("value").where("value <> ''").distinct(), options.select("option").where("option <> ''").distinct()

    def inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
        (a,), (b,) = outer.columns, inner.columns
        lengths = F.array(*(F.lit(r[0]) for r in inner.select(F.length(b)).distinct().collect())).cast("array<int>")
        pieces = F.transform(F.filter(lengths, lambda n: n <= F.length(a)), lambda n: F.transform(F.sequence(F.lit(1), F.length(a) - n + 1), lambda q: F.substring(F.col(a), q, n)))
        return outer.select(a, F.explode(F.array_distinct(F.flatten(pieces))).alias(b)).join(inner, b).select("value", "option")

    return inside(v, o).union(inside(o, v)).distinct()


def cascade(values: DataFrame, options: DataFrame, most: float = 0.4) -> DataFrame:
    """value, option, stage: the best option of each value that has one, by the first stage that finds any.

    Stages: 1 equal; 2 one holds the other; 3 most words of three letters or more in common, at least one; 4 closest by edits,
    within `most`. Ties go to the first option by name. Each stage is a hash join (of strings, pieces, words, segments) for
    the values that the ones before left over. Null and empty strings find nothing and are found by nothing.
    """
    v, o = values.select("value").where("value <> ''").distinct(), options.select("option").where("option <> ''").distinct()
    done = v.join(o, F.col("value") == F.col("option")).select("value", "option", F.lit(1).alias("stage"))
    rest = lambda: v.join(done, "value", "left_anti")
    held = saved(holding_join(rest(), o).groupBy("value").agg(F.min("option").alias("option")).withColumn("stage", F.lit(2)), "held")
    done = done.union(held)
    words = lambda c: F.explode(F.filter(F.array_distinct(F.split(F.col(c), r"\s+")), lambda w: F.length(w) > 2)).alias("word")
    left = rest()
    shared = left.select("value", words("value")).join(o.select("option", words("option")), "word").groupBy("value", "option").agg(F.count("*").alias("n"))
    done = done.union(saved(first_by(shared, ["value"], F.desc("n"), "option").select("value", "option", F.lit(3).alias("stage")), "words"))
    return done.union(closest(rest(), o, most).select("value", "option", F.lit(4).alias("stage")))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def fuzzy_search(items: DataFrame, queries: DataFrame, weights: dict[str, float], most: float = 0.4, limit: int = 10, key: str = "item") -> DataFrame:
    """query, rank, item, terms, distance: the best items for each query.

    items: key and the fields of weights; queries: query, text. Each word of a query of two letters or more is looked for in
    all fields: its distance to an item is the least of edits / length of the longer word over the fields' words within `most`,
    stretched by how little the field weighs. Items are ranked by the number of words found, then by the sum of distances,
    then by key; `limit` for each query. Queries without words and items without fields find and are found by nothing; null
    fields are empty; repeated rows count once. Words meet by the segment index, each different one once, and items of equal
    fields are one text until the last step.
    """
    top = max(weights.values())
    fields = list(weights)
    texts = items.select(key, *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields)).where(F.col(key).isNotNull()).distinct()
    texts = saved(texts.withColumn("text", F.xxhash64(*fields)), "texts")
    each = texts.select("text", *fields).distinct()
    postings = each.select("text", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(words_of(F.col(f)) for f in fields)))).alias("field", "words")).select("text", "field", F.explode("words").alias("word"))
    terms = queries.select("query", F.explode(words_of(F.col("text"))).alias("term")).where(F.length("term") >= 2).distinct()
    near = edit_join(terms.select(F.col("term").alias("value")), postings.select(F.col("word").alias("option")), most)
    stretch = F.coalesce(*(F.when(F.col("field") == f, F.lit(top / w)) for f, w in weights.items()))
    far = F.col("edits") / F.greatest(F.length("value"), F.length("option")) * stretch
    # a word's distance to each text, then a query's
    hits = near.join(postings.withColumnRenamed("word", "option"), "option").groupBy(F.col("value").alias("term"), "text").agg(F.min(far).alias("far"))
    found = terms.join(hits, "term").groupBy("query", "text").agg(F.count("*").alias("terms"), F.sum(F.col("far").cast("decimal(18,9)")).cast("double").alias("distance"))
    best = [F.desc("terms"), "distance"]
    # no query needs more texts than results, nor more than so many items of one text
    ranked = found.withColumn("r", F.rank().over(Window.partitionBy("query").orderBy(*best))).where(F.col("r") <= limit).drop("r")
    own = first_by(texts.select("text", key), ["text"], key, n=limit)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*best, key))
    return ranked.join(own, "text").withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", F.col(key).alias("item"), "terms", "distance")
