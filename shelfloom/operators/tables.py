"""Table operators: upserts, deduplication, canonical ids, differences, merges. All work on keys, none on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved


def first_by(df: DataFrame, keys: list[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first n rows of each key by order. The order has to be total for a defined result."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and the rows of old whose key new lacks. new holds each key once."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key old lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def replace_relations(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of new; of old, those of owners that new has no row for."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def missing_keys(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys of incoming that known lacks."""
    return incoming.select(key).distinct().join(known.select(key), key, "left_anti")


def strict_persist(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """incoming if known has all its keys, else an error that names the number of missing ones."""
    lost = missing_keys(incoming, known, key).count()
    if lost:
        raise ValueError(f"{lost} values of {key} are unknown; nothing is kept")
    return incoming


def partial_persist(incoming: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of incoming with known keys, and the unknown keys."""
    return incoming.join(known.select(key).distinct(), key, "left_semi"), missing_keys(incoming, known, key)


def canonical_ids(df: DataFrame, key: Column, id_col: str, *order: Column | str) -> DataFrame:
    """id and canonical_id: the id that comes first, in ascending order, among the rows of equal key.

    The first of each key is a partial aggregate, so a key with very many rows is not sorted in one task.
    """
    own = df.withColumn("__key", key)
    first = own.groupBy("__key").agg(F.min_by(id_col, F.struct(*order)).alias("canonical_id")).withColumnRenamed("__key", "__first")
    return own.join(first, F.col("__key").eqNullSafe(F.col("__first"))).select(id_col, "canonical_id")


def repointed(df: DataFrame, ids: DataFrame, fk: str) -> DataFrame:
    """df with fk replaced by its canonical id where ids (id, canonical_id) has one."""
    own = ids.toDF("__id", "__canonical")
    return df.join(own, F.col(fk) == F.col("__id"), "left").withColumn(fk, F.coalesce("__canonical", fk)).drop("__id", "__canonical")


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, and the columns that differ (null-safe) with old and new values as strings; rows of new without a match have status missing, equal ones unchanged."""
    o = old.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__old_{c}") for c in columns))
    both = new.join(o, F.col(key) == F.col("__key"), "left")
    diff = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__old_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"__old_{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new"))) for c in columns)))
    status = F.when(F.col("__key").isNull(), "missing").when(F.size("diffs") == 0, "unchanged").otherwise("update")
    return both.withColumn("diffs", diff).select(key, status.alias("status"), F.when(F.col("__key").isNotNull(), F.col("diffs")).otherwise(F.array().cast("array<struct<field:string,old:string,new:string>>")).alias("diffs"))


def price_history(old: DataFrame, new: DataFrame, key: str, price: str) -> DataFrame:
    """key, old and new price of rows whose price is distinct from before."""
    o = old.select(key, F.col(price).alias("old_price"))
    return new.join(o, key).where(~F.col(price).eqNullSafe(F.col("old_price"))).select(key, "old_price", F.col(price).alias("new_price"))


def merged_sources(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Map columns `sources` of both sides merged by key; the new side's entries win. Entries that are maps themselves are merged field by field."""
    kind = old.schema["sources"].dataType
    both = old.select(key, F.col("sources").alias("__a")).join(new.select(key, F.col("sources").alias("__b")), key, "full_outer")
    none = F.create_map().cast(kind)

    def merged(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    def entries(a: Column, b: Column) -> Column:
        empty = F.create_map().cast(kind.valueType)
        return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merged(F.coalesce(x, empty), F.coalesce(y, empty))))

    merge = entries if isinstance(kind.valueType, T.MapType) else merged
    return both.select(key, merge(F.coalesce("__a", none), F.coalesce("__b", none)).alias("sources"))


def balanced_slices(df: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """Rows with slice_index: ceil(n / size) slices whose sizes differ by one at most, longer ones first.

    The rank comes from counts by range of the order, so no task holds all rows: rows are ranged, each range is counted, and
    the ranges' few counts are summed up.
    """
    ranked = ranked_globally(df, *order)
    n = ranked.agg(F.count("*")).first()[0]
    slices = max(1, -(-n // size))
    least, longer = divmod(n, slices)
    r = F.col("__rank")
    own = F.when(r < longer * (least + 1), F.floor(r / (least + 1))).otherwise(longer + F.floor((r - longer * (least + 1)) / max(1, least)))
    return ranked.withColumn("slice_index", own.cast("long")).drop("__rank")


def ranked_within(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Rows with __rank from 0 within each key, in a total order, without a task that holds a whole key. Rows without the key are left out."""
    ranked = ranked_globally(df.where(F.col(key).isNotNull()), key, *order)
    first = ranked.groupBy(key).agg(F.min("__rank").alias("__least"))
    return ranked.join(first, key).withColumn("__rank", F.col("__rank") - F.col("__least")).drop("__least")


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, median: the mean of the middle two values of each key, nulls aside, by rank."""
    ranked = ranked_within(df.where(F.col(value).isNotNull()).select(key, value), key, value)
    own = ranked.join(ranked.groupBy(key).agg(F.count("*").alias("__n")), key)
    middle = (F.col("__rank") == F.floor((F.col("__n") - 1) / 2)) | (F.col("__rank") == F.floor(F.col("__n") / 2))
    return own.where(middle).groupBy(key).agg(F.avg(value).alias("median"))


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in sorted ranges of bounded size: __id grows with the order, __part is the number of a row's range.

    Written once, as a second run of the same plan could draw other bounds.
    """
    return saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranges").withColumn("__part", F.shiftright("__id", 33))


def ranked_globally(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with __rank from 0 in a total order, by sorted ranges instead of one window over all rows."""
    own = ranged(df, *order).withColumn("__local", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = own.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return own.join(counts.select("__part", before.alias("__before")), "__part").withColumn("__rank", F.col("__before") + F.col("__local")).drop("__part", "__local", "__before", "__id")
