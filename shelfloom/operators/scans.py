"""Running values within keys, for keys of any size: segmented prefix scans over sorted ranges.

Rows are ranged by (key, order), so a frequent key lies in several ranges and no task holds it. Each range is scanned by itself;
a key's part in a range begins with what its parts in earlier ranges add up to. Only the first key of a range can have begun
before, so these carries are at most a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import ranged


def scanned(df: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, previous: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums (up to and with each row) and previous values (of the row before) within each key.

    order has to be total within a key. Nulls add nothing, and a sum without values is null; a null key is a key. The first
    row of a key has null previous values. Repeated rows that order can't tell apart come in any order; no rows give no rows.
    """
    sums, previous = sums or {}, previous or {}
    own = ranged(df.withColumns({f"__s_{c}": v for c, v in sums.items()} | {f"__p_{c}": v for c, v in previous.items()}), key, *order)
    # what each key's part in a range hands on
    parts = own.groupBy("__part", key).agg(*(F.sum(f"__s_{c}").alias(f"__t_{c}") for c in sums), *(F.max_by(F.struct(f"__p_{c}"), "__id").alias(f"__l_{c}") for c in previous), F.count("*").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__part")  # a row for each range that holds the key
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("__part", F.col(key).alias("__key"), *(F.sum(f"__t_{c}").over(before).alias(f"__c_{c}") for c in sums), *(F.lag(f"__l_{c}").over(earlier).alias(f"__v_{c}") for c in previous), F.lag("__part").over(earlier).alias("__from"))
    carried = carried.where("__from is not null").drop("__from").withColumnRenamed("__part", "__of")
    local = Window.partitionBy("__part", key).orderBy("__id")
    both = own.withColumns({f"__r_{c}": F.sum(f"__s_{c}").over(local.rowsBetween(Window.unboundedPreceding, 0)) for c in sums} | {f"__b_{c}": F.lag(F.struct(f"__p_{c}")).over(local) for c in previous})
    both = both.join(F.broadcast(carried), (F.col("__part") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")), "left")  # at most a row for each range
    out = [F.coalesce(F.col(f"__r_{c}") + F.col(f"__c_{c}"), f"__r_{c}", f"__c_{c}").alias(c) for c in sums] + [F.coalesce(f"__b_{c}", f"__v_{c}")[f"__p_{c}"].alias(c) for c in previous]
    return both.select(*(c for c in df.columns if c not in sums | previous), *out)
