"""Statistics of paired results, as column expressions where they are closed forms, else as small vectorised functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import ranked_within

Z95 = 1.959963984540054


def normal_interval(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a binary mean by its sample variance, within 0 and 1."""
    p = hits / n
    half = F.when(n > 1, z * F.sqrt(p * (1 - p) * n / (n - 1) / n)).otherwise(0.0)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def wilson_interval(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p, zz = hits / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return centre - half, centre + half


def sample_size(base: Column, effect: Column, z_alpha: float = Z95, z_power: float = 0.8416212335729143) -> Column:
    """Rows in each arm to see `effect` on a rate of `base`."""
    other = base + effect
    mean = (base + other) / 2
    top = z_alpha * F.sqrt(2 * mean * (1 - mean)) + z_power * F.sqrt(base * (1 - base) + other * (1 - other))
    return F.ceil(top * top / (effect * effect))


def regression(metric: Column, old: Column, new: Column, lower_is_better: tuple[str, ...] = ("duration_ms", "cost"), band: float = 0.1) -> Column:
    """Is the change of a metric worse than the band, better, or neither? A change from zero counts as infinite."""
    change = F.when(old == 0, F.when(new == 0, 0.0).otherwise(F.when(new > 0, float("inf")).otherwise(float("-inf")))).otherwise((new - old) / F.abs(old))
    worse = F.when(metric.isin(*lower_is_better), change).otherwise(-change)
    return F.when(worse > band, "regression").when(worse < -band, "improvement").otherwise("neutral")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400 + 20 * math.isqrt(int(a + b))):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d if abs(1 + step * d) > 1e-300 else 1e-300)
        c = 1 + step / c if abs(1 + step / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The value that |t| stays below with chance p, by halving."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(float(a), float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


def sign_two_sided(wins: int, losses: int) -> float:
    """Two-sided sign test: twice the smaller tail of a fair coin, by exact integers up to 1,000 trials, beyond them as an incomplete beta function, whose work hardly grows with the trials."""
    n, k = wins + losses, min(wins, losses)
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    return min(1.0, 2 * incomplete_beta(n - k, k + 1, 0.5))


@F.pandas_udf(T.DoubleType())
def sign_p_value(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Two-sided sign test; 1 without a decision."""
    return pd.Series([sign_two_sided(int(a), int(b)) for a, b in zip(wins, losses, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_margin(df: pd.Series) -> pd.Series:
    """How many standard errors a 95 % interval of a mean reaches to each side; null without a degree of freedom."""
    known = {v: t_quantile(0.95, float(v)) for v in df.dropna().unique() if v > 0}
    return pd.Series([known.get(v) for v in df], dtype="float64")


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(float(v)) / math.sqrt(2)) for v in z], dtype="float64")


def paired_t(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """n, mean difference b - a, t and d (Cohen) of paired values; null t without variance."""
    d = F.col(b) - F.col(a)
    s = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    return s.select(*keys, "n", "mean_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).alias("t"), F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")).alias("d"))


def signed_rank(pairs: DataFrame, difference: str, key: str) -> DataFrame:
    """key, n, w, z of Wilcoxon's test for each key: zeros are left out, ties share ranks, w is the smaller sum of ranks, z its normal score (null without variance).

    Ranks come from sorted ranges, so no task holds a whole key; ties are counted before ranks are summed.
    """
    d = pairs.where(F.col(difference) != 0).select(key, F.abs(difference).alias("size"), (F.col(difference) > 0).cast("long").alias("up"))
    # the mean rank of a tie does not depend on the order within it, so any number splits a tie of many rows
    ties = ranked_within(d.withColumn("any", F.monotonically_increasing_id()), key, "size", "any").groupBy(key, "size").agg((F.avg("__rank") + 1).alias("rank"), F.sum("up").alias("up"), F.count("*").alias("c"))
    sums = ties.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("above"), F.sum(F.col("rank") * (F.col("c") - F.col("up"))).alias("below"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("tied"))
    n, w = F.col("n"), F.least("above", "below")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48
    return sums.select(key, "n", w.alias("w"), F.when(var > 0, (w - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))
