"""Forward price adjustment under three missing-factor policies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions.windows import ffill

PRICES = ["open", "high", "low", "close"]


def with_factor(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Bars left-joined with the sparse adjustment factor. Both sides hash on
    the key; Spark broadcasts the factor side only where its size allows."""
    return bars.join(factors.select("code", "date", "fore_adjust_factor"), ["code", "date"], "left")


def scale(df: DataFrame, by: Column, prices=PRICES, prefix: str = "") -> DataFrame:
    return df.withColumns({prefix + p: F.col(p) * by for p in prices})


def to_base_date(bars: DataFrame, factors: DataFrame, base: dt.date, prices=PRICES, prefix: str = "adj_") -> DataFrame:
    """Policy 1: no forward fill. A bar without a factor counts 1; the base is the
    last factor up to ``base``; an instrument without one stays unadjusted."""
    ref = factors.where(F.col("date") <= F.lit(base)).groupBy("code").agg(
        F.max_by("fore_adjust_factor", "date").alias("_base"))
    df = with_factor(bars, factors).join(ref, "code", "left")
    by = F.when(F.col("_base").isNull(), F.lit(1.0)).otherwise(
        F.coalesce("fore_adjust_factor", F.lit(1.0)) / F.col("_base"))
    return scale(df, by, prices, prefix)


def to_as_of(bars: DataFrame, factors: DataFrame, as_of: dt.date, prices=PRICES, prefix: str = "adj_") -> DataFrame:
    """Policy 2: history up to ``as_of``, factor forward-filled then 1, re-based to its last row."""
    df = with_factor(bars.where(F.col("date") <= F.lit(as_of)), factors)
    df = df.withColumn("_f", F.coalesce(ffill("fore_adjust_factor"), F.lit(1.0)))
    whole = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.last("_f").over(whole)
    return scale(df, F.col("_f") / F.when(base.isNull() | (base == 0), F.lit(1.0)).otherwise(base), prices, prefix)


def to_sample_end(bars: DataFrame, factors: DataFrame, prices=PRICES, prefix: str = "") -> DataFrame:
    """Policy 3: factor forward-filled then 1, re-based to the last known factor of the sample."""
    df = with_factor(bars, factors)
    whole = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_f": F.coalesce(ffill("fore_adjust_factor"), F.lit(1.0)),
                         "_base": F.coalesce(F.last("fore_adjust_factor", ignorenulls=True).over(whole), F.lit(1.0))})
    return scale(df, F.col("_f") / F.col("_base"), prices, prefix).drop("_f", "_base")


def base_dependence(bars: DataFrame, factors: DataFrame, base_a: dt.date, base_b: dt.date) -> DataFrame:
    """Per instrument: largest return difference between two adjustment bases."""
    w = Window.partitionBy("code").orderBy("date")

    def returns(base, name):
        df = to_base_date(bars, factors, base, ["close"]).select("code", "date", "adj_close")
        return df.select("code", "date", (F.try_divide("adj_close", F.lag("adj_close").over(w)) - 1).alias(name))
    both = returns(base_a, "ra").join(returns(base_b, "rb"), ["code", "date"])
    return both.groupBy("code").agg(F.max(F.abs(F.col("ra") - F.col("rb"))).alias("max_return_diff"),
                                    F.count("ra").alias("n_returns"))
