"""Bar scans, look-back slices and the incremental factor store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions.windows import ffill
from quantweave.operators import adjust


def between(df: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    if start:
        df = df.where(F.col("date") >= F.lit(start))
    if end:
        df = df.where(F.col("date") <= F.lit(end))
    return df


def bar_scan(bars: DataFrame, start=None, end=None, codes: Sequence[str] | None = None, min_days: int = 30) -> DataFrame:
    """Bars of a date range without instruments that have fewer than ``min_days`` rows."""
    df = between(bars, start, end)
    if codes is not None:
        df = df.where(F.col("code").isin(list(codes)))
    df = df.withColumn("is_st", F.coalesce("is_st", F.lit(0)))
    n = F.count(F.lit(1)).over(Window.partitionBy("code"))
    return df.withColumn("_n", n).where(F.col("_n") >= min_days).drop("_n")


def scan_with_factor(bars: DataFrame, factors: DataFrame, start=None, end=None, min_days: int = 30) -> DataFrame:
    df = adjust.with_factor(bar_scan(bars, start, end, None, min_days), factors)
    return df.withColumn("fore_adjust_factor", F.coalesce(ffill("fore_adjust_factor"), F.lit(1.0)))


def training_scan(bars: DataFrame, factors: DataFrame, start=None, end=None) -> DataFrame:
    return adjust.to_sample_end(bar_scan(bars, start, end, None, 100), factors)


def codes_in_range(bars: DataFrame, start, end) -> DataFrame:
    return between(bars, start, end).select("code").distinct()


def calendar(bars: DataFrame) -> DataFrame:
    """Sessions with their running number and successor. The window runs over
    the distinct dates only (one row per session), never over bars."""
    w = Window.orderBy("date")
    return (bars.select("date").distinct()
            .withColumns({"session": F.row_number().over(w), "next_date": F.lead("date").over(w)}))


def last_n(bars: DataFrame, n: int, as_of: dt.date | None = None) -> DataFrame:
    """Last n bars per instrument; the row limit is applied before the shuffle too."""
    w = Window.partitionBy("code").orderBy(F.desc("date"))
    return between(bars, None, as_of).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def latest_close(bars: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return between(bars, None, as_of).groupBy("code").agg(
        F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


def append_new(store: DataFrame, bars: DataFrame, compute: Callable[[DataFrame], DataFrame], lookback: int) -> DataFrame:
    """Rows to append to a factor store: dates after each instrument's last
    stored date, computed from at most ``lookback`` earlier bars."""
    last = store.groupBy("code").agg(F.max("date").alias("_last"))
    w = Window.partitionBy("code").orderBy("date")
    df = bars.join(last, "code", "left").withColumn("_rn", F.row_number().over(w))
    known = F.max(F.when(F.col("date") <= F.col("_last"), F.col("_rn"))).over(Window.partitionBy("code"))
    df = df.withColumn("_from", F.coalesce(known, F.lit(0)) - lookback).where(F.col("_rn") > F.col("_from"))
    out = compute(df.drop("_rn", "_from"))
    return out.where(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).select(*store.columns)


def refreshed_store(store: DataFrame, bars: DataFrame, compute, lookback: int) -> DataFrame:
    return store.unionByName(append_new(store, bars, compute, lookback))


def factor_as_of(store: DataFrame, as_of: dt.date, features: Sequence[str]) -> DataFrame:
    """Exact date else latest earlier row per instrument; absent or null features are 0."""
    present = [f for f in features if f in store.columns]
    row = store.where(F.col("date") <= F.lit(as_of)).groupBy("code").agg(
        F.max("date").alias("date"), *[F.max_by(f, "date").alias(f) for f in present])
    return row.select("code", "date", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) if f in present
                                        else F.lit(0.0).alias(f) for f in features])


def active_sample(bars: DataFrame, start: dt.date, more_than: int, n: int) -> DataFrame:
    """n instruments with more than ``more_than`` bars since ``start``, in hash order (repeatable)."""
    return (bars.where(F.col("date") >= F.lit(start)).groupBy("code").agg(F.count(F.lit(1)).alias("n_bars"))
            .where(F.col("n_bars") > more_than).orderBy(F.md5("code"), "code").limit(n))
