"""Market-breadth measures per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantweave.functions.windows import div, lag, sma

# Tolerance and move thresholds of the breadth counts.
TOLERANCE = 0.0001
STRONG = 0.05
LIMIT = 0.093


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def stats(bars: DataFrame) -> DataFrame:
    df = bars.select("code", "date", "open", "high", "low", "close", "volume", lag("close").alias("_pc"))
    cl, op = F.col("close"), F.col("open")
    move, change = div(cl, op) - 1, div(cl, "_pc") - 1
    return df.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(cl > op * (1 + TOLERANCE)).alias("up_count"),
        count_if(move > STRONG).alias("strong_up_count"),
        count_if(cl < op * (1 - TOLERANCE)).alias("down_count"),
        count_if((cl >= F.col("high") * (1 - TOLERANCE)) & (change > LIMIT)).alias("limit_up_count"),
        count_if((cl <= F.col("low") * (1 + TOLERANCE)) & (change < -LIMIT)).alias("limit_down_count"),
        F.avg(move).alias("mean_return"), F.sum("volume").alias("total_volume"),
        F.sum(F.when(cl > op, F.col("volume")).otherwise(0.0)).alias("adv_volume"))


def above_ma20(bars: DataFrame) -> DataFrame:
    """Share of instruments above their 20-row mean; no mean yet counts as below."""
    df = bars.select("date", F.coalesce((F.col("close") > sma("close", 20)).cast("int"), F.lit(0)).alias("above"))
    return df.groupBy("date").agg(F.avg("above").alias("breadth_ma20"))


def breadth(bars: DataFrame) -> DataFrame:
    """All nine measures in one pass over the bars: the windows run first, then one aggregate per date."""
    df = bars.select("code", "date", "open", "high", "low", "close", "volume")
    df = df.withColumn("_above", F.coalesce((F.col("close") > sma("close", 20)).cast("int"), F.lit(0)))
    ma = df.withColumn("_pc", lag("close"))
    cl, op = F.col("close"), F.col("open")
    move, change = div(cl, op) - 1, div(cl, "_pc") - 1

    def share(cond):
        return F.avg(F.when(cond, 1.0).otherwise(0.0))
    adv = F.sum(F.when(cl > op, F.col("volume")).otherwise(0.0))
    return ma.groupBy("date").agg(
        share(cl > op * (1 + TOLERANCE)).alias("up_ratio"), share(move > STRONG).alias("strong_up_ratio"),
        share(cl < op * (1 - TOLERANCE)).alias("down_ratio"),
        share((cl >= F.col("high") * (1 - TOLERANCE)) & (change > LIMIT)).alias("limit_up_ratio"),
        share((cl <= F.col("low") * (1 + TOLERANCE)) & (change < -LIMIT)).alias("limit_down_ratio"),
        F.avg(move).alias("mean_return"), F.sum("volume").alias("total_volume"),
        F.coalesce(F.try_divide(adv, F.sum("volume")), F.lit(0.0)).alias("adv_vol_ratio"),
        F.avg("_above").alias("breadth_ma20"))


BREADTH = ["up_ratio", "strong_up_ratio", "down_ratio", "limit_up_ratio", "limit_down_ratio", "mean_return",
           "total_volume", "adv_vol_ratio", "breadth_ma20"]
